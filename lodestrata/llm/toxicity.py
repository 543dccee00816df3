"""Toxic spans by a linear-chain conditional random field with two tags.

Labelled documents (a sample of at most ``MAX_TRAIN`` rows, those with the
smallest hashes of their ids) say which words and word beginnings go with toxic
documents; words that have such a feature, in toxic documents, are the tokens
tagged toxic. The field's weights (features, tag biases, transitions) are fitted
to these tags by gradient ascent on the conditional likelihood. Forward-backward
marginals of a text's words give its expected number of toxic words and the
largest marginal; a logistic function of both, fitted to the labels, is the
document's score. Words without a feature all act alike on the chain, so a run of
them is one power of a 2x2 matrix; the marginals are those of the whole sequence.

Only the words of the text are inputs. Edge cases: null and empty texts, and texts
without such words, get the score of no evidence; null labels are not learned
from; without labelled rows of both kinds every score is 0; repeated rows are
scored alike (of texts that repeat a doc_id the least is learned from), and rows with null doc_id are scored and count as not held out;
empty tables give empty results; of documents only doc_id and text are read, of
labels doc_id and toxic.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import batch_of, in_arrow, steps, text_docs

#: Bounds of the sample that the model is fitted on: rows, and bytes of a text (longer ones are scored, not learned from).
MAX_TRAIN, MAX_TRAIN_BYTES = 6000, 256 << 10
PREFIXES = (3, 4, 5)
#: A feature must be in so many toxic documents, in that share of them, and so many times likelier in them than in others.
MIN_TOXIC_DOCS = 3
MIN_TOXIC_SHARE = 0.01
MIN_RATIO = 12.0
#: In fitting, runs without a feature longer than twice this are a break.
CONTEXT = 6
EPOCHS = 8
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RESULT = "doc_id long, score double, toxic_words string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("toxic_words", pa.string())])


def features_of(word: bytes) -> list[bytes]:
    return [word + b"$", *(word[:n] for n in PREFIXES if len(word) > n)]


def toxic_features(docs: list[list[bytes]], toxic: list[int]) -> set[bytes]:
    """Features much likelier in toxic documents than in others."""
    counts = (Counter(), Counter())
    for words, t in zip(docs, toxic, strict=True):
        counts[t].update({f for w in set(words) for f in features_of(w)})
    n = (toxic.count(0) + 1, toxic.count(1) + 1)
    return {f for f, k in counts[1].items() if k >= max(MIN_TOXIC_DOCS, MIN_TOXIC_SHARE * n[1]) and (k + 0.5) / n[1] >= MIN_RATIO * (counts[0][f] + 0.5) / n[0]}


class Field:
    """Weights: feature -> score of tag 1 over tag 0, a bias of tag 1, transitions [from][to]."""

    def __init__(self) -> None:
        self.weight: dict[bytes, float] = {}
        self.bias = -4.0
        self.move = [[1.0, -1.0], [0.0, 0.0]]
        self.doc = (0.0, 0.0, 0.0)

    def emission(self, word: bytes) -> float | None:
        found = [self.weight[f] for f in features_of(word) if f in self.weight]
        return sum(found) if found else None

    def marginals(self, gaps: list[int], emissions: list[float]) -> list[float]:
        """P(tag 1) at each word with a feature. gaps: words without one before each, and after the last."""
        t = np.exp(np.array(self.move))
        plain = t * np.array([1.0, math.exp(self.bias)])
        values, vectors = np.linalg.eig(plain)
        values = values / values[np.abs(values).argmax()]  # the largest becomes 1, so no power overflows or vanishes
        inverse = np.linalg.inv(vectors)
        power = lambda n: ((vectors * values**n) @ inverse).real
        local = [np.array([1.0, math.exp(min(50.0, self.bias + e))]) for e in emissions]
        n = len(local)
        forward, backward = [], [np.ones(2)] * n
        a = None
        for i in range(n):
            if a is None:
                g = gaps[0]
                a = local[i] if g == 0 else (np.array([1.0, math.exp(self.bias)]) @ power(g - 1)) @ t * local[i]
            else:
                a = (a @ power(gaps[i])) @ t * local[i]
            a = a / a.sum()
            forward.append(a)
        b = power(gaps[n]) @ np.ones(2)
        backward[n - 1] = b / b.sum()
        for i in range(n - 2, -1, -1):
            b = power(gaps[i + 1]) @ (t @ (local[i + 1] * backward[i + 1]))
            backward[i] = b / b.sum()
        return [float((f * b)[1] / (f * b).sum()) for f, b in zip(forward, backward, strict=True)]

    def score(self, marginals: list[float]) -> float:
        a, b, c = self.doc
        z = a + b * math.log1p(sum(marginals)) + c * max(marginals, default=0.0)
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _segments(words: list[bytes], chosen: set[bytes], toxic: int) -> list[tuple[list[list[bytes]], list[int]]]:
    """Stretches around words with features: (features, tag) of each word."""
    has = [[f for f in features_of(w) if f in chosen] for w in words]
    hits = [i for i, f in enumerate(has) if f]
    out, i = [], 0
    while i < len(hits):
        j = i
        while j + 1 < len(hits) and hits[j + 1] - hits[j] <= 2 * CONTEXT:
            j += 1
        span = range(max(0, hits[i] - CONTEXT), min(len(words), hits[j] + CONTEXT + 1))
        out.append(([has[k] for k in span], [int(bool(has[k]) and toxic) for k in span]))
        i = j + 1
    return out


def fit(texts: list[bytes], toxic: list[int], epochs: int = EPOCHS, rate: float = 0.25) -> Field:
    field = Field()
    if len(set(toxic)) < 2:
        field.doc = (-40.0, 0.0, 0.0)
        return field
    docs = [t.translate(_WORDS).split() for t in texts]
    chosen = toxic_features(docs, toxic)
    segments = [s for words, t in zip(docs, toxic, strict=True) for s in _segments(words, chosen, t)]
    field.weight = w = dict.fromkeys(chosen, 0.0)
    squares: dict = defaultdict(lambda: 1e-2)
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for k in order.permutation(len(segments)):
            features, tags = segments[k]
            gradient = _gradient(field, features, tags)
            for key, g in gradient.items():
                squares[key] += g * g
                step = rate * g / math.sqrt(squares[key])
                if isinstance(key, bytes):
                    w[key] += step - 1e-4 * w[key]
                elif key == "bias":
                    field.bias += step
                else:
                    field.move[key[0]][key[1]] += step
    x = np.array([[1.0, math.log1p(sum(m)), max(m, default=0.0)] for m in (_marginals(field, d, {}) for d in docs)])
    y, beta = np.array(toxic, dtype=float), np.zeros(3)
    for _ in range(25):  # Newton with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        beta = beta + np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.05 * beta), -4, 4)
    field.doc = tuple(float(b) for b in beta)
    return field


def _gradient(field: Field, features: list[list[bytes]], tags: list[int]) -> dict:
    """Observed less expected counts, by forward-backward over one stretch."""
    w, n = field.weight, len(tags)
    e = [math.exp(min(30.0, field.bias + sum(w[f] for f in fs))) for fs in features]
    (t00, t01), (t10, t11) = ([math.exp(v) for v in row] for row in field.move)
    alpha = [(1 / (1 + e[0]), e[0] / (1 + e[0]))]
    for i in range(1, n):
        a, b = alpha[-1]
        x, y = a * t00 + b * t10, (a * t01 + b * t11) * e[i]
        alpha.append((x / (x + y), y / (x + y)))
    gradient: dict = defaultdict(float)
    p, q = 1.0, 1.0
    for i in range(n - 1, -1, -1):
        a, b = alpha[i]
        m = b * q / (a * p + b * q)
        g = tags[i] - m
        gradient["bias"] += g
        for f in features[i]:
            gradient[f] += g
        if i:
            c, d = alpha[i - 1]
            joint = (c * t00 * p, c * t01 * e[i] * q, d * t10 * p, d * t11 * e[i] * q)
            z = sum(joint)
            for j, key in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                gradient[key] += (key == (tags[i - 1], tags[i])) - joint[j] / z
            x, y = t00 * p + t01 * e[i] * q, t10 * p + t11 * e[i] * q
            p, q = x / (x + y), y / (x + y)
    return gradient


class _Emissions(dict):
    """word -> emission, or None; filled as words come, emptied when large."""

    def __init__(self, field: Field) -> None:
        self.field = field

    def __missing__(self, word: bytes):
        if len(self) > 400_000:
            self.clear()
        self[word] = found = self.field.emission(word)
        return found


def _hits(emissions, words: list[bytes]) -> tuple[list[int], list[float]]:
    found = [(i, e) for i, e in enumerate(map(emissions.__getitem__, words)) if e is not None]
    return [i for i, _ in found], [e for _, e in found]


def _marginals(field: Field, words: list[bytes], emissions) -> list[float]:
    at, e = _hits(emissions or _Emissions(field), words)
    if not at:
        return []
    gaps = [at[0], *(b - a - 1 for a, b in zip(at, at[1:], strict=False)), len(words) - at[-1] - 1]
    return field.marginals(gaps, e)


def _scores(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = _Emissions(field)
        for ids, texts in steps(batches):
            scores, spans = [], []
            for text in texts:
                words = text.translate(_WORDS).split()
                at, e = _hits(emissions, words)
                m = field.marginals([at[0], *(b - a - 1 for a, b in zip(at, at[1:], strict=False)), len(words) - at[-1] - 1], e) if at else []
                scores.append(field.score(m))
                spans.append(",".join(str(i) for i, p in zip(at, m, strict=True) if p >= 0.5))
            yield batch_of(_SCHEMA, [ids, scores, spans])

    return run


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_words (offsets in words of those tagged toxic)."""
    docs = text_docs(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held)
    # ids first, so that the sample is chosen before any text moves
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    short = docs.where(F.octet_length("text") <= MAX_TRAIN_BYTES)
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r.doc_id)
    field = fit([r.text.encode() for r in rows], [r.toxic for r in rows])
    found = in_arrow(docs, _scores(field), RESULT)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_words")
