"""URL filters: listed rules first, then a naive Bayes judge of segmented names.

Names without separators are split into words by a unigram Viterbi search; the
unigrams are the words that occur at least ``MIN_COUNT`` times in all page titles,
at any size of input. A multinomial naive Bayes model learns from all pages that a
rule decides and judges the others by the words of host and path; every taught
token has its own weight. Counts and weights are distributed tables: each distinct
name is split once, with the counts of those of its substrings that are words, and
names and tokens are joined to what they need. What makes up at least ``MIN_SHARE``
of the rows that are joined is broadcast for that, so that no key takes a task of
its own; results don't depend on it.

Edge cases: null urls and urls without ``://`` have empty host and path, fit no
rule and are judged by the model's prior; where no rule decides any page the
verdict is allow; null html has no title; repeated rows are judged alike; empty
tables give empty results; only page_id, url and html are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import batch_of, stash

# The listed rules (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Least count of a title word, whatever the input's size.
MIN_COUNT = 2
#: Share of the joined rows from which on a name or token is broadcast.
MIN_SHARE = 1e-5
#: Longest word the search considers, in characters.
MAX_WORD = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = re.compile(r"[^\W\d_]+|\d+")


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    cut = F.expr(f"if(instr({url}, '://') > 0, substr({url}, instr({url}, '://') + 3), '')")
    host = F.regexp_extract(cut, r"^([^/?#]*)", 1)
    path = F.regexp_extract(cut, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, listed (the rule's verdict), title."""
    host, path = host_and_path()
    title = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)", 1))
    df = pages.select("page_id", host.alias("host"), path.alias("path"), title.alias("title"))
    best, listed = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # a later, longer one replaces
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        best, listed = F.when(fits, h + p).otherwise(best), F.when(fits, verdict).otherwise(listed)
    return df.select("page_id", "host", "path", best.alias("rule"), listed.alias("listed"), "title")


class Segmenter:
    """Most probable split by unigrams; a word not among them costs more the longer it is."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        """total: of the counts of all words, where ``counts`` has only those that can occur."""
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total)
        self.known: dict[str, tuple[str, ...]] = {}

    def split(self, name: str) -> tuple[str, ...]:
        found = self.known.get(name)
        if found is not None:
            return found
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - MAX_WORD), end):
                word = name[start:end]
                cost = self.cost.get(word)
                if cost is None:
                    cost = self.unknown + 2.5 * len(word)
                options.append((best[start][0] + cost, start))
            best.append(min(options))
        words, end = [], len(name)
        while end:
            words.append(name[best[end][1] : end])
            end = best[end][1]
        if len(self.known) > 200_000:  # a cache only
            self.known.clear()
        self.known[name] = found = tuple(reversed(words))
        return found


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of letters or digits of host (h:) and path (p:); a number's ``token`` goes by its length, names have none yet."""
    schema = pa.schema([("row", pa.int64()), ("listed", pa.string()), ("mark", pa.string()), ("name", pa.string()), ("token", pa.string())])
    for batch in batches:
        out = []
        for row, listed, host, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for mark, text in (("h:", host), ("p:", path.lower())):
                out += [(row, listed, mark, run, f"{mark}#{min(len(run), 4)}" if run.isdigit() else None) for run in _RUN.findall(text)]
        yield batch_of(schema, [[x[k] for x in out] for k in range(5)])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each substring of a name that the search considers."""
    schema = pa.schema([("name", pa.string()), ("w", pa.string())])
    for batch in batches:
        for name in batch.column(0).to_pylist():
            found = list({name[a:b] for a in range(len(name)) for b in range(a + 1, min(a + MAX_WORD, len(name)) + 1)})
            yield batch_of(schema, [[name] * len(found), found])


def _split(total: int):
    schema = pa.schema([("name", pa.string()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, words, counts = (c.to_pylist() for c in batch.columns)
            yield batch_of(schema, [names, [list(Segmenter(dict(zip(w, n, strict=True)), total).split(name)) for name, w, n in zip(names, words, counts, strict=True)]])

    return run


def _looked_up(rows: DataFrame, values: DataFrame, key: str, least: float) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row a key; its ``uses``: in how many of rows), null where it has none."""
    often = values.where(F.col("uses") >= least).drop("uses").withColumn("hit", F.lit(True))
    both = rows.join(F.broadcast(often), key, "left")
    rest = both.where("hit is null").select(rows.columns).join(values.where(F.col("uses") < least).drop("uses"), key, "left")
    return both.where("hit").drop("hit").unionByName(rest)


def filtered(spark: SparkSession, pages: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    df = stash(spark, ruled(pages).withColumn("row", F.monotonically_increasing_id()), "ruled")
    words = df.select(F.explode(F.split("title", r"[^\p{L}]+")).alias("w")).where("w != ''").groupBy("w").count().where(F.col("count") >= MIN_COUNT)
    words = stash(spark, words, "words")
    total = words.agg(F.sum("count")).first()[0] or 0
    found = df.select("row", "listed", "host", "path").mapInArrow(_names, "row long, listed string, mark string, name string, token string")
    found = stash(spark, found, "names")
    names = stash(spark, found.where("token is null").groupBy("name").agg(F.count("*").alias("uses")), "uses")
    known = names.select("name").mapInArrow(_parts, "name string, w string").join(words, "w").groupBy("name").agg(F.collect_list(F.struct("w", "count")).alias("k"))
    known = names.select("name").join(known, "name", "left").select("name", *(F.coalesce(c, F.array()).alias(a) for c, a in ((F.col("k.w"), "w"), (F.col("k.count"), "n"))))
    split = known.mapInArrow(_split(total), "name string, words array<string>").join(names, "name")
    split = stash(spark, split, "split")
    least = max(1.0, (names.agg(F.sum("uses")).first()[0] or 0) * min_share)
    spelled = _looked_up(found.where("token is null"), split, "name", least).select("row", "listed", F.explode("words").alias("w"), "mark").select("row", "listed", F.concat("mark", "w").alias("t"))
    tokens = stash(spark, spelled.unionAll(found.where("token is not null").select("row", "listed", "token")), "tokens")

    seen = {r.listed: r["count"] for r in df.where("listed is not null").groupBy("listed").count().collect()}
    counts = tokens.groupBy("t").agg(F.count_if(F.col("listed") == "allow").alias("a"), F.count_if(F.col("listed") == "block").alias("b"), F.count("*").alias("uses"))
    counts = stash(spark, counts, "counts")
    sums = counts.agg(F.sum("a"), F.sum("b"), F.sum("uses"), F.count_if(F.col("a") + F.col("b") > 0)).first()
    allowed, blocked, uses, size = sums[0] or 0, sums[1] or 0, sums[2] or 0, (sums[3] or 0) + 1
    # a token that no rule's page has counts nothing in both, and so gets the weight of an unknown one
    weight = F.log((F.col("b") + 1) / F.lit(blocked + size)) - F.log((F.col("a") + 1) / F.lit(allowed + size))
    prior = math.log((seen["block"] + 1) / (seen["allow"] + 1)) if seen.get("allow") and seen.get("block") else -1.0
    weights = counts.select("t", weight.alias("weight"), "uses")
    scores = _looked_up(tokens.select("row", "t"), weights, "t", max(1.0, uses * min_share)).groupBy("row").agg(F.sum("weight").alias("weight"))
    score = F.lit(prior) + F.coalesce("weight", F.lit(0.0))
    judged = F.coalesce("listed", F.when(score > 0, "block").otherwise("allow"))
    return df.join(scores, "row", "left").select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", judged.alias("verdict"), score.alias("block_score"))
