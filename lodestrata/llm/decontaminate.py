"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Impacts are divided by an item's score against itself, so one threshold holds for
all items: 1 means that every word of the item is in the passage. Every document
is a row of text blocks; a passage is two neighbouring blocks, and a block is as
long as the longest item of a shard, so an item that stands in a text stands in
a passage. For each block the sum of its words' maxima over each block of items
bounds what any item there can score; pairs of a passage and an item block below
the threshold are skipped, in the others WAND pivots over the postings find every
item at or above it. An item then counts if enough of the word runs of both its
question and its answer are in the passage.

All words of a step of texts are hashed and looked up at once, and the bounds of
its blocks are sums over slices of an array; only pairs above the threshold reach
WAND, and only verified passages are cut into words again, so a collision of two
64-bit hashes can't flag a text.

Document frequencies are counted by Spark. The driver builds the index in shards
of ``SHARD_ITEMS`` items until ``PASS_BYTES`` are full; those are broadcast together
and searched in one pass over the documents. More items mean more passes, not
larger broadcasts: about 8,000 items are one.

Edge cases: null and empty texts match nothing, nor do items without words; items
of a few words must be there in full; equal items of different ids match alike,
repeated rows of one are one item; an item_id that is no number counts as null; of
passages that score alike the first is given; a row that repeats a doc_id gives its
own row per item; a text of any length is searched as a whole, in slices; an empty
table on either side gives an empty result; only doc_id, item_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import batch_of, empty, in_arrow, stash, steps, text_docs, without
from lodestrata.llm.hashing import hashed_words

K1, B = 1.2, 0.75
#: Share of its own score that an item must reach.
THRESHOLD = 0.5
#: Share of the word runs of question and answer that must be in the passage.
MIN_OVERLAP = 0.5
RUN = 3
ITEM_BLOCK = 2
SHARD_ITEMS = 512
#: About so many bytes of index are broadcast for one pass.
PASS_BYTES = 128 << 20
MIN_TEXT_BLOCK = 64
#: Pairs of a text block and a term whose maxima are summed at once.
SLICE = 20_000
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, last_word long, t binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("t", pa.binary())])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Up to the first question mark or line break and what follows; halves of the words if there is neither."""
    parts = re.split(r"(?<=\?)|\n", text.strip(), maxsplit=1)
    question = words_of(parts[0].encode())
    answer = words_of(parts[1].encode()) if len(parts) > 1 else []
    if not question or not answer:
        words = question or answer
        return words[: (len(words) + 1) // 2], words[len(words) // 2 :]
    return question, answer


def runs_of(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


class Index:
    """One shard: items as (item_id, text, document frequency of each word)."""

    def __init__(self, items: list[tuple[int, str, dict[bytes, int]]], n_items: int, mean_length: float) -> None:
        self.items = [i for i, *_ in items]
        words = [words_of(t.encode()) for _, t, _ in items]
        self.parts = [question_and_answer(t) for _, t, _ in items]
        self.text_block = max(MIN_TEXT_BLOCK, max(map(len, words)))
        names = sorted({w for own in words for w in own})
        hashes, _ = hashed_words(names, lower=False)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {names[k]: t for t, k in enumerate(order.tolist())}
        self.postings: list[dict[int, list[tuple[int, float]]]] = [{} for _ in names]  # of a term by item block: (item, impact)
        self.most = np.zeros((len(names), -(-len(items) // ITEM_BLOCK)), dtype=np.float32)
        for item, (own, (_, _, df)) in enumerate(zip(words, items, strict=True)):
            raw = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean_length)) for w, tf in Counter(own).items()}
            total, block = sum(raw.values()), item // ITEM_BLOCK
            for w, x in raw.items():
                t = number[w]
                self.postings[t].setdefault(block, []).append((item, x / total))
                self.most[t, block] = max(self.most[t, block], x / total)

    def size(self) -> int:
        return self.most.nbytes + 200 * sum(map(len, self.postings))

    def wand(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """Items of an item block whose impacts over ``terms`` sum to the threshold or more."""
        lists = [(p, float(self.most[t, block])) for t in terms if (p := self.postings[t].get(block))]
        at = [0] * len(lists)
        out: list[tuple[int, float]] = []
        while True:
            order = sorted((lists[i][0][at[i]][0], i) for i in range(len(lists)) if at[i] < len(lists[i][0]))
            bound, pivot = 0.0, -1
            for item, i in order:
                bound += lists[i][1]
                if bound >= threshold - 1e-6:
                    pivot = item
                    break
            if pivot < 0:
                return out
            score = 0.0
            for item, i in order:
                if item > pivot:
                    break
                postings = lists[i][0]
                while at[i] < len(postings) and postings[at[i]][0] < pivot:
                    at[i] += 1
                if at[i] < len(postings) and postings[at[i]][0] == pivot:
                    score += postings[at[i]][1]
                    at[i] += 1
            if score >= threshold - 1e-6:
                out.append((pivot, score))

    def search(self, words: np.ndarray, at: np.ndarray, exact, threshold: float, min_overlap: float) -> dict[tuple[int, int], tuple]:
        """(text, item) -> (score, overlaps, first and last word of the passage), the best passage of each verified item.

        ``words`` are hashes of the words of many texts, each beginning at its place in ``at``; ``exact`` gives a text's words.
        """
        size, best = self.text_block, {}
        lengths = np.diff(at)
        base = np.concatenate(([0], np.cumsum(-(-lengths // size) + 1)))  # a block without words ends each text
        i = np.searchsorted(self.hashes, words)
        i[i == len(self.hashes)] = 0
        hits = np.flatnonzero(self.hashes[i] == words)
        text = np.repeat(np.arange(len(lengths)), lengths)[hits]
        key = np.sort((base[text] + (hits - at[text]) // size) * len(self.hashes) + i[hits])
        if not len(key):
            return best
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        block, term = key // len(self.hashes), key % len(self.hashes)
        edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        own, stop = block[edge], np.concatenate((edge[1:], [len(key)]))
        row = 0
        while row < len(own):
            # passages that start with one of these blocks, or with the empty one before it
            end = max(row + 1, int(np.searchsorted(stop, edge[row] + SLICE, side="right")))
            upto = min(end + 1, len(own))
            sums = np.add.reduceat(self.most[term[edge[row] : stop[upto - 1]]], edge[row:upto] - edge[row], axis=0)
            after = np.zeros((end - row, sums.shape[1]), dtype=np.float32)
            follows = np.flatnonzero(own[row + 1 : upto] == own[row : upto - 1] + 1)
            follows = follows[follows < end - row]
            after[follows] = sums[follows + 1]
            for j, b in zip(*np.nonzero(sums[: end - row] + after >= threshold - 1e-4), strict=True):
                k = row + int(j)
                last = k + (k + 1 < len(own) and own[k + 1] == own[k] + 1)
                self._passage(best, int(own[k]), np.unique(term[edge[k] : stop[last]]), int(b), base, exact, threshold, min_overlap)
            row = end
        return best

    def _passage(self, best: dict, block: int, terms: np.ndarray, item_block: int, base: np.ndarray, exact, threshold: float, min_overlap: float) -> None:
        text, passage = int(np.searchsorted(base, block, side="right")) - 1, None
        for item, score in self.wand(terms[self.most[terms, item_block] > 0].tolist(), item_block, threshold):
            if (text, item) in best and best[text, item][0] >= score:
                continue
            if passage is None:
                words, first = exact(text), (block - int(base[text])) * self.text_block
                passage = words[first : first + 2 * self.text_block]
            overlaps = [self._overlap(part, passage) for part in self.parts[item]]
            if min(overlaps) >= min_overlap:
                best[text, item] = (score, *overlaps, first, first + len(passage) - 1)

    def _overlap(self, part: list[bytes], passage: list[bytes]) -> float:
        n = min(RUN, len(part))
        own = runs_of(part, n)
        return len(own & runs_of(passage, n)) / len(own)


_ITEM_WORDS = pa.schema([("item_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("word", pa.binary())])


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in steps(batches):
        rows = [(i, t.decode(), len(words), w) for i, t in zip(ids, texts, strict=True) if (words := words_of(t)) for w in set(words)]
        if rows:
            yield batch_of(_ITEM_WORDS, [list(c) for c in zip(*rows, strict=True)])


def shards(spark: SparkSession, benchmark: DataFrame) -> Iterator[Index]:
    """Items of like length together, so that long items don't lengthen the passages of short ones."""
    words = stash(spark, in_arrow(text_docs(benchmark, "item_id").distinct(), _distinct_words, "item_id long, text string, n_words long, word binary"), "item-words")
    frequency = words.groupBy("word").agg(F.count("*").alias("df"))
    items = words.join(frequency, "word").groupBy("item_id", "text", "n_words").agg(F.map_from_entries(F.collect_list(F.struct("word", "df"))).alias("df"))
    sums = words.select("item_id", "text", "n_words").distinct().agg(F.count("*").alias("n"), F.avg("n_words").alias("mean")).first()
    held: list[tuple[int, str, dict[bytes, int]]] = []
    for r in items.orderBy("n_words", "item_id", "text").toLocalIterator():
        held.append((r.item_id, r.text, {bytes(w): n for w, n in r.df.items()}))
        if len(held) == SHARD_ITEMS:
            yield Index(held, sums.n, sums.mean)
            held = []
    if held:
        yield Index(held, sums.n, sums.mean)


def _search(shared, threshold: float, min_overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in steps(batches):
            plain = [t.translate(_WORDS) for t in texts]
            words, at = hashed_words(plain, lower=False)
            cut = lru_cache(1)(lambda i: plain[i].split())  # passages of one text come one after the other
            rows = [(ids[i], shard.items[item], *found, hashlib.sha256(texts[i]).digest()[:16]) for shard in shared.value for (i, item), found in shard.search(words, at, cut, threshold, min_overlap).items()]
            if rows:
                yield batch_of(_SCHEMA, [list(c) for c in zip(*rows, strict=True)])

    return run


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """A row per document and test item found in it, with the best passage; t is the text's key (``text_key``)."""
    docs = text_docs(docs)
    found: DataFrame | None = None

    def search(index: list[Index]) -> DataFrame:
        part = in_arrow(docs, _search(spark.sparkContext.broadcast(index), threshold, min_overlap), RESULT)
        return part if found is None else found.unionByName(part)

    held: list[Index] = []
    for shard in shards(spark, benchmark):
        if held and sum(x.size() for x in held) + shard.size() > PASS_BYTES:
            found, held = stash(spark, search(held), "found"), []  # the driver needn't keep what has been searched
        held.append(shard)
    if held:
        found = search(held)
    return empty(spark, RESULT) if found is None else found


def clean_rows(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose texts hold no test item; a row goes by its own text, whatever its id or columns."""
    return without(docs, stash(spark, contaminated(spark, docs, benchmark).select("doc_id", "t").distinct(), "contaminated"))
