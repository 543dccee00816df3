"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the lower-cased words of a text, then an end; contexts are the up to
``DEPTH`` symbols before, a start symbol included. All training documents are
counted. Every run of two, three and more symbols that occurs at least
``MIN_COUNT`` times is in the tree's statistics, at any size of input. A context
stays in the tree if the likelihood that its own next-symbol distribution gains
over that of the context one symbol shorter (its count times their
Kullback-Leibler divergence, less what smoothing costs) reaches ``MIN_GAIN``; the
suffixes of a kept context stay too. A kept context gives what its counted runs
leave, and ``PRIOR``, to the distribution of the next shorter one; the shortest is
the unigram of all words with add-half smoothing, which is also the base. A symbol
is scored in the state of its longest kept suffix.

The tree is a distributed table. The logarithm of a symbol's probability is that of
the unigram, plus for each kept context the logarithm of what it gives on, plus for
each counted run in it the rest; so a text's gain is a sum of one value a run, and
the runs are joined to the values by their 64-bit hashes, as are the words. Three
things go to the tasks, each of a bounded size that results don't depend on: the
frequent words (``min_share`` of all), the values of the frequent runs
(``HOT_SHARE``), and bit filters by which a task leaves out runs that can't reach
``MIN_COUNT`` or surely have no value; a full filter leaves out less.

Runs are counted in blocks (``_packed``), each of all the contexts of a part, so a
run takes a few bytes where a row would take four numbers; what a block doesn't
hold, the run's suffix, follows from that of its context, which the join to the
contexts brings.

Edge cases: null and empty texts are the end symbol alone; without training
documents the tree is empty and train_tokens is 0; a null doc_id counts as
training (its remainder is unknown); repeated rows are counted and scored each;
empty tables give empty results; only doc_id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import batch_of, drop_stashes, in_arrow, made, release, shared_dir, stash, steps, text_docs
from lodestrata.llm.hashing import hashed_words, mix

DEPTH = 3
#: Least count of a run of two or more symbols, whatever the input's size.
MIN_COUNT = 2
#: Shares of all tokens from which on words and runs are looked up in the tasks instead of joined.
MIN_SHARE, HOT_SHARE = 1e-5, 1e-6
#: Training tokens whose runs are about one part of the counts, and rows that a task sends at once.
PART_TOKENS, SENT_ROWS = 1_000_000, 100_000
#: Bits of a filter, least and most; between them about half as many as training tokens.
FILTER_BITS = (1 << 26, 1 << 28)
#: Training tokens for which a join of runs takes another round, and rounds at most.
ROUND_TOKENS, MOST_ROUNDS = 10_000_000, 2
#: Tokens of the texts that are scored at once.
TEXT_TOKENS = 10_000_000
#: Nats that a context must gain over its parent.
MIN_GAIN = 12.0
#: Counts that a context adds to those of its parent's distribution.
PRIOR = 2.0
# The hashes that stand for the start and the end of a text.
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000002)
FOLD, HELD_OUT = 5, 1
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each with its start and end; where each text begins (n + 1); places within texts."""
    words, at = hashed_words(texts)
    n = len(texts)
    begins = at + 2 * np.arange(n + 1)
    out = np.empty(len(words) + 2 * n, dtype=np.uint64)
    out[begins[:-1]], out[begins[1:] - 1] = START, END
    inner = np.ones(len(out), dtype=bool)
    inner[begins[:-1]] = inner[begins[1:] - 1] = False
    out[inner] = words
    return out, begins, np.arange(len(out)) - np.repeat(begins[:-1], np.diff(begins))


def runs(symbols: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` symbols that end at each place (of no use before place length - 1)."""
    h = np.zeros(len(symbols), dtype=np.uint64)
    for d in range(length - 1, -1, -1):
        shifted = np.concatenate((np.zeros(min(d, len(symbols)), np.uint64), symbols[: max(0, len(symbols) - d)]))
        h = mix(h + shifted)
    return h


def _is_held(ids: pd.Series | list) -> list[bool]:
    import zlib

    return [i is not None and zlib.crc32(str(i).encode()) % FOLD == HELD_OUT for i in ids]


def _summed(counted: list[tuple]) -> tuple:
    keys, *numbers = (np.concatenate(c) for c in zip(*counted, strict=True))
    codes, unique = pd.factorize(keys)
    return (unique, *(np.bincount(codes, x, minlength=len(unique)).astype(np.int64) for x in numbers))


def _in_tasks(step, schema: pa.Schema, most: int = 1_500_000):
    """Sums the counts of a task before they are sent; beyond ``most`` keys it sends and starts anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def send(x: tuple) -> Iterator[pa.RecordBatch]:
            batch = batch_of(schema, [pa.array(x[0].astype(np.uint64).view(np.int64)), *map(pa.array, x[1:])])
            yield from (batch.slice(i, SENT_ROWS) for i in range(0, len(batch), SENT_ROWS))

        for ids, texts in steps(batches):
            held.append(step(ids, texts))
            if len(held) >= 12:
                held = [_summed(held)]
                if len(held[0][0]) > most:
                    yield from send(held.pop())
        if held:
            yield from send(_summed(held))

    return run


def _count_words(ids: list, texts: list[bytes]) -> tuple:
    words, at = hashed_words(texts)
    codes, unique = pd.factorize(words)
    train = np.repeat(~np.array(_is_held(ids)), np.diff(at)).astype(np.float64)
    return unique, np.bincount(codes, train, minlength=len(unique)).astype(np.int64), np.bincount(codes, minlength=len(unique))


def _keys(symbols: np.ndarray, length: int) -> np.ndarray:
    """What stands for the ``length`` symbols that end at each place: the symbol itself, or the run's hash."""
    return symbols if length == 1 else runs(symbols, length)


def _continued(length: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Keys of the runs of ``length`` symbols that a context and a symbol make."""
    return mix((mix(context) if length == 2 else context) + symbol)


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of 64-bit numbers, byte by byte of all, compressed: bytes that are all but equal take no room."""
    head = np.array([len(arrays), *map(len, arrays)], dtype=np.uint64).tobytes()
    body = b"".join(np.ascontiguousarray(x.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T.tobytes() for x in arrays)
    return head + pa.compress(body, codec="zstd", asbytes=True) if body else head


def _unpacked(block: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(block, np.uint64, 1)[0])
    sizes = np.frombuffer(block, np.uint64, count, 8).astype(np.int64)
    total = int(sizes.sum()) * 8
    body = np.frombuffer(pa.decompress(block[8 + 8 * count :], decompressed_size=total, codec="zstd"), np.uint8) if total else np.zeros(0, np.uint8)
    return [np.ascontiguousarray(x.reshape(8, -1).T).view(np.uint64).ravel() for x in np.split(body, np.cumsum(sizes * 8)[:-1])]


def _count_runs(length: int, shorter, frequent, parts: int, most: int = 1_000_000):
    """Counts runs whose both shorter runs pass the filter ``shorter``: (part, block), a part of all contexts in a block
    (see ``_packed``): contexts in order, how many symbols follow each, these (a place among the frequent words, or
    0 and the hash apart), and the counts."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.binary())])

    def summed(held: list[tuple]) -> tuple:
        context, symbol, n = (np.concatenate(c) for c in zip(*held, strict=True))
        codes, unique = pd.factorize(_continued(length, context, symbol))
        first = np.empty(len(unique), dtype=np.int64)
        first[codes] = np.arange(len(codes))
        return context[first], symbol[first], np.bincount(codes, n, minlength=len(unique)).astype(np.int64)

    def send(held: tuple) -> Iterator[pa.RecordBatch]:
        order = np.argsort(held[0])
        context, symbol, n = (x[order] for x in held)
        often = frequent.value[0]
        part = ((context >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        edges = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
        for a, b in zip(edges[:-1], edges[1:]):
            if a < b:
                heads = np.concatenate(([0], np.flatnonzero(context[a + 1 : b] != context[a : b - 1]) + 1))
                own = context[a:b][heads]
                i, known = _found(often, symbol[a:b])
                block = _packed([np.diff(own, prepend=np.uint64(0)), np.diff(heads, append=b - a), np.where(known, i + 1, 0), symbol[a:b][~known], n[a:b]])
                yield batch_of(schema, [pa.array([int(part[a])], pa.int32()), [block]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for ids, texts in steps(batches):
            symbols, _, place = sequences([t for t, out in zip(texts, _is_held(ids), strict=True) if not out])
            keys = _keys(symbols, length - 1)
            inside = _maybe(shorter.value, keys) & (place >= length - 2)
            both = np.flatnonzero(inside[1:] & inside[:-1] & (place[1:] >= length - 1)) + 1
            held.append(summed([(keys[both - 1], symbols[both], np.ones(len(both), np.int64))]))
            if len(held) >= 4:
                held = [summed(held)]
                if len(held[0][0]) > most:
                    yield from send(held.pop())
        if held:
            yield from send(summed(held))

    return run


def _merged(length: int, frequent):
    """(context, symbol, n, inside): the runs of a part that occur ``MIN_COUNT`` times, and how many of its context's occurrences they are."""
    schema = pa.schema([(c, pa.int64()) for c in ("context", "symbol", "n", "inside")])

    def run(group: pa.Table) -> pa.Table:
        often, held = frequent.value[0], []
        for block in group.column("block").to_pylist():
            steps_, follow, place, rare, n = _unpacked(block)
            symbol = np.empty(len(place), dtype=np.uint64)
            known = place > 0
            symbol[known], symbol[~known] = often[place[known].astype(np.int64) - 1] if len(often) else rare[:0], rare
            held.append((np.repeat(np.cumsum(steps_, dtype=np.uint64), follow.astype(np.int64)), symbol, n.astype(np.int64)))
        context, symbol, n = (np.concatenate(c) for c in zip(*held, strict=True))
        codes, unique = pd.factorize(_continued(length, context, symbol))
        first = np.empty(len(unique), dtype=np.int64)
        first[codes] = np.arange(len(codes))
        n = np.bincount(codes, n, minlength=len(unique)).astype(np.int64)
        first, n = first[n >= MIN_COUNT], n[n >= MIN_COUNT]
        context, symbol = context[first], symbol[first]
        codes, unique = pd.factorize(context)
        inside = np.bincount(codes, n, minlength=len(unique)).astype(np.int64)[codes]
        return pa.Table.from_arrays([pa.array(x.view(np.int64)) for x in (context, symbol, n, inside)], schema=schema)

    return run


def _named(length: int):
    """The keys of runs and of their suffixes, from (context, symbol, n, inside, total, wide, mid), mid the suffix of the context."""
    schema = pa.schema([(c, pa.int64()) for c in ("key", "context", "suffix", "n", "inside", "total")] + [("wide", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, symbol, mid = (batch.column(c).to_numpy().view(np.uint64) for c in ("context", "symbol", "mid"))
            suffix = symbol if length == 2 else _continued(length - 1, mid, symbol)
            key = _continued(length, context, symbol)
            yield batch_of(schema, [pa.array(key.view(np.int64)), batch.column("context"), pa.array(suffix.view(np.int64)), *(batch.column(c) for c in ("n", "inside", "total", "wide"))])

    return run


def _bits(keys: DataFrame, tokens: int, also: tuple = ()) -> np.ndarray:
    """A filter that all ``keys`` pass; of a bounded size."""
    least, most = FILTER_BITS
    bits = min(most, max(least, 1 << (max(tokens, 2) // 2).bit_length()))
    at = keys.select(F.expr(f"key & {bits - 1}L").alias("at"))
    found = at.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    for key in also:
        key = int(key) & (bits - 1)
        out[key >> 6] |= np.uint64(1 << (key & 63))
    return out


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bits) * 64 - 1)
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would be among the sorted ``known``, and whether it is there."""
    if not len(known):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return i, known[i] == keys


def _joined(spark: SparkSession, left: DataFrame, right: DataFrame, key: str, tokens: int, then, name: str) -> DataFrame:
    """What ``then`` makes of left joined to right, written: by rounds of keys, so that only a round's rows are moved at once."""
    rounds = min(MOST_ROUNDS, 1 + tokens // ROUND_TOKENS)
    mine = lambda df, i: df.where(F.pmod(F.col(key), F.lit(rounds)) == i) if rounds > 1 else df
    return _by_rounds(spark, (then(mine(left, i).join(mine(right, i), key)) for i in range(rounds)), name)


def _by_rounds(spark: SparkSession, rounds: Iterator[DataFrame], name: str) -> DataFrame:
    """All rows of the rounds, written one round after the other; a round's shuffle files can go before the next."""
    path = f"{shared_dir(spark).rstrip('/')}/lodestrata/{name}-{uuid.uuid4().hex}"
    made().append(path)
    for df in rounds:
        schema = df.schema
        df.write.mode("append").parquet(path)
        del df
        release(spark)
    return spark.read.schema(schema).parquet(path)


def grown(spark: SparkSession, docs: DataFrame, first: DataFrame, depth: int, hot_least: float, frequent, tokens: int) -> tuple[DataFrame, DataFrame]:
    """(key, value, hot) of the tree's runs and contexts, and the keys of other frequent runs.

    first: (key, n, p, hot) of single symbols. A run's value is what it adds as a
    run to what its context gives on, a context's is what it gives on; log10.
    """
    counted, contexts, stashed, before_all = [], [], [], len(made())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // PART_TOKENS)

    def drop(paths: list[str]) -> None:
        drop_stashes(spark, paths)
        release(spark)

    before = first.withColumn("suffix", F.lit(0).cast("long"))
    for length in range(2, depth + 2):
        also = (START, END) if length == 2 else ()
        shorter = spark.sparkContext.broadcast(_bits(before.where(F.col("n") >= MIN_COUNT), tokens, also))
        blocks = in_arrow(docs, _count_runs(length, shorter, frequent, parts), "part int, block binary")
        found = stash(spark, blocks.groupBy("part").applyInArrow(_merged(length, frequent), "context long, symbol long, n long, inside long"), f"runs-{length}")
        done = made()[-1:]
        del blocks
        release(spark)
        of_context = before.select(F.col("key").alias("context"), F.col("n").alias("total"), F.col("hot").alias("wide"), F.col("suffix").alias("mid"))
        named = lambda df: in_arrow(df, _named(length), "key long, context long, suffix long, n long, inside long, total long, wide boolean")  # noqa: B023, E731
        found = _joined(spark, found, of_context, "context", tokens, named, f"named-{length}")
        drop(done)
        done = made()[-1:]
        rest = F.greatest(F.lit(0.0), F.col("total") - F.col("inside")) + PRIOR
        p = (F.col("n") + rest * F.col("before")) / (F.col("total") + PRIOR)
        # of the longest runs no longer ones are made
        kept = ["key", "context", "n", "inside", "total", "wide", "more", *(["suffix", "p"] if length <= depth else [])]
        judged = lambda df: df.withColumn("p", p).withColumn("more", F.log10("p") - F.log10("before")).select(*kept)  # noqa: B023, E731
        found = _joined(spark, found, before.select(F.col("key").alias("suffix"), F.col("p").alias("before")), "suffix", tokens, judged, f"counted-{length}")
        drop(done)
        found = found.withColumn("hot", F.col("n") >= hot_least)
        own = found.groupBy("context").agg(F.sum(F.col("n") * F.col("more")).alias("gain"), *(F.first(c).alias(c) for c in ("inside", "total", "wide")))
        on = F.log10(rest / (F.col("total") + PRIOR))
        own = own.withColumn("on", on).withColumn("gain", (F.col("gain") + (rest - PRIOR) * F.col("on")) * float(np.log(10)))
        contexts.append(stash(spark, own.select("context", "on", F.col("wide").alias("hot"), "gain"), f"gains-{length}"))
        stashed.append(made()[-2:])
        counted.append(found)
        before = found
        release(spark)
    values, frequent_runs, last = [], [], []
    keep_also = None
    for d in range(depth - 1, -1, -1):
        keep = contexts[d].where(F.col("gain") >= MIN_GAIN).select("context")
        if keep_also is not None:  # the suffixes of kept contexts stay
            keep = keep.union(keep_also).distinct()
        keep = stash(spark, contexts[d].join(keep, "context", "left_semi").select("context", "on", "hot"), f"kept-{d}")
        if d:
            shorter_runs = counted[d - 1].select("key", "suffix")
            keep_also = stash(spark, shorter_runs.join(keep.select(F.col("context").alias("key")), "key", "left_semi").select(F.col("suffix").alias("context")).distinct(), f"suffixes-{d}")
        values.append(stash(spark, counted[d].join(keep.select("context", "on"), "context").select("key", (F.col("more") - F.col("on")).alias("value"), "hot"), f"run-values-{d}"))
        last.append(made()[-1])
        values.append(stash(spark, keep.select(F.col("context").alias("key"), F.col("on").alias("value"), "hot"), f"context-values-{d}"))
        last.append(made()[-1])
        frequent_runs.append(stash(spark, counted[d].where("hot").select("key"), f"frequent-{d}"))
        last.append(made()[-1])
        del keep
        drop([x for x in made()[before_all:] if x in stashed[d]])
    union = lambda x: x[0] if len(x) == 1 else x[0].unionAll(union(x[1:]))
    drop([x for x in made()[before_all:] if x not in last])
    return union(values), union(frequent_runs)


def _scores(hot, likely, frequent, end: float, depth: int):
    """Per text: the base's part of frequent words, the tree's gain by frequent runs, and the hashes of its other words and of the runs that may have values."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("gain", pa.float64()), ("known", pa.int64()), ("part", pa.float64()), ("rest", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 36
        keys, known, logs = frequent.value
        hot_keys, hot_values = hot.value
        for ids, texts in steps(batches):
            symbols, begins, place = sequences(texts)
            codes, unique = pd.factorize(symbols)
            i, found = _found(keys, unique)
            outer = (unique == START) | (unique == END)
            value = np.where(found, logs[i], 0.0) if len(keys) else np.zeros(len(unique))
            value[unique == END] = end
            seen = np.where(found, known[i], 0) if len(keys) else np.zeros(len(unique), dtype=np.int64)
            gain, rest, asked = np.zeros(len(symbols)), [symbols], [(~found & ~outer)[codes]]
            for length in range(1, depth + 2):
                h = _keys(symbols, length)
                at = np.flatnonzero(_maybe(likely.value, h) & (place >= length - 1))
                own, of = pd.factorize(h[at])
                i, found = _found(hot_keys, of)
                if len(hot_keys):
                    gain[at] += np.where(found, hot_values[i], 0.0)[own]
                if length > 1:
                    mask = np.zeros(len(symbols), dtype=bool)
                    mask[at[~found[own]]] = True
                    rest.append(h)
                    asked.append(mask)
            sums = lambda x: np.add.reduceat(x, begins[:-1])
            asked = np.stack(asked, axis=1)
            counts = sums(asked.sum(axis=1))
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(np.stack(rest, axis=1)[asked].view(np.int64)))
            rows = serial + np.arange(len(ids))
            serial += len(ids)
            yield batch_of(schema, [pa.array(rows), ids, pa.array(np.diff(begins) - 1), pa.array(sums(gain)), pa.array(sums(seen[codes])), pa.array(sums(value[codes])), rest])

    return run


def scored(spark: SparkSession, docs: DataFrame, min_share: float = MIN_SHARE, depth: int = DEPTH) -> DataFrame:
    docs, before = text_docs(docs), len(made())
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLD == HELD_OUT, F.lit(False))
    three = pa.schema([("key", pa.int64()), ("train", pa.int64()), ("every", pa.int64())])
    words = in_arrow(docs, _in_tasks(_count_words, three), "key long, train long, every long").groupBy("key").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))
    words = stash(spark, words, "words")
    n_train = docs.where(~held).count()
    sums = words.agg(F.sum("train").alias("n"), F.count_if(F.col("train") > 0).alias("v"), F.sum("every").alias("every")).first()
    total, distinct, every = (sums.n or 0) + n_train, (sums.v or 0) + bool(n_train), sums.every or 0  # the end is a token
    below = total + 0.5 * (distinct + 1)
    end = float(np.log10((n_train + 0.5) / below))
    least = max(2.0, every * min_share)
    often = words.where(F.col("every") >= least).select("key", "train").toPandas()
    keys = often.key.to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    train = often.train.to_numpy(dtype=np.int64)[order]
    keys = keys[order]
    frequent = spark.sparkContext.broadcast((keys, (train > 0).astype(np.int64), np.log10((train + 0.5) / below)))

    known = ((START, n_train), (END, n_train))
    p = (F.col("n") + 0.5) / F.lit(below)
    first = words.where("train > 0").select("key", F.col("train").alias("n"), (F.col("every") >= least).alias("hot")).unionAll(
        spark.createDataFrame([(int(k.view(np.int64)), n, True) for k, n in known], "key long, n long, hot boolean")
    ).select("key", "n", p.alias("p"), "hot")
    values, runs_known = grown(spark, docs, first, depth, max(float(MIN_COUNT), total * HOT_SHARE), frequent, total)
    often = values.where("hot").select("key", "value").unionAll(runs_known.select("key", F.lit(0.0).alias("value"))).groupBy("key").agg(F.sum("value").alias("value")).toArrow()
    keys = often["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    hot = spark.sparkContext.broadcast((keys[order], often["value"].to_numpy()[order]))
    likely = spark.sparkContext.broadcast(_bits(values, total))
    release(spark)

    value = F.log10((F.col("train") + 0.5) / F.lit(below))
    rare = words.where(F.col("every") < least).select("key", value.alias("value"), (F.col("train") > 0).cast("long").alias("is_known"), F.lit(0.0).alias("adds"))
    rare = rare.unionAll(values.where("not hot").select("key", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("is_known"), F.col("value").alias("adds")))
    rare = rare.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("value", "is_known", "adds")))
    # dealt by key once, for all rounds of texts; all else that was written can go
    rare = stash(spark, rare.withColumnRenamed("key", "rare_key"), "rare", "rare_key").hint("merge")
    drop_stashes(spark, made()[before:-1])
    release(spark)

    def of_texts(docs: DataFrame) -> DataFrame:
        part = in_arrow(docs, _scores(hot, likely, frequent, end, depth), "row long, doc_id long, n_tokens long, gain double, known long, part double, rest array<long>")
        # each text is one entry without a key, which holds its own sums, and one entry a hash; all go through one join and one sum
        entry = part.select("*", F.explode(F.concat(F.array(F.lit(None).cast("long")), "rest")).alias("key"))
        own = F.col("key").isNull()
        entry = entry.select("row", own.alias("own"), F.coalesce("key", F.xxhash64("row")).alias("key"), *(F.when(own, F.col(c)).alias(c) for c in ("doc_id", "n_tokens", "gain", "known", "part")))
        sums = entry.join(rare, (F.col("key") == F.col("rare_key")) & ~F.col("own"), "left").where("own or rare_key is not null").groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum(F.coalesce("part", "value", F.lit(0.0))).alias("base"),
            F.sum(F.coalesce("known", "is_known", F.lit(0))).alias("known"), F.sum(F.coalesce("gain", "adds", F.lit(0.0))).alias("gain"),
        )
        return sums.select(
            "doc_id", held.alias("held_out"), "n_tokens", (F.col("known") + int(n_train > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
            F.col("base").alias("base_score"), (F.col("base") + F.col("gain")).alias("score"),
        )

    rounds = 1 + every // TEXT_TOKENS
    if rounds == 1:
        return of_texts(docs)
    mine = lambda i: docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == i)
    return _by_rounds(spark, (of_texts(mine(i)) for i in range(rounds)), "scores")
