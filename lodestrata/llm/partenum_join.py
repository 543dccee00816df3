"""N-gram Jaccard self join by PartEnum signatures.

Each text becomes the set of its distinct word shingles. Two sets link when
``100 * |intersection| >= percent * |union|``. Sets are put into size bands; in a
band two linked sets differ in at most ``k`` elements. The feature domain (the
64-bit shingle hashes) is cut into ``n1`` ranges of ``n2`` parts each. At most
``k`` differences leave at least ``spare + 1`` ranges with at most ``k2``
differences, so in each of these some ``n2 - k2`` parts hold the same elements in
both sets; each such subset of parts, with its elements, is a signature. Of the
ranges a set leaves out its ``spare`` thinnest (by the size of the thinnest
subset): a range on which both sets agree can't be left out by either unless it
is among the ``spare`` thinnest, so one agreed range always stays. With
``k2 = 0`` a range is its own subset, and sizes are equal on both sides, which
makes the argument exact; ranges are only left out in that case.

Sets that are equal collapse to one representative before anything is compared.
Within a bucket (one signature) every member is compared with the smallest
member; buckets whose members are then still in different components are
compared across components, in blocks (see ``_late_links``). No bucket is capped.

Edge cases: null and blank texts have empty sets, ``n_shingles`` 0, and link with
nothing, not even each other; texts with fewer words than a shingle have one
element, the whole sequence; equal texts link; rows that repeat a doc_id stay
separate rows; rows with null doc_id are kept, and never are a component's id
unless alone (then null). Texts of any length are one set. An empty table gives an
empty result. Only the key and text columns are read, so other columns can't clash.
Elements and sets are told apart by 64-bit hashes. Links between different sets are
decided by their elements; sets whose own hashes are equal count as equal, which is
wrong for some pair of 10^9 different sets with a chance under 3 %.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import batch_of, components, empty, in_arrow, release, settle, spread_join, stash, steps, text_docs, text_key, without
from lodestrata.llm.hashing import hashed_words, mix, shingles

#: Largest size of a band over its smallest.
BAND_RATIO = 1.4
#: A block of a cluster holds at most so many sets, and so many shingles unless it is one set; where only parities are
#: compared, which are a fortieth of the elements, so many.
BLOCK_SETS = 256
BLOCK_ITEMS = 256 * 1024
PARITY_SETS = 4096
PARITY_ITEMS = 4096 * 1024
#: Shingles whose columns are multiplied at once.
COLUMNS = 4096
_SKETCH = pa.schema([("doc_id", pa.int64()), ("t", pa.binary()), ("n", pa.int64()), ("h", pa.int64()), ("par", pa.binary())])
_SIGNED = pa.schema([("h", pa.int64()), ("sig", pa.int64())])
_SETS = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("items", pa.list_(pa.int64()))])


def bands(ratio: float = BAND_RATIO) -> np.ndarray:
    """Smallest size of each band."""
    lows = [1]
    while lows[-1] < 2**40:
        lows.append(max(lows[-1] + 1, int(lows[-1] * ratio) + 1))
    return np.array(lows, dtype=np.int64)


def plan(low: int, high: int, percent: int) -> tuple[int, int, int, int, int]:
    """(k, n1, n2, k2, spare) for pairs whose larger set has ``low`` to ``high`` elements."""
    k = 2 * high * (100 - percent) // (100 + percent)
    least = max(1, -(-low * percent // 100))
    if k < 8:  # small sets: one error per range is allowed, subsets of two of three parts
        return k, k // 2 + 1, 3, 1, 0
    spare = 1
    for _ in range(8):
        mean = least / (k + 1 + spare)
        thin = (k + 1 + spare) * math.exp(-mean) * (1 + mean)
        spare = int(min(1 + thin + math.sqrt(thin), 0.4 * (k + 1)))
    return k, k + 1 + spare, 1, 0, spare


def signatures(items: np.ndarray, lows: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one sorted set of 64-bit hashes."""
    n = len(items)
    if not n:
        return items
    band = int(np.searchsorted(lows, n, side="right")) - 1
    out = []
    for j in range(band, len(lows) - 1):  # a larger partner signs for its own band
        if 100 * n < percent * int(lows[j]) and j > band:
            break
        k, n1, n2, k2, spare = plan(int(lows[j]), int(lows[j + 1]) - 1, percent)
        if k == 0:
            continue  # only equal sets can link
        # the top 32 bits choose range and part, so both are runs of the sorted set
        parts = n1 * n2
        edges = np.searchsorted(items >> np.uint64(32), ((np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) + np.uint64(parts - 1)) // np.uint64(parts))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(items + np.uint64(j)))))
        values, sizes = (sums[edges[1:]] - sums[edges[:-1]]).reshape(n1, n2), np.diff(edges).reshape(n1, n2)
        label = np.arange(n1, dtype=np.uint64) * np.uint64(64) + np.uint64(j << 40)
        if k2 == 0:
            own = mix(mix(label) + values[:, 0] + sizes[:, 0].astype(np.uint64))
            if spare:
                order = np.lexsort((own, sizes[:, 0]))
                own = own[order[spare:]]
            out.append(own)
        else:
            for i, subset in enumerate(combinations(range(n2), n2 - k2)):
                total, size = values[:, list(subset)].sum(axis=1, dtype=np.uint64), sizes[:, list(subset)].sum(axis=1)
                out.append(mix(mix(label + np.uint64(i + 1)) + total + size.astype(np.uint64)))
    return np.concatenate(out) if out else items[:0]


def parities(items: np.ndarray) -> bytes:
    """For each residue of the elements, whether an odd number has it; about a fortieth of the set's size.

    Sets differ in at least as many elements as these bits do, so a pair whose bits differ
    too much can't link. Moduli are powers of two, so the longer of two folds to the shorter.
    """
    m = 1 << max(6, (len(items) - 1).bit_length())
    odd = np.bincount((items & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _digest(items: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(items).sum(dtype=np.uint64) + np.uint64(len(items))], dtype=np.uint64)).view(np.int64)[0])


def sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in steps(batches):
            words, at = hashed_words(texts)
            items = [shingles(words[at[i] : at[i + 1]], width) for i in range(len(ids))]
            yield batch_of(_SKETCH, [ids, [hashlib.sha256(t).digest()[:16] for t in texts], [len(s) for s in items], [_digest(s) for s in items], [parities(s) for s in items]])

    return run


def _signed(width: int, percent: int):
    """A row for each signature of a set. They are made again rather than kept: they outweigh the texts."""
    lows = bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task sends the signatures of equal sets once
        for ids, texts in steps(batches):
            words, at = hashed_words(texts)
            hs, sigs = [], []
            for i in range(len(ids)):
                items = shingles(words[at[i] : at[i + 1]], width)
                h = _digest(items)
                if h not in seen:
                    seen.add(h)
                    hs.append(h)
                    sigs.append(signatures(items, lows, percent))
            if hs:
                owner = np.repeat(np.array(hs, dtype=np.int64), [len(s) for s in sigs])
                yield batch_of(_SIGNED, [pa.array(owner), pa.array(np.concatenate(sigs).view(np.int64))])

    return run


def _sets(width: int):
    """Sets of (h, text), of texts whose set has this digest; a task gives each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for hs, texts in steps(batches):
            words, at = hashed_words(texts)
            found: dict[int, np.ndarray] = {}
            for i, h in enumerate(hs):
                items = shingles(words[at[i] : at[i + 1]], width)
                if len(items) and h not in seen and _digest(items) == h:
                    seen.add(h)
                    found[h] = items
            if found:
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in found.values()]))).astype(np.int32)
                values = pa.array(np.concatenate(list(found.values())).view(np.int64))
                yield batch_of(_SETS, [list(found), [len(s) for s in found.values()], pa.ListArray.from_arrays(pa.array(offsets), values)])

    return run


def _near(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) those that sizes and parities don't rule out."""
    size, par = facts.select("h", "n"), facts.select("h", "par")
    sized = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    both = sized.join(par.toDF("b", "pb"), "b").join(par.toDF("a", "pa"), "a").select("a", "b", "na", "nb", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                x, y = np.frombuffer(x, np.uint64)[None, :], np.frombuffer(y, np.uint64)[None, :]
                words = min(x.shape[1], y.shape[1])
                odd = int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum())
                keep.append(odd * (100 + percent) <= (na + nb) * (100 - percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return in_arrow(both, run, "a long, b long")


def _fetched(docs: DataFrame, facts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(h, n, items) of the sets named by wanted(h), made again from a text that has them.

    Each set is named by one row's doc_id and text. The texts are joined by merging at every size; rows that repeat both
    meet in one task, which gives a set once, and a set that comes twice adds no link."""
    ids = facts.join(wanted.distinct(), "h").select(F.col("first.doc_id").alias("own_id"), F.col("first.t").alias("own_t"), "h")
    texts = docs.withColumn("t", text_key()).join(ids.hint("merge"), docs.doc_id.eqNullSafe(ids.own_id) & (F.col("t") == F.col("own_t"))).select("h", "text")
    return in_arrow(texts, _sets(width), "h long, n long, items array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) those whose sets are similar enough."""
    one, two = (sets.select(F.col("h").alias(x), F.col("n").alias(f"n{x}"), F.col("items").alias(f"i{x}")) for x in "ab")
    both = pairs.join(two, "b").join(one, "a")
    common = F.size(F.array_intersect("ia", "ib"))
    return both.withColumn("c", common).where(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * percent).select("a", "b")


def _blocks(spark: SparkSession, members: DataFrame, side: DataFrame, percent: int, most_sets: int = BLOCK_SETS, most_items: int = BLOCK_ITEMS) -> DataFrame:
    """members(cluster, h, root, n) with the columns of ``side``, for each two blocks to compare (cluster, i, j)."""
    members = members.withColumn("block", F.expr(f"(sum(n + {most_items // most_sets}) over (partition by cluster order by root, h rows unbounded preceding)) div {most_items}"))
    members = settle(spark, members)
    blocks = members.groupBy("cluster", "block").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    one, two = blocks.toDF("cluster", "i", "r0", "r1", "n0", "n1"), blocks.toDF("cluster", "j", "s0", "s1", "m0", "m1")
    pairs = one.join(two, "cluster").where(f"i <= j and not (r0 = r1 and s0 = s1 and r0 = s0) and n1 * 100 >= m0 * {percent} and m1 * 100 >= n0 * {percent}").select("cluster", "i", "j")
    pairs = settle(spark, pairs)
    sides = pairs.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return sides.join(members, ["cluster", "block"]).join(side, "h").drop("block")


def _late_links(spark: SparkSession, docs: DataFrame, open_: DataFrame, facts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): components that links between members of open buckets join.

    Only sets that share a bucket can link, so the buckets of one smallest open member
    (a cluster) are compared for themselves: buckets chain into one another by chance, and
    what they chain into takes in ever more of all sets as these grow in number. A
    cluster is laid out in blocks of bounded size, by component; each two blocks that
    hold more than one component and whose sizes are near enough are compared in one
    task as a whole, so what moves grows with members times blocks, and only links come
    out. That is done with parities first, then with the elements of the members they
    leave; clusters that are left the same members are one.
    """
    members = settle(spark, open_.join(facts.select("h", "n"), "h").select("cluster", "h", "root", "n"))
    work = _blocks(spark, members, facts.select("h", "par"), percent, PARITY_SETS, PARITY_ITEMS).select("cluster", "i", "j", "h", "root", "n", "par")
    close = stash(spark, work.groupBy("cluster", "i", "j").applyInArrow(_block_close(percent), "cluster long, h long").distinct(), "close")
    if close.isEmpty():
        return empty(spark, "a long, b long")
    sets = stash(spark, _fetched(docs, facts, close.select("h"), width).select("h", "items"), "late-sets")
    release(spark)
    left = _merged_clusters(members.join(close, ["cluster", "h"]))
    work = _blocks(spark, left, sets, percent).select("cluster", "i", "j", "h", "root", "items")
    return work.groupBy("cluster", "i", "j").applyInArrow(_block_links(percent), "a long, b long").distinct()


def _merged_clusters(members: DataFrame) -> DataFrame:
    """members(cluster, h, root, n), clusters of equal members as one. They are told apart by 64 bits; two of one number
    are compared together, which loses no link."""
    same = F.expr("xxhash64(bit_xor(xxhash64(h)) over (partition by cluster), bit_xor(xxhash64(h, 1)) over (partition by cluster), count(*) over (partition by cluster))")
    return members.select(same.alias("cluster"), "h", "root", "n").distinct()


def _block_close(percent: int):
    """The members that parities leave a partner of another component in their cluster."""
    schema = pa.schema([("cluster", pa.int64()), ("h", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        h, root, n = (np.array(group.column(c).to_pylist(), dtype=np.int64) for c in ("h", "root", "n"))
        bits = group.column("par").to_pylist()
        words = np.array([len(x) // 8 for x in bits])
        classes = {w: (at := np.flatnonzero(words == w), np.stack([np.frombuffer(bits[i], np.uint64) for i in at])) for w in np.unique(words)}
        found = np.zeros(len(h), dtype=bool)
        for w, (at, rows) in classes.items():
            for v, (to, others) in classes.items():
                if v < w or 100 * n[at].max() < percent * n[to].min():
                    continue
                folded = _folded(others, rows.shape[1])
                for i, row in zip(at, rows, strict=True):
                    odd = np.bitwise_count(folded ^ row).sum(axis=1, dtype=np.int64)
                    ok = (odd * (100 + percent) <= (n[i] + n[to]) * (100 - percent)) & (root[to] != root[i])
                    if ok.any():
                        found[i] = True
                        found[to[ok]] = True
        return pa.Table.from_arrays([group.column("cluster").combine_chunks().filter(pa.array(found)), pa.array(h[found], pa.int64())], schema=schema)

    return run


def _block_links(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        roots, lists = group.column("root").to_pylist(), group.column("items").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        _, column, df = np.unique(lists.values.to_numpy()[lists.offsets[0].as_py() :][: len(owner)], return_inverse=True, return_counts=True)
        shared = df[column] > 1
        number = np.cumsum(df > 1) - 1
        owner, column = owner[shared], number[column[shared]]
        common = np.zeros((len(sizes), len(sizes)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for begin in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
            x, y = np.searchsorted(column, (begin, begin + COLUMNS))
            part = np.zeros((len(sizes), COLUMNS), dtype=np.float32)
            part[owner[x:y], column[x:y] - begin] = 1
            common += part @ part.T
        linked = np.triu(common * 100 >= (sizes[:, None] + sizes[None, :] - common) * percent, 1)
        parent = {r: r for r in roots}

        def top(r: int) -> int:
            while parent[r] != r:
                r = parent[r]
            return r

        found = []
        for x, y in zip(*np.nonzero(linked), strict=True):
            a, b = top(roots[x]), top(roots[y])
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((roots[x], roots[y]))
        return pa.Table.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def _grouped(spark: SparkSession, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, t, n, and the first row of its group (none of texts without words) for every row of docs(doc_id, text)."""
    sketch = stash(spark, in_arrow(docs, sketches(width), "doc_id long, t binary, n long, h long, par binary"), "sketch")
    total = sketch.count()
    # of each different set, the first row that has it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("first")
    every = stash(spark, sketch.where("n > 0").groupBy("h").agg(F.min("n").alias("n"), F.count("*").alias("rows"), first, F.min("par").alias("par")), "facts")
    signed = in_arrow(docs, _signed(width, percent), "h long, sig long").withColumn("c", F.expr("min(h) over (partition by sig)")).withColumn("m", F.expr("max(h) over (partition by sig)"))
    shared = stash(spark, signed.where("c < m").select("sig", "h", "c"), "shared")
    del signed
    release(spark)
    facts = stash(spark, every.join(shared.select("h").distinct(), "h").select("h", "n", "first", "par"), "shared-facts")
    star = shared.where("h != c").select(F.col("c").alias("a"), F.col("h").alias("b")).distinct()
    near = stash(spark, _near(star, facts, percent), "near")
    release(spark)
    sets = stash(spark, _fetched(docs, facts, near.select(F.col("a").alias("h")).union(near.select("b")), width), "sets")
    release(spark)
    links = stash(spark, _verified(near, sets, percent), "links")
    root = components(spark, links)
    # each member has been compared with its bucket's smallest, so what is open is between the others
    placed = shared.where("h != c").join(root.withColumnRenamed("node", "h"), "h", "left").select("sig", "h", F.coalesce("root", "h").alias("root"))
    over = placed.withColumn("least", F.expr("min(root) over (partition by sig)")).withColumn("most", F.expr("max(root) over (partition by sig)")).withColumn("cluster", F.expr("min(h) over (partition by sig)"))
    open_ = stash(spark, over.where("least < most").select("cluster", "h", "root").distinct(), "open")
    late = stash(spark, _late_links(spark, docs, open_, facts, width, percent), "late")
    if not late.isEmpty():
        nodes = root.select("root").union(late.select("a")).union(late.select("b")).distinct()
        wider = nodes.join(components(spark, late).toDF("root", "wide"), "root", "left").select("root", F.coalesce("wide", "root").alias("wide"))
        of_node = root.unionByName(nodes.select(F.col("root").alias("node"), "root")).distinct()
        root = settle(spark, of_node.join(wider, "root").select("node", F.col("wide").alias("root")))
    # sets to groups, groups to their first rows, and back to rows; large groups and sets of many rows are broadcast
    linked = stash(spark, root.withColumnRenamed("node", "h").join(every.select("h", "rows", "first"), "h"), "linked")
    group = linked.groupBy("root").agg(F.min("first").alias("group_first"), F.count("*").alias("n"))
    of_set = spread_join(linked.select("root", "h"), group, "root", linked.count()).select("h", "group_first")
    of_set = stash(spark, every.select("h", "first", F.col("rows").alias("n")).join(of_set, "h", "left").select("h", F.coalesce("group_first", "first").alias("first"), "n"), "first")
    return spread_join(sketch.select("doc_id", "t", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("h")).alias("h")), of_set, "h", total)


def jaccard_components(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    return _grouped(spark, text_docs(docs), width, percent).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def first_rows(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Of each group the row with the smallest doc_id; of equal doc_ids that with the smallest text key, and of rows equal
    in both one (the first as JSON). Rows without id come after those with one; rows without words all stay."""
    rows = stash(spark, _grouped(spark, text_docs(docs), width, percent), "groups")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    left = without(docs, rows.where(F.col("first").isNotNull() & ~own).select("doc_id", "t").distinct())
    again = stash(spark, rows.where(F.col("first").isNotNull() & own).groupBy("doc_id", "t").count().where("count > 1").select("doc_id", "t"), "again")
    if again.isEmpty():
        return left
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    keyed = docs.select(row.alias("row"), F.col("doc_id").try_cast("long").alias("own_id"), text_key(F.coalesce("text", F.lit(""))).alias("own_t"))
    once = keyed.join(again, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_t") == F.col("t")), "left_semi").groupBy("own_id", "own_t").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return without(left, again).unionByName(once.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns))))
