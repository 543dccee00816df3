"""Fixpoints with set semantics: reachability from roots and transitive closure, within programs.

No path leaves a program, so programs are dealt out and each is walked in memory, streamed in Arrow batches sorted
by program. Programs of over ``MAX_EDGES`` edges are counted first and go through a loop of joins instead, whatever
the others do, so that no task holds an unbounded graph.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges up to which a program is walked in one task.
MAX_EDGES = 200_000
#: Nodes up to which a closure is a matrix of bits; beyond, each node is walked from.
MATRIX_NODES = 2_000
#: Pairs that a batch of a closure holds.
BATCH_PAIRS = 200_000
#: Parts of a growing relation that are kept apart before they are written as one.
PARTS = 8
#: Folders that ``settle`` wrote, and the names of those that are tables.
SETTLED: list[str] = []
TABLES: dict[str, str] = {}


def shared_folder(df: DataFrame) -> str:
    """The folder that the session names for all executors; a temporary one only where it names none and all run here."""
    session = df.sparkSession
    named = session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", session.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-"))
        named = session.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes Parquet in the shared folder and reads it again, so that readers prune columns."""
    path = f"{shared_folder(df)}/lodestrata/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    SETTLED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_dealt(rounds: Iterable[DataFrame], parts: int) -> DataFrame:
    """As ``settle``, of one round of rows after the other; rows stay dealt by p, so that what goes by program needn't move
    them again. Shuffle files of a round that was written can go before the next: Spark deletes them once the driver's
    garbage collectors have seen that nothing refers to them."""
    path = None
    for df in rounds:
        session = df.sparkSession
        if path is None:
            path = f"{shared_folder(df)}/lodestrata/settled-{uuid.uuid4().hex}"
            TABLES[path] = f"lodestrata_{uuid.uuid4().hex}"
            SETTLED.append(path)
        df.repartition(parts, "p").write.mode("append").bucketBy(parts, "p").format("parquet").option("path", path).saveAsTable(TABLES[path])
        del df
        gc.collect()
        session.sparkContext._jvm.System.gc()
    return session.table(TABLES[path])


def forget(spark, count: int | None = None) -> None:
    """Deletes all that ``settle`` wrote, or the last ``count``; what reads it must be done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for _ in range(len(SETTLED) if count is None else count):
        if SETTLED[-1] in TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {TABLES.pop(SETTLED[-1])}")
        path = jvm.org.apache.hadoop.fs.Path(SETTLED.pop())
        path.getFileSystem(conf).delete(path, True)


def _by_program(df: DataFrame, function: Callable[[int, pa.RecordBatch], Iterator[list[pa.Array]]], schema: str) -> DataFrame:
    """Calls ``function`` with each program's rows and gathers the columns it gives behind p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def finished() -> Iterator[pa.RecordBatch]:
            for columns in function(now, pa.Table.from_batches(held).combine_chunks()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), now), pa.int64()), *columns], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            p = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            for a, b in zip(edges, edges[1:]):
                if held and p[a] != now:
                    yield from finished()
                    held = []
                now = p[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from finished()

    names = [c.split()[0] for c in schema.split(", ")]
    return df.repartition("p").sortWithinPartitions("p").mapInArrow(run, schema)


def _codes(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The different strings of the columns, and each column as places among them; null is -1."""
    coded = pa.chunked_array([c for x in columns for c in x.chunks], pa.string()).combine_chunks()
    coded = (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
    places = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return coded.dictionary, np.split(places, np.cumsum([len(x) for x in columns])[:-1])


def _successors(a: np.ndarray, b: np.ndarray) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for x, y in zip(a.tolist(), b.tolist()):
        found.setdefault(x, []).append(y)
    return found


def _closed(_: int, rows: pa.Table) -> Iterator[list[pa.Array]]:
    names, (a, b) = _codes(rows.column("v1"), rows.column("v2"))
    if len(names) <= MATRIX_NODES:
        reach = np.zeros((len(names), len(names)), dtype=bool)
        reach[a, b] = True
        for k in range(len(names)):
            reach[reach[:, k]] |= reach[k]
        x, y = np.nonzero(reach)
        for i in range(0, len(x), BATCH_PAIRS):
            yield [names.take(pa.array(x[i : i + BATCH_PAIRS])), names.take(pa.array(y[i : i + BATCH_PAIRS]))]
        return
    after = _successors(a, b)
    for start, found in after.items():
        seen, stack = set(), list(found)
        while stack:
            if (n := stack.pop()) not in seen:
                seen.add(n)
                stack += after.get(n, ())
        yield [names.take(pa.array(np.full(len(seen), start))), names.take(pa.array(sorted(seen)))]


def _reached(_: int, rows: pa.Table) -> Iterator[list[pa.Array]]:
    """Rows (c1, c2, v): edges, and roots where c2 is null; what is reached with each v."""
    names, (a, b, v) = _codes(rows.column("c1"), rows.column("c2"), rows.column("v"))
    root = b < 0
    after = _successors(a[~root], b[~root])
    seen, stack = set(), list(zip(a[root].tolist(), v[root].tolist()))
    while stack:
        if (state := stack.pop()) not in seen:
            seen.add(state)
            stack += [(n, state[1]) for n in after.get(state[0], ())]
    found = sorted(seen)
    yield [names.take(pa.array([c for c, _ in found], pa.int64())), names.take(pa.array([x if x >= 0 else None for _, x in found], pa.int64()))]


def _split(df: DataFrame, large: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    return (df, None) if large is None else (df.join(large, "p", "left_anti"), df.join(large, "p", "left_semi"))


def _large(edges: DataFrame) -> DataFrame | None:
    found = settle(edges.groupBy("p").count().where(F.col("count") > MAX_EDGES).select("p"))
    return None if found.isEmpty() else found


def transitive_closure(pairs: DataFrame, strategy: str | None = None) -> DataFrame:
    """All (p, v1, v2) with a path of one or more ``pairs(p, v1, v2)``. ``strategy`` (grouped, delta) makes one way take
    all programs; otherwise each goes by its size."""
    pairs = settle(pairs.select("p", "v1", "v2"))
    small, rest = _split(pairs, _large(pairs)) if strategy is None else (pairs, None) if strategy == "grouped" else (None, pairs)
    out = None if small is None else _by_program(small, _closed, "p long, v1 string, v2 string")
    if rest is None:
        return out
    base = settle(rest.select("p", F.col("v1").alias("m"), "v2").distinct())
    fresh = settle(rest.distinct())
    grown = _grown(fresh, lambda new: new.select("p", "v1", F.col("v2").alias("m")).join(base, ["p", "m"]).select("p", "v1", "v2"))
    return grown if out is None else out.unionByName(grown)


def reachable(roots: DataFrame, edges: DataFrame, strategy: str | None = None) -> DataFrame:
    """(p, c) of roots(p, c) and what edges(p, c1, c2) lead to from there; with a third column v in roots, (p, c, v): each
    v goes its own ways."""
    with_v = "v" in roots.columns
    roots = settle(roots.select("p", "c", F.col("v") if with_v else F.lit(None).cast("string").alias("v")))
    edges = settle(edges.select("p", "c1", "c2"))
    large = _large(edges) if strategy is None else None
    (small_r, rest_r), (small_e, rest_e) = _split(roots, large), _split(edges, large)
    if strategy == "delta":
        small_r, rest_r, rest_e = None, roots, edges
    out = None
    if small_r is not None:
        both = small_r.select("p", F.col("c").alias("c1"), F.lit(None).cast("string").alias("c2"), "v").unionByName(small_e.withColumn("v", F.lit(None).cast("string")))
        out = _by_program(both, _reached, "p long, c string, v string")
    if rest_r is not None:
        step = lambda new: new.withColumnRenamed("c", "c1").join(rest_e, ["p", "c1"]).select("p", F.col("c2").alias("c"), "v")
        grown = _grown(settle(rest_r.distinct()), step)
        out = grown if out is None else out.unionByName(grown)
    return out if with_v else out.select("p", "c")


def _grown(first: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``first`` and all that ``step`` makes of what is new, round after round; each round writes only what it adds."""
    parts, fresh = [first], first
    union = lambda found: found[0] if len(found) == 1 else found[0].unionByName(union(found[1:]))
    while not fresh.isEmpty():
        known, made = union(parts), step(fresh).distinct()
        same = [made[c].eqNullSafe(known[c]) for c in made.columns]
        fresh = settle(made.join(known, same, "left_anti"))
        parts = [settle(known), fresh] if len(parts) >= PARTS else [*parts, fresh]
    return union(parts)
