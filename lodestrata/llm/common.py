"""Shared plumbing: table access, shared storage, batches bounded by bytes, components.

Nothing here keeps state on a single machine: intermediate tables go to the
folder named by ``spark.checkpoint.dir`` through Spark's own writers.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step works on; longer texts stand alone.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is named and all run on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        found = spark.sparkContext.getCheckpointDir()
        if found is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-"))
            found = spark.sparkContext.getCheckpointDir()
        return found
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Paths that ``stash`` wrote in this thread of work, so that callers who know that they are done with them can drop them.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
#: The names of those that are tables.
_TABLES: dict[str, str] = {}


def made() -> list[str]:
    if _MADE.get() is None:
        _MADE.set([])
    return _MADE.get()


def drop_stashes(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables through Spark's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in list(paths):
        if p in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(p)}")
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in made():
            made().remove(p)


def stash(spark: SparkSession, df: DataFrame, name: str, bucket: str | None = None) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it again. With ``bucket`` rows stay
    dealt by that column, as the session deals shuffles, so that joins by it needn't move them."""
    path = f"{shared_dir(spark).rstrip('/')}/lodestrata/{name}-{uuid.uuid4().hex}"
    made().append(path)
    if bucket is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    _TABLES[path] = f"lodestrata_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), bucket).format("parquet").option("path", path).saveAsTable(_TABLES[path])
    return spark.table(_TABLES[path])


def text_key(text: Column | str = "text") -> Column:
    """What stands for a text where only equal texts may share it: half of its SHA-256, 16 bytes."""
    return F.unhex(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32))


#: Keys that more than such a part of all rows have are fewer than this, so they can be broadcast.
HOT = 1000


def spread_join(rows: DataFrame, known: DataFrame, key: str, total: int) -> DataFrame:
    """Left join of ``rows`` to ``known(key, n, ...)``, one row a key, n the number of rows that have it. Keys with over a
    ``HOT``-th of ``total`` are joined by broadcast, so that no task gets all rows of one. ``rows`` is read twice."""
    hot = known.where(f"n > 1 and n * {HOT} > {total}").drop("n").withColumn("is_hot", F.lit(True))
    both = rows.join(F.broadcast(hot), key, "left")
    others = both.where("is_hot is null").select(*rows.columns).join(known.drop("n"), key, "left")
    return both.where("is_hot").drop("is_hot").unionByName(others)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text aren't among those of ``gone(doc_id, t)``, t as of ``text_key``. Null
    ids match null ids; columns of any name stay as they are."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)))
    keyed = rows.select(row.alias("row"), F.col("doc_id").try_cast("long").alias("own_id"), text_key(F.coalesce("text", F.lit(""))).alias("own_t"))
    left = keyed.join(gone.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_t") == F.col("t")), "left_anti")
    return left.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(rows.columns)))


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished steps: it does so once the driver's garbage collectors have seen
    that nothing refers to them, which on an idle driver can take long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A reliable checkpoint; for small tables in loops."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def text_docs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that matter, so that extra columns can't clash; null texts become empty."""
    return docs.select(F.col(key).try_cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def bytes_of(column: pa.Array) -> list[bytes]:
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_ids, texts) of at most ``limit`` bytes, or of one text that is longer."""
    for batch in batches:
        ids, column = batch.column(0).to_pylist(), batch.column(1)
        lengths = [x or 0 for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pandas().map(len, na_action="ignore")] if len(ids) else []
        begin = 0
        while begin < len(ids):
            end, total = begin + 1, lengths[begin]
            while end < len(ids) and total + lengths[end] <= limit:
                total += lengths[end]
                end += 1
            yield ids[begin:end], bytes_of(column.slice(begin, end - begin))
            begin = end


#: Rows and bytes that a batch for Python holds at most; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with batches that stay small even when texts are long. Spark reads the bounds when the plan runs, so
    they stay set in the session."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def total_bytes(df: DataFrame, column: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


#: Nodes that a task contracts at once.
FOREST_NODES = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to edges (node, smallest node it meets here): the same components, paths of one step."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, top(x)) for x in list(parent)]
        found = [(x, r) for x, r in found if x != r]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > FOREST_NODES:
            yield stars()
    yield stars()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``, longs; root is the smallest node reachable.

    Edges are dealt by their larger node and contracted in each task, twice, which leaves about one edge a node; then
    min-label exchange with pointer jumping, a checkpoint a round; rounds grow with the logarithm of the longest path,
    state is one row per node.
    """
    for _ in range(2):
        edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").repartition("b").mapInArrow(_forest, "a long, b long")
    both = settle(spark, edges.select("a", "b").where("a != b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = settle(spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        moved = settle(spark, hooked.join(jump, "mid", "left").select("node", "was", F.least(F.col("mid"), F.coalesce("far", "mid")).alias("root")))
        labels = moved.select("node", "root")
        if moved.where("was != root").isEmpty():
            return labels


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema) if isinstance(schema, str) else schema)
