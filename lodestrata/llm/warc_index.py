"""WARC archives and their index of captures.

``write_archives`` writes one WARC record per page through Spark's text writer,
which works on any file system Spark reaches: the record separator of WARC
(CR LF CR LF) is the writer's line separator, files are gzip. Of records with
equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest
page_id is a response, the others are revisits, which carry headers only.

``read_archives`` reads the files back by Content-Length and gives one sorted run
of captures per file. ``capture_history`` orders all captures by URL key and
time: rows are dealt to ranges of (URL key, time, page_id), so even one URL can
span ranges, and in each range a loser tree merges the runs.

Edge cases: null html is an empty payload; null url gives the empty URL key; line
breaks in a url are dropped in headers; a null page_id is kept, and is a response
only if no other page has its payload; rows repeating a page_id and payload:
one is the response as far as ids tell, so all rows with the smallest id are.
Every long is a page_id (dates begin anew after ``PERIOD``), one that is no number
counts as null. A payload of any size is one record; a reader holds one archive.
Empty tables give empty archives and results. Only page_id, url, html are read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import batch_of, empty, in_arrow, shared_dir, spread_join, stash
from lodestrata.llm.loser_tree import merged

MIN_REVISIT = 100
#: Bounds an archive's size, so that a reader holds one archive.
RECORDS_PER_FILE = 2000
#: Captures have no time of their own in the table: page_id seconds after this, beginning anew after a period.
EPOCH, PERIOD = 1_700_000_000, 1_000_000_000
#: Captures that a range of the merged index should hold.
RANGE_ROWS = 200_000
CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, urlkey string, captured string, run string, place long, offset long, length long"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("urlkey", pa.string()), ("captured", pa.string()), ("run", pa.string()), ("place", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])


def _date(page_id: Column) -> Column:
    """``EPOCH`` and the page's number of seconds, in UTC whatever the session's time zone; numbers of ``PERIOD`` and more begin anew."""
    seconds = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(PERIOD)) + EPOCH
    day, rest = F.floor(seconds / 86400).cast("int"), (seconds % 86400).cast("int")
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600).cast("int"), F.floor(rest % 3600 / 60).cast("int"), rest % 60)
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), clock)


def write_archives(spark: SparkSession, pages: DataFrame, path: str) -> None:
    df = pages.select(F.col("page_id").try_cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    df = df.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    # which records revisit is found on narrow rows, hot payloads by broadcast; payloads then move by page, not by digest
    narrow = stash(spark, df.where(F.col("size") >= MIN_REVISIT).select("page_id", "digest"), "digests")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = spread_join(narrow, first, "digest", narrow.count()).where(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))).distinct()
    again = again.toDF("again_digest", "again_id", "first") if again.columns[0] == "digest" else again.toDF("again_id", "again_digest", "first")
    df = df.join(again.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    revisit = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), optional("WARC-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", _date(F.col("page_id"))), optional("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("WARC-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    df.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def url_key(url: str) -> str:
    """Host labels reversed and joined by commas, then the rest: ``com,example)/a?b``."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    labels = [x for x in host.split(".") if x]
    if labels[:1] == ["www"]:
        labels = labels[1:]
    return f"{','.join(reversed(labels))}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers and block of each record of an archive, where it begins, and its length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size], at, end + 4 + size - at
        at = end + 4 + size + 4


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for headers, block, at, length in records(gzip.decompress(content.as_py())):
                revisit = headers["WARC-Type"] == "revisit"
                size, digest = (int(headers["WARC-Payload-Length"]), headers["WARC-Payload-Digest"][7:]) if revisit else (len(block), hashlib.sha256(block).hexdigest())
                if digest != headers["WARC-Payload-Digest"][7:]:
                    raise ValueError(f"a payload of {path} differs from its digest")
                page, url = headers.get("WARC-Page-ID"), headers.get("WARC-Target-URI", "")
                refers = int(headers["WARC-Refers-To"][10:-1]) if revisit else None
                rows.append((None if page is None else int(page), size, digest, headers["WARC-Type"], refers, url, url_key(url) if url else "", headers["WARC-Date"], at, length))
            rows.sort(key=_order)
            columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(10)]
            yield batch_of(_SCHEMA, [*columns[:8], [path] * len(rows), list(range(len(rows))), *columns[8:]])


def _order(row: tuple) -> tuple:
    return row[6], row[7], -1 if row[0] is None else row[0]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record; ``run`` names the archive, ``place`` is the row's in its archive's sorted run, and ``offset`` and
    ``length`` are where the record stands in the unpacked archive."""
    files, rows = spark.read.format("binaryFile").load(path).select("path", "content"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        return stash(spark, files.mapInArrow(_captures, CAPTURE), "captures")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def fetched(spark: SparkSession, captures: DataFrame) -> DataFrame:
    """(page_id, payload) of captures, read from their places in the archives; a revisit has none of its own."""
    wanted = captures.groupBy("run").agg(F.collect_list(F.struct("page_id", "offset", "length")).alias("at"))
    files = spark.read.format("binaryFile").load([r.run for r in wanted.select("run").toLocalIterator()]).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, at in zip(*(batch.column(c).to_pylist() for c in ("content", "at")), strict=True):
                data = gzip.decompress(content)
                found = [(x["page_id"], next(records(data[x["offset"] : x["offset"] + x["length"]]))[1]) for x in at]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], names=["page_id", "payload"])

    return in_arrow(files.join(wanted, F.col("path") == F.col("run")), run, "page_id long, payload binary")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(row[8], []).append(row)
    for run in runs.values():  # blocks of a shuffle may come in any order, rows of a block don't change theirs
        if any(a[9] > b[9] for a, b in zip(run, run[1:], strict=False)):
            run.sort(key=lambda r: r[9])
    out: list[tuple] = []
    for row in merged([runs[k] for k in sorted(runs)], _order):
        out.append(row)
        if len(out) == 4096:
            yield batch_of(_SCHEMA, [list(c) for c in zip(*out, strict=True)])
            out = []
    if out:
        yield batch_of(_SCHEMA, [list(c) for c in zip(*out, strict=True)])


def capture_history(captures: DataFrame) -> DataFrame:
    """All captures, globally ordered by URL key, time and page_id, in ranges of about ``RANGE_ROWS``."""
    n = max(1, -(-captures.count() // RANGE_ROWS))
    return in_arrow(captures.repartitionByRange(n, "urlkey", "captured", "page_id"), _merge, CAPTURE)


def archive_history(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives of ``pages``, reads them back and merges their runs."""
    if pages.isEmpty():
        return empty(spark, CAPTURE)
    path = path or f"{shared_dir(spark).rstrip('/')}/lodestrata/warc-{uuid.uuid4().hex}"
    write_archives(spark, pages, path)
    return capture_history(read_archives(spark, path))
