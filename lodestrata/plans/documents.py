"""Document preparation: inventory of a program's files, main document, content hash, merged lines and their map.

All of it works on rows ``p, path, content`` (binary), so one job prepares many programs. Binary content is decoded
as UTF-8 with replacement, which needs Python; the rest is native.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Languages by extension (these extensions are text), what a walk leaves out, main documents by rank.
LANGUAGES = {
    "shell": "bash sh", "c": "c h", "cpp": "cc cpp", "config": "cfg conf", "css": "css", "go": "go", "html": "html", "java": "java", "javascript": "js jsx mjs", "json": "json",
    "kotlin": "kt", "lua": "lua", "markdown": "md", "python": "py", "ruby": "rb", "rust": "rs", "toml": "toml", "typescript": "ts", "tsx": "tsx", "text": "txt", "yaml": "yaml yml",
}
SKIPPED_DIRS = ".git .hg .svn .venv .tox .mypy_cache .pytest_cache .ruff_cache .next .nuxt .turbo .parcel-cache __pycache__ build coverage dist htmlcov node_modules out target vendor"
SKIPPED_FILES = ".DS_Store .gitkeep Cargo.lock Gemfile.lock Pipfile.lock _meta.json bun.lockb composer.lock go.sum package-lock.json package.json pnpm-lock.yaml poetry.lock uv.lock yarn.lock"
MAIN = ("skill.md", "skills.md")
MAX_FILE, MAX_MERGED = 1_000_000, 4 * 1024 * 1024
GENERATED = "<generated>"
HEADING = "<!-- inlined sources -->"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda b: b.decode("utf-8", errors="replace") if b is not None else "")


def read_directory(spark: SparkSession, root: str) -> DataFrame:
    """``p, path, content`` of ``root/<p>/...``: a folder for each program, named by an integer."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rest = F.regexp_extract("path", r"^.*?" + root.rstrip("/").split("/")[-1] + r"/(\d+)/(.*)$", 2)
    return found.select(F.regexp_extract("path", r"/(\d+)/" + r"[^/].*$", 1).cast("long").alias("p"), rest.alias("path"), "content")


def _name() -> Column:
    return F.substring_index("path", "/", -1)


def _suffix() -> Column:
    return F.lower(F.regexp_extract(_name(), r"^.+\.([^.]+)$", 1))


def walk_key() -> Column:
    """Sorts paths as a walk meets them: a folder's files, then its folders."""
    parts = F.split("path", "/")
    return F.transform(parts, lambda x, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), x))


def lines_of(text) -> Column:
    """Lines as ``str.splitlines`` cuts them; no line of an empty text."""
    bare = F.regexp_replace(text, f"({LINE_END})\\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, LINE_END, -1))


def inventory(files: DataFrame) -> DataFrame:
    """``p, path, size_bytes, line_count, language, disposition`` of what a walk meets, with ``text`` of what is text."""
    names = F.split("path", "/")
    dirs = F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0)))
    seen = files.where(~F.arrays_overlap(dirs, F.array(*map(F.lit, SKIPPED_DIRS.split()))) & ~_name().isin(*SKIPPED_FILES.split()))
    rank = F.when(F.lower("path").isin(*MAIN), F.array_position(F.array(*map(F.lit, MAIN)), F.lower("path"))).when(F.endswith("path", F.lit(".md")), F.lit(9))
    top = files.where(~F.contains("path", F.lit("/"))).withColumn("rank", rank).where("rank is not null")
    main = top.groupBy("p").agg(F.min(F.struct("rank", "path")).getField("path").alias("main"))
    language = F.coalesce(F.create_map(*(F.lit(x) for lang, ends in LANGUAGES.items() for e in ends.split() for x in (e, lang)))[_suffix()], F.lit("unknown"))
    size = F.coalesce(F.length("content"), F.lit(0)).cast("long")
    taken = (language != "unknown") & ~F.endswith(F.lower(_name()), F.lit(".d.ts")) & (size <= MAX_FILE)
    out = seen.join(main, "p", "left").select("p", "path", size.alias("size_bytes"), language.alias("language"), F.when(~taken, "excluded").when(F.col("path") == F.col("main"), "inlined").otherwise("inlined_source").alias("disposition"), "content")
    text = F.when(F.col("disposition") != "excluded", decoded("content")).otherwise(F.lit(""))
    return out.withColumn("text", text).withColumn("line_count", F.size(lines_of(F.col("text"))))


def content_hash(listed: DataFrame) -> DataFrame:
    """(p, sha256) over path, disposition and content (of excluded files their size), each closed by a zero byte."""
    zero = F.lit(bytearray(b"\0"))
    body = F.when(F.col("disposition") == "excluded", F.col("size_bytes").cast("string").cast("binary")).otherwise(F.coalesce("content", F.lit(bytearray(b""))))
    entry = F.concat(F.col("path").cast("binary"), zero, F.col("disposition").cast("binary"), zero, body, zero)
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("path", entry.alias("e")))), F.lit(bytearray(b"")), lambda acc, x: F.concat(acc, x["e"]))
    return listed.groupBy("p").agg(F.sha2(joined, 256).alias("sha256"))


def merged_lines(listed: DataFrame) -> DataFrame:
    """``p, line, text, source_file, source_line`` of the merged document: the main document, then every other text
    file in a fence of six backticks under its path. Lines that no file holds have source line 0."""
    body = lines_of(F.regexp_replace("text", r"(?U)\s+\z", ""))
    numbered = F.transform(body, lambda x, i: F.struct(x.alias("text"), (i + 1).cast("int").alias("source_line")))
    made = lambda *texts: F.array(*(F.struct((t if isinstance(t, Column) else F.lit(t)).alias("text"), F.lit(0).alias("source_line")) for t in texts))
    fenced = F.concat(made(F.concat(F.lit("### "), "path"), "", "``````text"), numbered, made("``````", ""))
    main = listed.where("disposition = 'inlined'").select("p", F.lit(0).alias("block"), F.array(F.lit("")).alias("k"), "path", F.posexplode(numbered).alias("i", "x"))
    others = listed.where("disposition = 'inlined_source'")
    head = others.select("p").distinct().select("p", F.lit(1).alias("block"), F.array(F.lit("")).alias("k"), F.lit(GENERATED).alias("path"), F.posexplode(made("", HEADING, "")).alias("i", "x"))
    rest = others.select("p", F.lit(2).alias("block"), walk_key().alias("k"), "path", F.posexplode(fenced).alias("i", "x"))
    nth = F.row_number().over(Window.partitionBy("p").orderBy("block", "k", "i"))
    return main.unionByName(head).unionByName(rest).select("p", nth.alias("line"), "x.text", F.col("path").alias("source_file"), "x.source_line")


def source_map(lines: DataFrame) -> DataFrame:
    """Runs of merged lines that continue each other in one file; generated lines run together per file."""
    w = Window.partitionBy("p").orderBy("line")
    before, file = F.lag("source_line").over(w), F.lag("source_file").over(w)
    on = (file == F.col("source_file")) & (((before == 0) & (F.col("source_line") == 0)) | ((before != 0) & (F.col("source_line") == before + 1)))
    runs = lines.select("p", "line", "source_file", "source_line", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1).alias("new"))
    runs = runs.withColumn("run", F.sum("new").over(w))
    return runs.groupBy("p", "run").agg(F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.first("source_file").alias("source_file"), F.min("source_line").alias("source_start"), F.max("source_line").alias("source_end")).drop("run")


def translated(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """``units(p, id, line_start, line_end, ...)`` with ``source_file, source_start, source_end``: generated lines are
    line 0 of no file (null), lines outside every range stay as they are. The end is never before the start."""

    def ends(at: str, x: str) -> DataFrame:
        r = ranges.select(F.col("p").alias("rp"), F.col("line_start").alias("a"), F.col("line_end").alias("b"), F.col("source_file").alias(f"{x}_file"), F.col("source_start").alias(f"{x}_first"), F.col("line_start").alias(f"{x}_from"))
        u = units.select("p", "id", F.col(at).alias("at"))
        return u.join(r, (u.p == r.rp) & u["at"].between(r.a, r.b)).select("p", "id", f"{x}_file", f"{x}_first", f"{x}_from")

    both = units.join(ends("line_start", "s"), ["p", "id"], "left").join(ends("line_end", "e"), ["p", "id"], "left")
    start = F.col("s_first") + F.col("line_start") - F.col("s_from")
    end = F.when(F.col("e_first") > 0, F.col("e_first") + F.col("line_end") - F.col("e_from")).when(F.col("e_first").isNull() & (F.col("s_first") > 0), F.col("s_first") + F.col("line_end") - F.col("s_from")).otherwise(start)
    none, made = F.col("s_first").isNull(), F.col("s_first") == 0
    return both.select(
        *units.columns, F.when(~none & ~made, F.col("s_file")).alias("source_file"), F.when(none, F.col("line_start")).when(made, 0).otherwise(start).alias("source_start"),
        F.when(none, F.col("line_end")).when(made, 0).otherwise(F.greatest(start, end)).alias("source_end"),
    )


def oversized(listed: DataFrame, limit: int = MAX_MERGED) -> DataFrame:
    """(p, size_bytes) of programs whose text files are larger together than the limit; they are to be set aside."""
    return listed.where("disposition <> 'excluded'").groupBy("p").agg(F.sum("size_bytes").alias("size_bytes")).where(F.col("size_bytes") > limit)
