"""Quality rules: counts of words, symbols, repeated lines and word runs, and
the divergence of a document's histograms from references of its language.

Two histograms are taken of each document: of seven character classes, and of
common words (each of ``COMMON`` and all others together). Their references are
sums over all documents with the same ``lang``. The Jensen-Shannon distance
(square root of the divergence to base 2, so 0 to 1) of each histogram from its
reference is held against a threshold. Guards: a document under ``min_words``
words isn't judged by divergence; one whose language has under ``min_reference``
words in all is judged by its character classes alone, against the sum over all
languages, and not at all if that is too small too.

Only DataFrame functions are used. Texts are read once; what is kept of each
document is a narrow row, from which references and verdicts follow. The
references are one row per language and are broadcast only after counting them.

Edge cases: null text counts as empty (no words, so it fails the base rule);
null ``lang`` is a language of its own; repeated rows are judged each alike;
empty tables give empty results; only doc_id, text and lang are read.
Word windows are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import stash

# Frequent words of the languages judged, most frequent first.
COMMON = (
    "the of and to in a is that it for on with as was by this are or an be from at have he not "
    "de la le les et des en un une du que qui dans pour sur par au est "
    "der die und den von zu das mit sich dem nicht ein eine auf ist im "
    "el y los se del las por con no su para es al lo"
).split()
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other_ascii", "beyond_ascii")
#: Above this distance of character classes, or of common words, a document goes.
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.50
MIN_WORDS = 50
MIN_REFERENCE = 2000
MAX_BROADCAST_LANGUAGES = 5000

_LETTERS = [chr(0x100 + i) for i in range(len(COMMON))]


def measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, the counts of the base rules, and both histograms, one narrow row per document; with ``carry`` the whole row too."""
    text = F.coalesce("text", F.lit(""))
    row = [F.struct(*docs.columns).alias("row")] * carry
    df = docs.select(*row, "doc_id", "lang", text.alias("text"))
    row = ["row"] * carry
    df = df.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rest = F.regexp_replace("text", "[a-z]+", "")
    df = df.withColumn("r1", rest).withColumn("r2", F.regexp_replace("r1", r"[\x20\x09-\x0D]+", ""))
    df = df.withColumn("r3", F.regexp_replace("r2", "[A-Z]+", "")).withColumn("r4", F.regexp_replace("r3", r"[#*$%&|<>]+", ""))
    df = df.withColumn("r5", F.regexp_replace("r4", "[0-9]+", "")).withColumn("r6", F.regexp_replace("r5", r"[\x00-\x7F]+", ""))
    size = {x: F.length(x).cast("long") for x in ("text", "r1", "r2", "r3", "r4", "r5", "r6")}
    classes = F.array(size["text"] - size["r1"], size["r2"] - size["r3"], size["r4"] - size["r5"], size["r1"] - size["r2"], size["r3"] - size["r4"], size["r5"] - size["r6"], size["r6"])
    windows = F.expr("if(size(words) < 3, array(), slice(transform(words, (x, i) -> xxhash64(x, get(words, i + 1), get(words, i + 2))), 1, greatest(size(words) - 2, 0)))")
    df = df.select(
        *row, "doc_id", "lang", F.size("words").cast("long").alias("n_words"), (size["text"] - (size["r1"] - size["r2"])).alias("word_chars"), (size["r3"] - size["r4"]).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), classes.alias("classes"), windows.alias("windows"),
        F.filter(F.transform("words", F.lower), lambda w: w.isin(COMMON)).alias("common"),
    )
    order = F.array(*map(F.lit, COMMON))
    alphabet = F.lit("".join(_LETTERS))
    coded = F.array_join(F.transform("common", lambda w: F.substring(alphabet, F.array_position(order, w), F.lit(1))), "")
    df = df.withColumn("coded", coded).withColumn("sorted", F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.sort_array(F.expr("transform(windows, (x, i) -> struct(x as h, i as i))"))))
    twice = F.expr("sort_array(transform(filter(sorted, (x, i) -> x.h = get(sorted, i - 1).h or x.h = get(sorted, i + 1).h), x -> x.i))")
    df = df.withColumn("twice", twice)
    repeated = F.expr("coalesce(aggregate(transform(twice, (x, i) -> least(3, coalesce(get(twice, i + 1) - x, 3))), 0L, (a, x) -> a + x), 0L)")
    n_coded = F.length("coded")
    counts = F.array(*((n_coded - F.length(F.replace("coded", F.lit(c), F.lit("")))).cast("long") for c in _LETTERS), F.col("n_words") - n_coded)
    return df.select(*row, "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), "classes", counts.alias("commons"))


def _distance(own: str, reference: str) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if either is all zero."""
    return F.expr(f"""
        sqrt(greatest(0D, aggregate(zip_with(
          transform({own}, x -> x / nullif(aggregate({own}, 0L, (a, x) -> a + x), 0L)),
          transform({reference}, x -> x / nullif(aggregate({reference}, 0L, (a, x) -> a + x), 0L)),
          (p, q) -> if(p > 0, 0.5D * p * log2(2D * p / (p + q)), 0D) + if(q > 0, 0.5D * q * log2(2D * q / (p + q)), 0D)), 0D, (a, x) -> a + x)))""")


def references(measured: DataFrame) -> DataFrame:
    """A row per language: the summed histograms and words over all its documents."""
    sums = lambda name, n: F.array(*(F.sum(F.col(name)[i]) for i in range(n))).alias(f"ref_{name}")
    return measured.groupBy("lang").agg(sums("classes", len(CLASSES)), sums("commons", len(COMMON) + 1), F.sum("n_words").alias("ref_words"))


def verdicts(spark: SparkSession, measured: DataFrame, refs: DataFrame, min_words: int, min_reference: int, max_class: float, max_word: float) -> DataFrame:
    """``measured`` with class_distance, word_distance, base_failed and kept."""
    refs = stash(spark, refs.withColumnRenamed("lang", "ref_lang"), "references")
    few = refs.count() <= MAX_BROADCAST_LANGUAGES
    df = measured.join(F.broadcast(refs) if few else refs, measured.lang.eqNullSafe(refs.ref_lang), "left")
    df = df.withColumn("class_distance", _distance("classes", "ref_classes")).withColumn("word_distance", _distance("commons", "ref_commons"))
    whole = stash(spark, refs.agg(F.array(*(F.sum(F.col("ref_classes")[i]) for i in range(len(CLASSES)))).alias("all_classes"), F.sum("ref_words").alias("all_words")), "reference")
    few_words = F.col("ref_words") < min_reference
    df = df.crossJoin(F.broadcast(whole))  # one row
    df = df.withColumn("class_distance", F.when(few_words, _distance("classes", "all_classes")).otherwise(F.col("class_distance"))).withColumn("word_distance", F.when(~few_words, F.col("word_distance")))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    guarded = (F.col("n_words") < min_words) | (F.col("all_words") < min_reference)
    far = F.coalesce(F.col("class_distance") > max_class, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word, F.lit(False))
    return df.withColumn("base_failed", base).withColumn("kept", ~base & (guarded | ~F.coalesce(far, F.lit(False))))


def judged(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, min_reference: int = MIN_REFERENCE, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The measures of each document with class_distance, word_distance, base_failed and kept."""
    measured = stash(spark, measures(docs), "quality")
    df = verdicts(spark, measured, references(measured), min_words, min_reference, max_class, max_word)
    return df.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def kept_rows(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, min_reference: int = MIN_REFERENCE, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The rows of ``docs`` that the rules keep. Rows are written beside their measures once, so texts are measured
    once and a filter on the verdict isn't pushed into, and repeated over, the measuring expressions."""
    measured = stash(spark, measures(docs, carry=True), "measured")
    df = verdicts(spark, measured, references(measured), min_words, min_reference, max_class, max_word)
    return df.where("kept").select("row.*")
