"""Aligns quoted evidence with the units of its program's document, by native expressions.

Tokens are runs of ASCII word characters and single Han, Hiragana, Katakana and Hangul characters. A
pair is scored once per distinct text: repeated quotes of a program are paired with its units once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word characters of the tokens, and the scores' constants.
TOKEN = r"[A-Za-z0-9_]+|[一-鿿]|[぀-ゟ]|[゠-ヿ]|[가-힯]"
BASE = 0.2


def tokens(text) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def stripped(text) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))


def prepared(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds what scoring needs: stripped text, tokens' number, distinct tokens; columns start with ``prefix``."""
    return (
        df.withColumn(f"{prefix}_low", stripped(F.col(text)))
        .withColumn(f"{prefix}_set", F.array_distinct(tokens(F.col(f"{prefix}_low"))))
        .withColumn(f"{prefix}_count", F.size(tokens(F.col(f"{prefix}_low"))))
        .withColumn(f"{prefix}_own", F.size(tokens(F.col(text))))
    )


def score(a: str, b: str) -> Column:
    """Of evidence with columns ``a_*`` and a unit with ``b_*``, as of ``prepared``."""
    c = lambda n: F.col(n)
    n, m = F.size(f"{a}_set"), F.size(f"{b}_set")
    shared = F.size(F.array_intersect(f"{a}_set", f"{b}_set"))
    jaccard = shared / (n + m - shared)
    short, long = F.least(c(f"{a}_count"), c(f"{b}_count")), F.greatest(c(f"{a}_count"), c(f"{b}_count"))
    inside = (F.contains(c(f"{b}_low"), c(f"{a}_low")) | F.contains(c(f"{a}_low"), c(f"{b}_low"))) & (F.least(F.length(f"{a}_low"), F.length(f"{b}_low")) >= 8) & (F.least(n, m) >= 2)
    contained = shared / n
    return (
        F.when((n == 0) | (m == 0), F.lit(0.0))
        .when(inside, F.when(short == long, F.lit(1.0)).otherwise(F.greatest(F.lit(0.75), short / long)))
        .when((n >= 3) & (contained >= 0.5), F.greatest(jaccard, contained * 0.75))
        .otherwise(jaccard)
    )


def align(evidence: DataFrame, units: DataFrame, threshold: float = BASE) -> DataFrame:
    """Best unit of each row of ``evidence(p, e, text)`` among ``units(p, id, text)``: columns ``p, e, score, matched,
    unit_id`` (null unless matched). Of equal scores the lowest id wins; rows of programs without units score 0 and
    don't match. The threshold shrinks with the ratio of token numbers where the evidence is shorter, to a half at most."""
    base = max(0.0, min(1.0, threshold))
    quotes = prepared(evidence.select("p", F.col("text").alias("quote")).distinct(), "quote", "a")
    pairs = quotes.join(prepared(units.select("p", "id", F.col("text").alias("unit")), "unit", "b"), "p")
    scored = pairs.select("p", "quote", "id", "a_own", "b_own", score("a", "b").alias("score"))
    best = scored.groupBy("p", "quote").agg(F.max_by(F.struct("id", "score", "a_own", "b_own"), F.struct(F.col("score"), (-F.col("id")).alias("first"))).alias("best"))
    own = evidence.select("p", "e", F.col("text").alias("own"))
    joined = own.join(best, (own.p == best.p) & own.own.eqNullSafe(best.quote), "left").select(own.p, "e", "best.*")
    shrunk = F.when((F.col("a_own") == 0) | (F.col("b_own") == 0) | (F.col("a_own") >= F.col("b_own")), F.lit(base)).otherwise(base * F.greatest(F.lit(0.5), F.col("a_own") / F.col("b_own")))
    matched = F.coalesce(F.col("score") >= shrunk, F.lit(False))
    return joined.select("p", "e", F.coalesce("score", F.lit(0.0)).alias("score"), matched.alias("matched"), F.when(matched, F.col("id")).alias("unit_id"))


def alignment_metrics(aligned: DataFrame, units: DataFrame) -> DataFrame:
    """Per program: match_rate, unit_coverage (by tokens, one at least per unit), grounding (their product); 0 where
    there is nothing to divide by."""
    rate = aligned.groupBy("p").agg(F.avg(F.col("matched").cast("int")).alias("rate"))
    hit = aligned.where("matched").select("p", F.col("unit_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    weighed = units.select("p", "id", F.greatest(F.lit(1), F.size(tokens(F.col("text")))).alias("w")).join(hit, ["p", "id"], "left")
    share = weighed.groupBy("p").agg((F.sum(F.when(F.col("hit") == 1, F.col("w")).otherwise(0)) / F.sum("w")).alias("share"))
    both = rate.join(share, "p", "full_outer")
    r, s = F.coalesce("rate", F.lit(0.0)), F.coalesce("share", F.lit(0.0))
    return both.select("p", F.round(r, 6).alias("match_rate"), F.round(s, 6).alias("unit_coverage"), F.round(r * s, 6).alias("grounding"))
