"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import table


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.warc_index import archive_history

    return archive_history(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.license_scan import scanned

    return scanned(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.decontaminate import contaminated

    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("t")


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.suffix_tree_lm import scored

    return scored(spark, table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.suffix_dedup import deduplicated

    return deduplicated(spark, table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.partenum_join import jaccard_components

    return jaccard_components(spark, table(spark, sf_dir, "documents"), width=3, percent=90)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.quality import judged

    return judged(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.url_filter import filtered

    return filtered(spark, table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.toxicity import scored

    return scored(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestrata.llm.bpe_fst import encoded

    return encoded(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: What op1 returns follows from the pages alone.
OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""


#: Every string of 50 bytes of every text, as hexadecimal digits.
OP5_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)
), hit AS (
  SELECT doc_id, i FROM w JOIN (SELECT s, min(doc_id) AS first FROM w GROUP BY s) USING (s) WHERE first < doc_id
), r AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
      SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit))
  GROUP BY doc_id, k
), c AS (
  SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS begins FROM r
), p AS (
  SELECT c.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * begins + 1, 2 * (a - begins)), '' ORDER BY a) AS kept
  FROM c JOIN d USING (doc_id) GROUP BY c.doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs of texts that share a shingle, by a join on shingles.
OP6_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), e AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d
), x AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM e
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b USING (g) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
)
SELECT e.doc_id, len(e.s) AS n_shingles, least(e.doc_id, min(r.v)) AS component_id FROM e JOIN reach r ON r.u = e.doc_id GROUP BY e.doc_id, e.s
"""


def _op7_sql() -> str:
    from lodestrata.llm import quality as q

    common = ", ".join(f"'{w}'" for w in q.COMMON)
    count = lambda pattern: f"len(regexp_replace(t, '[^{pattern}]', '', 'g'))"
    plain = [count("a-z"), count("A-Z"), count("0-9"), count("\\x20\\x09-\\x0D"), count("#*$%&|<>")]
    ascii_ = count("\\x00-\\x7F")
    classes = ", ".join([*plain, f"{ascii_} - {' - '.join(plain)}", f"len(t) - {ascii_}"])
    k = len(q.COMMON)

    def distance(own: str, ref: str, size: int) -> str:
        p, r = f"({own}[i] / nullif(list_sum({own}), 0))", f"({ref}[i] / nullif(list_sum({ref}), 0))"
        half = lambda a, b: f"CASE WHEN {a} > 0 THEN 0.5 * {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
        return f"sqrt(greatest(0, list_sum(list_transform(range(1, {size + 1}), lambda i: {half(p, r)} + {half(r, p)}))))"

    sums = lambda name, size: "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, size + 1)) + "]"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), l AS (
  SELECT k, sum(n - 1) AS n_dup_lines FROM (SELECT k, x, count(*) AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY k, x) GROUP BY k
), v AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), c AS (
  SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM v), (VALUES (0), (1), (2)) o(j) WHERE n > 1 GROUP BY k
), h AS (
  SELECT k, list_transform([{common}], lambda y: len(list_filter(z, lambda x: x = y))) AS cw FROM (SELECT k, list_filter(list_transform(w, lambda x: lower(x)), lambda x: x IN ({common})) AS z FROM d)
), m AS (
  SELECT d.k, doc_id, lang, len(w) AS n_words, len(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, {plain[4]} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         [{classes}] AS classes, list_append(cw, len(w) - list_sum(cw)) AS commons
  FROM d LEFT JOIN l USING (k) LEFT JOIN c USING (k) JOIN h USING (k)
), u AS (
  SELECT lang, {sums("classes", len(q.CLASSES))} AS rc, {sums("commons", k + 1)} AS rw, sum(n_words) AS n FROM m GROUP BY lang
), a AS (
  SELECT {sums("rc", len(q.CLASSES))} AS ac, sum(n) AS an FROM u
), j AS (
  SELECT m.*, u.n AS rn, an, CASE WHEN u.n < {q.MIN_REFERENCE} THEN {distance("classes", "ac", len(q.CLASSES))} ELSE {distance("classes", "rc", len(q.CLASSES))} END AS cd,
         CASE WHEN u.n >= {q.MIN_REFERENCE} THEN {distance("commons", "rw", k + 1)} END AS wd,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m JOIN u ON m.lang IS NOT DISTINCT FROM u.lang, a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (n_words < {q.MIN_WORDS} OR an < {q.MIN_REFERENCE} OR NOT (coalesce(cd > {q.MAX_CLASS_DISTANCE}, false) OR coalesce(wd > {q.MAX_WORD_DISTANCE}, false))) AS kept
FROM j
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": OP1_SQL, "op5_suffix_dedup": OP5_SQL, "op6_ngram_jaccard": OP6_SQL, "op7_quality_rules": _op7_sql()}
