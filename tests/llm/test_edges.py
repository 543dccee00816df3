"""Operators against exhaustive searches, and the edge cases that their docstrings state: nulls, repeats, long texts, empty
tables, clashing columns, other settings of the session."""

import hashlib
import math
import random
from collections import Counter

import pytest

from tests.llm.test_operators import DOCS, TEXTS, WORDS, brute_spans, docs, prose, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, t string, row string, own_text string, own_id int, first string, is_hot boolean"


def rows_of(spark, pairs):
    """Documents (doc_id, text), ids as they come, with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", f"s{k}", len(t or ""), "t", "row", "own", 7, "first", True) for k, (i, t) in enumerate(pairs)], COLUMNS)


def test_decontamination_against_all_passages(spark):
    from lodestrata.llm.decontaminate import B, K1, MIN_OVERLAP, MIN_TEXT_BLOCK, RUN, THRESHOLD, contaminated, question_and_answer, words_of

    r = random.Random(3)
    items = [(k, f"{prose(6 + k % 9, 500 + k)}{'?' if k % 3 else ''} {prose(5 + k % 7, 700 + k)}") for k in range(40)] + [(3, None), (99, "..."), (7, prose(9, 1))]
    texts = {i: prose(150 + 7 * i, 900 + i) for i in range(30)}
    for i in range(0, 30, 2):  # items as they are, or with words changed
        own = texts[i].split()
        w = items[i][1].split()
        for _ in range(i % 5):
            w[r.randrange(len(w))] = r.choice(WORDS)
        at = r.randrange(len(own))
        texts[i] = " ".join(own[:at] + w + own[at:])
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in contaminated(spark, docs(spark, texts), frame).collect()}
    known = sorted({(i, t) for i, t in items if t and words_of(t.encode())})
    bags = [words_of(t.encode()) for _, t in known]
    df, mean = Counter(w for b in bags for w in set(b)), sum(map(len, bags)) / len(bags)
    size = max(MIN_TEXT_BLOCK, max(map(len, bags)))
    impacts = []
    for b in bags:
        raw = {w: math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(b) / mean)) for w, n in Counter(b).items()}
        impacts.append({w: x / sum(raw.values()) for w, x in raw.items()})
    runs = lambda ws, n: {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
    want = {}
    for i, text in texts.items():
        own = words_of(text.encode())
        for first in range(0, len(own), size):
            passage = own[first : first + 2 * size]
            for (item, t), impact in zip(known, impacts, strict=True):
                score = sum(x for w, x in impact.items() if w in set(passage))
                parts = [(p, min(RUN, len(p))) for p in question_and_answer(t)]
                overlaps = [len(runs(p, n) & runs(passage, n)) / len(runs(p, n)) for p, n in parts]
                if score >= THRESHOLD - 1e-6 and min(overlaps) >= MIN_OVERLAP and score > want.get((i, item), (0,))[0] + 1e-9:
                    want[i, item] = (score, *overlaps, first, first + len(passage) - 1)
    assert set(got) == set(want) and len(want) >= 8
    for k, x in got.items():
        assert (x.score, x.question_overlap, x.answer_overlap, x.first_word, x.last_word) == pytest.approx(want[k])


def test_decontamination_of_odd_rows(spark):
    from lodestrata.llm.decontaminate import clean_rows, contaminated

    item = prose(30, 300)
    benchmark = spark.createDataFrame([("x", item, "lang"), ("x", item, "lang")], "item_id string, text string, lang string")
    bad, clean = prose(90, 301) + " " + item, prose(90, 302)
    frame = rows_of(spark, [(None, bad), (1, bad), (1, clean), (2, bad), (2, bad), (None, clean), (3, None), (4, "")])
    assert sorted((r.doc_id or 0, r.item_id) for r in contaminated(spark, frame, benchmark).collect()) == [(0, None), (1, None), (2, None), (2, None)]
    left = clean_rows(spark, frame, benchmark)
    assert left.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, clean), (1, clean), (3, ""), (4, "")]
    assert clean_rows(spark, frame.limit(0), benchmark).count() == 0 and clean_rows(spark, frame, benchmark.limit(0)).count() == 8


def test_warc_of_any_number_and_zone(spark):
    from lodestrata.llm.warc_index import archive_history, fetched

    html = "<p>" + "z" * 200
    rows = [(10**13, "http://a.org/", html), (-5, "http://a.org/", "short ü"), (2**63 - 1, "http://b.org/", None), (0, "http://a.org/", html), (0, "http://a.org/", html), (None, "http://c.org/", html)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, first string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        history = archive_history(spark, frame)
        got = history.collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(got) == 6 and {r.captured for r in got if r.page_id == 0} == {"2023-11-14T22:13:20Z"}
    assert Counter((r.page_id, r.record_type) for r in got) == Counter([(10**13, "revisit"), (-5, "response"), (2**63 - 1, "response"), (0, "response"), (0, "response"), (None, "revisit")])
    keys = [(r.urlkey, r.captured) for r in got]
    assert keys == sorted(keys)
    payloads = {r.page_id: bytes(r.payload).decode() for r in fetched(spark, history.where("record_type = 'response'")).collect()}
    assert payloads == {-5: "short ü", 2**63 - 1: "", 0: html}


def test_anchors_of_long_texts(spark, monkeypatch):
    from lodestrata.llm import suffix_dedup as S

    text = (prose(4000, 5) + "x" * 500 + prose(400, 6)).encode()
    _, at, h = S.anchors([text])
    for size in (64, 333, 5000):
        monkeypatch.setattr(S, "LONG", size)
        _, a, g = S.anchors([text])
        assert a.tolist() == at.tolist() and g.tolist() == h.tolist()


def test_suffix_dedup_ranges(spark, monkeypatch):
    """Many ranges, dealt further, give what one gives."""
    from lodestrata.llm import suffix_dedup as S

    texts = {i: prose(60, i % 23) + "\n" + prose(40, 100 + i) for i in range(60)}
    monkeypatch.setattr(S, "GROUP_SUFFIXES", 40)
    monkeypatch.setattr(S, "MAX_RANGES", 5)
    assert {r.doc_id: tuple(r)[1:] for r in S.deduplicated(spark, docs(spark, texts)).collect()} == brute_spans(texts)


def test_suffix_dedup_keeps_rows(spark):
    from lodestrata.llm.suffix_dedup import deduplicated_rows

    a, b, c = prose(30, 1), prose(30, 2), prose(30, 3)
    pairs = [(1, a), (2, b + "\n" + a), (2, c), (None, a), (None, c), (3, None), (4, "short"), (1, a), (5, a)]
    frame = rows_of(spark, pairs)
    left = deduplicated_rows(spark, frame)
    assert left.columns == frame.columns
    got = {r.source: r for r in left.collect()}
    assert [got[f"s{k}"].text for k in range(9)] == [a, b + "\n", c, "", "", None, "short", a, ""]
    assert all((r.t, r.row, r.own_text, r.own_id, r.first, r.is_hot) == ("t", "row", "own", 7, "first", True) for r in got.values())
    assert got["s1"].n_chars == len(b) + 1 and got["s0"].n_chars == len(a) and got["s8"].n_chars == 0
    assert deduplicated_rows(spark, frame.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [30, 50, 60, 100])
def test_jaccard_of_any_percent(spark, percent):
    from lodestrata.llm.partenum_join import jaccard_components

    r, texts = random.Random(percent), {}
    for k in range(50):
        w = prose(40 + 30 * (k % 3), 40 + k % 3).split()
        w = w[: len(w) * (10 - k % 7) // 10]
        for _ in range(k % 4):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts[k] = " ".join(w)
    sets = {i: {tuple(words(t)[j : j + 2]) for j in range(len(words(t)) - 1)} for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    got = {x.doc_id: x.component_id for x in jaccard_components(spark, docs(spark, texts), 2, percent).collect()}
    assert got == {i: top(i) for i in texts}


def test_first_rows(spark):
    from lodestrata.llm.partenum_join import first_rows, jaccard_components

    a, b, c = prose(80, 1), prose(80, 2), prose(80, 3)
    frame = rows_of(spark, [(5, a), (3, a + " more"), (3, b), (7, c), (None, a), (None, b), (7, c), (8, None), (9, ""), (9, ""), (None, prose(80, 4)), (None, prose(80, 4))])
    left = first_rows(spark, frame)
    assert left.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted([(3, a + " more"), (3, b), (7, c), (8, ""), (9, ""), (9, ""), (0, prose(80, 4))])
    got = Counter((r.doc_id, r.component_id) for r in jaccard_components(spark, frame).collect())
    assert got == Counter([(5, 3), (3, 3), (3, 3), (7, 7), (None, 3), (None, 3), (7, 7), (8, 8), (9, 9), (9, 9), (None, None), (None, None)])
    assert first_rows(spark, frame.limit(0)).count() == 0


def test_quality_of_small_languages(spark):
    """Rows of a rare language are judged by their characters against all languages."""
    from lodestrata.llm.quality import judged

    junk = " ".join(f"#{i}#%%##" for i in range(60))
    rows = [(i, prose(100, i), "en") for i in range(30)] + [(100, junk, "xx"), (101, prose(60, 7), "yy"), (102, junk, None)]
    got = {r.doc_id: r.kept for r in judged(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {i: True for i in range(30)} | {100: False, 101: True, 102: False}


def test_empty_and_null_tables(spark):
    from lodestrata.llm import license_scan, quality, suffix_tree_lm, toxicity, url_filter
    from lodestrata.llm.bpe_fst import encoded

    P = pytest.importorskip("public_tokenizers")
    bpe = lambda d: encoded(spark, d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    labels = spark.createDataFrame([(1, 0, 1, "x"), (2, 0, 0, "x"), (None, 0, 1, "x"), (1, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")
    for run in (license_scan.scanned, lambda d: quality.judged(spark, d), lambda d: suffix_tree_lm.scored(spark, d), lambda d: toxicity.scored(spark, d, labels), bpe):
        nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None), (None, "", None, None, None, None, None, None), (1, "one text", None, None, None, None, None, None), (1, "one text", None, None, None, None, None, None)], DOCS)
        assert run(nulls.limit(0)).count() == 0
        got = run(nulls).collect()
        assert sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 1] and got and len({str(r) for r in got if r.doc_id == 1}) == 1
    pages = spark.createDataFrame([(None, None, None, "h"), (1, "http://a.org/x", None, "h"), (1, "http://a.org/x", None, "h")], "page_id long, url string, html string, host string")
    assert url_filter.filtered(spark, pages).count() == 3 and url_filter.filtered(spark, pages.limit(0)).count() == 0


def test_decoding_goes_through_the_machine(spark):
    """Tokens that end amid a character; digests of what comes out."""
    P = pytest.importorskip("public_tokenizers")
    from lodestrata.llm.bpe_fst import Codec, encoded, read_ranks

    text = "a漢字😀́é‍🏽 ꙮ𓀀 plain"
    codec = Codec(read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    ids = codec.encode(text)
    assert any(codec.texts[i] is None for i in ids) and codec.decoded(ids) == text == "".join(codec.decode(ids))
    assert codec.decoded(ids[:-6][:3]) == "".join(codec.decode(ids[:3]))
    row = encoded(spark, spark.createDataFrame([(1, text)], "doc_id long, text string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).first()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    pytest.importorskip("public_tokenizers")
    item = prose(30, 300)
    bad, twin = prose(90, 301) + " " + item, prose(90, 400)
    pairs = [(i, prose(90, i)) for i in range(1, 30)] + [(50, bad), (None, bad + " and"), (60, twin), (60, prose(90, 401)), (61, twin), (60, twin), (None, twin), (None, prose(90, 402)), (None, None), (70, ""), (None, "few words")]
    frame = rows_of(spark, pairs)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item, "clash")], "item_id long, text string, doc_id string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = [(i, prose(90, i)) for i in range(1, 30)] + [(60, twin), (60, prose(90, 401)), (None, prose(90, 402))]
    assert got == Counter((i, sha(t)) for i, t in kept)
    empty = tmp_path / "empty"
    frame.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


@pytest.mark.parametrize("name", ["op1_warc_index", "op5_suffix_dedup", "op6_ngram_jaccard", "op7_quality_rules"])
def test_against_sql(spark, name, tmp_path):
    import duckdb

    from lodestrata.llm.queries import oracle_sql, queries

    texts = dict(TEXTS) | {i: prose(30 + i % 60, i % 17) for i in range(100, 160)}
    spark.createDataFrame([(i, t, "en" if i % 3 else "de", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"http://a{i}.org/", "<p>" + prose(20, i % 7)) for i in range(40)] + [(41, None, None)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
