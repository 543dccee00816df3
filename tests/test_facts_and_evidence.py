"""Fact text, its checks, alignment, reports."""

import json

import pytest

from lodestrata.operators import alignment
from lodestrata.plans import fact_checks, findings
from lodestrata.sources.fact_text import FactError, parse_fact, parse_program, scan


@pytest.mark.parametrize(
    ("text", "args"),
    [('r("a", b).', ["a", "b"]), ("r().", []), (r'r("a\"b\n", " c ").', ['a"bn', "c"]), ('r(a"b, c"d).', ["ab, cd"]), ("r(,).", ["", ""]), ('r("(x)", y).', ["(x)", "y"]), ("r(1). s(2).", ["1). s(2"]), ('r("").', [""])],
)
def test_fact(text, args):
    assert parse_fact(text) == ("r", args)


@pytest.mark.parametrize("text", ["r(1)", "(1).", "r 1.", "r-s(1).", 'r("a).', "."])
def test_no_fact(text):
    with pytest.raises(FactError):
        parse_fact(text)


def test_program():
    text = '#include "a.dl"\n\n skill("a//b"). // x\n// all\ncall(c). nope(1).\n#define\ncall_evidence(c, su_0).\nbad'
    got = list(parse_program(text))
    assert [(n, k) for n, k, *_ in got] == [(1, "include"), (3, "core"), (5, "core"), (6, "unknown"), (7, "directive"), (8, "evidence"), (9, "unknown")]
    assert got[1][3] == ["a//b"] and got[-1][2] == "__parse_error__"
    with pytest.raises(FactError):
        list(parse_program(text, strict=True))


def test_checks(spark):
    text = "\n".join([
        "skill(k).", "skill(k).", "call(c).", "value(v, a, secret).", "value_evidence_text(v, a, said).", "foo(1).", "oops",
        "evidence_unit(su_1, 1).", "call_evidence(c, su_9).", "call_evidence(d, su_1).",
    ])
    texts = spark.createDataFrame([(1, text), (2, ""), (3, None)], "p long, text string")
    facts = scan(texts).cache()
    issues = fact_checks.text_issues(facts, texts.select("p"), library="lib.dl", evidence=True)
    got = sorted((r.p, r.code, r.line) for r in issues.collect())
    assert got == sorted([
        (1, "SDL001", 7), (1, "SDL002", 6), (1, "SDL003", 3), (1, "SDL004", 0), (1, "SDL005", 0), (1, "SDL030", 2), (1, "EVD010", 9), (1, "EVD011", 10), (1, "EVD012", 1), (1, "EVD012", 2),
        (2, "SDL004", 0), (2, "SDL005", 0), (3, "SDL004", 0), (3, "SDL005", 0),
    ])
    assert {r.p: r.coverage for r in fact_checks.support_coverage(facts, texts.select("p")).collect()} == {1: round(1 / 3, 6), 2: 1.0, 3: 1.0}
    assert not any(r.valid for r in fact_checks.validity(issues, texts.select("p")).collect())


PAIRS = [
    ("", "a b c", 0.0), ("reads the file", "Reads the file", 1.0), ("reads the file", "it reads the file from disk", 0.75), ("a b", "a b c d", 0.5),
    ("one two three four", "four three nine two", 0.6), ("one two three", "one two x y z w u v", max(2 / 9, 0.75 * 2 / 3)), ("漢字かな", "漢字", 0.5), ("...", "...", 0.0), (" İX ", "ix", None),
]


def test_scores_and_alignment(spark):
    evidence = spark.createDataFrame([(i, 0, a) for i, (a, _, _) in enumerate(PAIRS)], "p long, e long, text string")
    units = spark.createDataFrame([(i, n, b) for i, (_, b, _) in enumerate(PAIRS) for n in (0, 1)], "p long, id long, text string")
    got = {r.p: r for r in alignment.align(evidence, units).collect()}
    for i, (_, _, want) in enumerate(PAIRS):
        if want is not None:
            assert got[i].score == pytest.approx(want), PAIRS[i]
            assert (got[i].unit_id == 0) == got[i].matched == (want >= 0.2)
    metrics = {r.p: r for r in alignment.alignment_metrics(alignment.align(evidence, units), units).collect()}
    assert metrics[1].match_rate == 1.0 and metrics[1].unit_coverage == 0.5 and metrics[0].grounding == 0.0


def test_alignment_without_units_and_nulls(spark):
    evidence = spark.createDataFrame([(1, 0, None), (1, 1, "word"), (2, 0, "word")], "p long, e long, text string")
    units = spark.createDataFrame([(1, 0, None), (1, 1, "word"), (3, 0, "alone")], "p long, id long, text string")
    got = {(r.p, r.e): (r.score, r.matched, r.unit_id) for r in alignment.align(evidence, units).collect()}
    assert got == {(1, 0): (0.0, False, None), (1, 1): (1.0, True, 1), (2, 0): (0.0, False, None)}


def test_reports(spark):
    found = spark.createDataFrame([(1, "b", ["x", 'q"'], "high"), (1, "a", [], "warning"), (1, "b", ["y"], "info")], "p long, label string, fields array<string>, severity string")
    assert [r.line for r in findings.finding_facts(found).orderBy("nth").collect()] == ['finding("f0", "a").', 'finding("f1", "b", "x", "q\\"").', 'finding("f2", "b", "y").']
    made = json.loads(findings.sarif(found, "t").first().sarif)
    assert [r["level"] for r in made["runs"][0]["results"]] == ["warning", "error", "note"] and made["version"] == "2.1.0"
    assert made["runs"][0]["results"][0]["message"]["text"] == "a"
    reports = {r.p: r.report for r in findings.markdown(found, spark.createDataFrame([(1,), (2,)], "p long")).collect()}
    assert "Findings: 3" in reports[1] and "no findings" in reports[2]


def test_patch_and_candidates(spark):
    lines = spark.createDataFrame([(1, 0, "a."), (1, 1, " b. "), (1, 2, "c.")], "p long, seq int, line string")
    patch = spark.createDataFrame([(1, "replace", "b.", "B."), (1, "remove", "c.", None), (1, "add", None, "a."), (1, "add", None, "d."), (1, "remove", "zz.", None)], "p long, kind string, target string, line string")
    out, lost = findings.patched(lines, patch)
    assert [r.line for r in out.orderBy("seq").collect()] == ["a.", "B.", "d."] and [r.target for r in lost.collect()] == ["zz."]
    scores = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.5, 0.4, 0.5, 0.9])], "p long, nth int, score double")
    assert [(r.best, r.accepted) for r in findings.accepted(scores).orderBy("nth").collect()] == [(0.5, True), (0.5, False), (0.5, True), (0.9, True)]
