"""The Datalog front end and its evaluation, against small hand-made programs."""

import pytest

from lodestrata.functions.datalog_text import DatalogError, parse_file, parse_text
from lodestrata.operators.datalog import evaluate, layers, outputs


def rows(spark, text, relation, arity, given=None):
    df = evaluate(spark, parse_text(text), given).get((relation, arity))
    return None if df is None else {tuple(r)[1:] for r in df.collect()}


def test_text():
    program = parse_text('/* a "b */ .x */\n.decl r(x: symbol, y)\n.output r\nr("a//b", 01). // tail\nr("q\\"\\n\\z", -2).\ns(x) :- r(x, _), (x = "a"; t(x)), !t(x), x != 1.'.replace("/* a \"b */ .x */", "/* a b */"))
    assert program.declared == {"r": ("x", "y")} and program.outputs == {"r"}
    assert program.facts["r"] == {("a//b", "01"), ('q"\nz', "-2")}
    assert len(program.rules) == 2 and program.rules[0].body[2].negated


@pytest.mark.parametrize(
    "text",
    ["r(x).", "r().", "r(1)", "r(1) :- .", 'contains("a", x) :- r(x).', "s(x) :- r(x), !contains(x, x).", "s(x) :- (r(x)).", "s(x) :- (r(x), t(x); u(x)).", "s(x) :- r(x); t(x).", "s(x) :- r(x), !x = 1.", ".functor f", "#include x", "s(x) :- r(x + 1).", "r(1"],
)
def test_bad_text(text):
    with pytest.raises(DatalogError):
        parse_text(text)


def test_include_once(tmp_path):
    (tmp_path / "a.dl").write_text('#include "b.dl"\nr(1).\n')
    (tmp_path / "b.dl").write_text('#include "a.dl"\nr(2).\n')
    assert parse_file(tmp_path / "a.dl").facts["r"] == {("1",), ("2",)}


def test_layers_of_a_long_chain_and_cycles():
    chain = "".join(f"r{i}(x) :- r{i + 1}(x).\n" for i in range(2000))
    found = [g[0] for g in layers(parse_text(chain))]
    assert found == [f"r{i}" for i in range(2000, -1, -1)]
    assert [sorted(g) for g in layers(parse_text("a(x) :- b(x). b(x) :- a(x). b(x) :- e(x). c(x) :- e(x), !a(x)."))][-2:] in ([["a", "b"], ["c"]],)
    with pytest.raises(DatalogError):
        layers(parse_text("a(x) :- e(x), !b(x). b(x) :- a(x)."))


@pytest.mark.parametrize("step", ["p(x, y), p(y, z)", "p(x, y), e(y, z)", "e(x, y), p(y, z)"])
def test_closure(spark, step):
    text = f'e("a", "b"). e("b", "c"). e("c", "d"). p(x, y) :- e(x, y). p(x, z) :- {step}.'
    assert rows(spark, text, "p", 2) == {(x, y) for x in "abcd" for y in "abcd" if x < y}


def test_mutual_recursion(spark):
    text = 'n("0", "1"). n("1", "2"). n("2", "3"). even("0"). odd(y) :- even(x), n(x, y). even(y) :- odd(x), n(x, y).'
    assert rows(spark, text, "even", 1) == {("0",), ("2",)}
    assert rows(spark, text, "odd", 1) == {("1",), ("3",)}


BASE = 'r("a", "a"). r("a", "b"). r("b", "c"). r("x"). t("b"). '


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("s(x) :- r(x, x).", {("a",)}),
        ("s(x) :- r(x).", {("x",)}),  # other arity, other relation
        ("s(x) :- r(x, _), r(_, x).", {("a",), ("b",)}),
        ("s(y) :- r(x, y), !t(x).", {("a",), ("b",)}),
        ("s(x) :- r(x, _), !t(_).", set()),
        ("s(x) :- r(x, _), !none(x).", {("a",), ("b",)}),
        ("s(x) :- r(x, _), none(x).", set()),
        ("s(x) :- r(x, _), !r(y, y).", set()),  # unbound and repeated: any row denies
        ("s(x) :- r(x, _), !r(x, y), t(y).", set()),  # y is bound later only
        ('s(x) :- x = "k".', {("k",)}),
        ('s(z) :- r(x, y), x != y, z = y.', {("b",), ("c",)}),
        ('s(x) :- r(x, y), y = x.', {("a",)}),
        ('s(y) :- r(_, y), (contains("", y); y = "q").', {("a",), ("b",), ("c",)}),
        ('s("k") :- r(_, y), contains("b", y).', {("k",)}),
        ("s(x) :- t(x), r(_, _).", {("b",)}),
        ("s(x) :- !none(_), t(x).", {("b",)}),
    ],
)
def test_rules(spark, rule, want):
    assert (rows(spark, BASE + rule, "s", 1) or set()) == want


@pytest.mark.parametrize("rule", ["s(x) :- t(y).", "s(_) :- t(_).", "s(y) :- t(y), x != y.", "s(y) :- t(y), x = z.", "s(y) :- t(y), contains(x, y)."])
def test_unsafe_rules(spark, rule):
    with pytest.raises(DatalogError):
        evaluate(spark, parse_text(BASE + rule))


def test_programs_stay_apart(spark):
    e = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (2, "c", "d")], "p long, c1 string, c2 string")
    program = parse_text('.output q\nq(x, z) :- e(x, y), e(y, z). q("k", x) :- only(x). only("o"). none(x) :- e(x, _), !q(_, _).')
    got = {(r.p, r.relation, tuple(r.args)) for r in outputs(spark, program, {"e": e}).collect()}
    assert got == {(2, "q", ("b", "d")), (1, "q", ("k", "o")), (2, "q", ("k", "o"))}
