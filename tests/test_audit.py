"""The rule library, rule by rule: a program fires with all the facts that a rule reads, and stops as soon as one of them goes
or a fact that the rule denies comes in. Cases are made from the table below, one program for each."""

import pytest

from lodestrata.plans.catalog import audit
from lodestrata.sources.fact_text import scan

# label, row, facts that the rule reads (each needed), facts that hold besides, facts that stop it (each enough)
ACT, CALL = "action(do, job)", "call(one, do)"
RULES = [
    ("dangerous_execution_primitives", "job do one", [ACT, CALL, "call_effect(one, proc_exec)", "call_region_untrusted(one)"], [], []),
    ("dangerous_execution_primitives", "job do one", [ACT, CALL, "call_effect(one, code_eval)", "call_code(one, encoded_binary)"], [], []),
    ("dangerous_execution_primitives", "job do one", [ACT, CALL, "call_effect(one, proc_exec)", "call_input(one, x)", "value(x, do, untrusted)"], [], []),
    ("dangerous_execution_primitives", "job do two", [ACT, CALL, "call(two, do)", "call_effect(one, net_read)", "call_effect(two, proc_exec)", "call_unconditional(one, two)"], [], []),
    ("behavior_claim_contradiction", "job do one local_only agent_call", [ACT, CALL, "call_effect(one, agent_call)", "skill_doc_claim(job, local_only)"], [], []),
    ("unverifiable_dependency_source", "job do two one", [ACT, CALL, "call(two, do)", "call_region_untrusted(one)", "call_effect(one, agent_call)", "call_output(one, x)", "value(x, do, local)", "call_input(two, x)", "call_effect(two, code_eval)"], [], []),
    ("unverifiable_dependency_source", "job do one one", [ACT, CALL, "call_region_untrusted(one)", "call_code(one, unresolved_target)", "call_effect(one, net_read)"], [], []),
    ("unsanitized_context_ingestion", "job do one x", [ACT, CALL, "call_effect(one, crypto_sign)", "call_input(one, x)", "value(x, do, param)"], [], ["action_gate(do, human_approval)", "value(x, do, literal)"]),
    ("unsanitized_context_ingestion", "job do one x", [ACT, CALL, "call_effect(one, chain_write)", "call_input(one, y)", "call_input(two, x)", "call_output(two, y)", "value(x, do, untrusted)"], ["value(y, do, derived)", "call(two, do)"], []),
    ("unsanitized_context_ingestion", "job do one x", [ACT, CALL, "call_effect(one, proc_exec)", "call_input(one, y)", "action(other, job)", "call(two, other)", "call_output(two, x)", "call_region_untrusted(two)", "call_effect(two, db_read)", "action_param(do, name, y)"], ["value(y, do, derived)"], []),
    ("implicit_egress_channels", "job do one secret x", [ACT, CALL, "call_effect(one, net_write)", "call_region_untrusted(one)", "call_input(one, x)", "value(x, do, secret)"], [], ["action_gate(do, human_approval)"]),
    ("implicit_egress_channels", "job do one sensitive_local x", [ACT, CALL, "call_effect(one, agent_call)", "call_region_untrusted(one)", "call_input(one, x)", "value(x, do, sensitive_local)"], [], ["action_gate(do, human_approval)"]),
    ("sensitive_local_resource_overreach", "job do one secret x", [ACT, CALL, "call_input(one, x)", "value(x, do, secret)"], [], ["value_secret_allowed_action(x, do)"]),
    ("sensitive_local_resource_overreach", "job do one sensitive_local x", [ACT, CALL, "call_input(one, x)", "value(x, do, sensitive_local)", "call_effect(one, net_write)", "call_region_untrusted(one)"], ["value_sensitive_allowed_action(x, do)"], []),
    ("sensitive_local_resource_overreach", "job do one secret x", [ACT, CALL, "call_input(one, x)", "value(x, do, secret)", "call_input(one, q)", "value(q, do, param)"], ["value_secret_allowed_action(x, do)"], ["action_gate(do, human_approval)"]),
    ("ungated_irreversible_operation", "job do one", [ACT, CALL, "call_effect(one, crypto_sign)"], [], ["action_gate(do, allowlist)", "action_gate(do, human_approval)"]),
    ("hardcoded_c2_communication", "job do one x", [ACT, CALL, "call_effect(one, net_write)", "call_region(one, x)", "call_region_untrusted(one)", "call_code(one, unresolved_target)"], [], []),
    ("shadow_credentials", "job do one secret", [ACT, CALL, "call_effect(one, env_read)", "call_region_secret(one)", "call(two, do)", "call_effect(two, net_write)", "call_region_untrusted(two)"], [], []),
    ("shadow_credentials", "job do one sensitive_local", [ACT, CALL, "call_effect(one, db_read)", "call_region_sensitive(one)", "call(two, do)", "call_effect(two, agent_call)", "call_region_untrusted(two)"], [], []),
    ("obfuscation", "job do one encoded_binary", [ACT, CALL, "call_code(one, encoded_binary)"], [], []),
    ("dormant_malicious_payload", "job do one remote_killswitch", [ACT, CALL, "call_effect(one, code_eval)", "call_conditional(two, one, x)", "value(x, do, untrusted)"], [], []),
    ("dormant_malicious_payload", "job do one obfuscated", [ACT, CALL, "call_code(one, obfuscated)"], [], []),
    ("dormant_malicious_payload", "job do one dead_obfuscated", [ACT, CALL, "call_code(one, obfuscated)", "call_unconditional(two, one)"], ["call(two, do)", "call_unconditional(one, two)"], []),
    # what calls put out counts as untrusted for a sink, not as the mark that these two rules ask for
    ("hardcoded_c2_communication", None, [], [ACT, CALL, "call_effect(one, net_read)", "call_region(one, x)", "call_input(one, x)", "value(x, do, untrusted)", "call_code(one, unresolved_target)"], []),
    ("unverifiable_dependency_source", None, [], [ACT, CALL, "call(two, do)", "call_effect(one, net_read)", "call_output(one, x)", "call_input(two, x)", "value(x, do, untrusted)", "call_effect(two, proc_exec)"], []),
]


def cases():
    for label, row, needed, held, stops in RULES:
        yield label, row, needed + held, row is not None
        for gone in needed:
            yield label, row, [f for f in needed if f != gone] + held, False
        for stop in stops:
            yield label, row, [*needed, *held, stop], False


def text_of(facts):
    return "".join(f"{f}.\n" for f in facts)


@pytest.fixture(scope="module")
def rows(spark):
    facts = scan(spark.createDataFrame([(p, text_of(case[2])) for p, case in enumerate(cases())], "p long, text string"))
    assert facts.where("class <> 'core'").count() == 0
    return {(r.p, r.label, " ".join(r.fields)) for r in audit(facts, "findings_all").collect()}


@pytest.mark.parametrize(("p", "case"), list(enumerate(cases())))
def test_rule(rows, p, case):
    label, row, _, fires = case
    if row is None:
        assert not any((n, x) == (p, label) for n, x, _ in rows)
    else:
        assert ((p, label, row) in rows) == fires


def test_fields_stay_apart(spark):
    facts = scan(spark.createDataFrame([(1, 'action("a|b", "s|1").\ncall("c", "a|b").\ncall_code("c", obfuscated).\n')], "p long, text string"))
    assert ["s|1", "a|b", "c", "obfuscated"] in [r.fields for r in audit(facts, "findings_all").where("label = 'obfuscation'").collect()]


def test_single_skill(spark):
    texts = [(1, "skill(k).\n"), (2, "action(go, k).\n"), (3, "skill(k).\nskill(k).\n"), (4, "skill(k).\nskill(l).\n")]
    facts = scan(spark.createDataFrame(texts, "p long, text string"))
    assert {tuple(r) for r in audit(facts, "check_single").collect()} == {(2, "SDL005", 0), (3, "SDL005", 2), (4, "SDL005", 2)}


def test_last_declaration_holds(spark):
    two = ["call(x, a)", "call(x, b)", "call(y, b)", "call_unconditional(x, y)", "value(v, a, secret)", "value(v, a, local)"]
    facts = scan(spark.createDataFrame([(1, text_of(two)), (2, text_of([two[1], two[0], *two[2:4], two[5], two[4]]))], "p long, text string"))
    assert [r.p for r in audit(facts, "check_cross").collect()] == [2]
    assert [r.p for r in audit(facts, "check_policy").collect()] == [2]


def test_availability(spark):
    texts = [
        ["skill(s)"],
        ["call(c, a)", "value(v, a, local)", "call_input(c, v)", "call_input(ghost, v)"],
        ["call(c, a)", "call(d, a)", "call(e, a)", "call_unconditional(c, d)", "call_conditional(d, e, q)", "call_output(c, v)", "call_input(e, v)", "call_input(c, v)", "call_input(d, z)", "action_param(a, n, z)"],
    ]
    facts = scan(spark.createDataFrame([(p, text_of(t)) for p, t in enumerate(texts)], "p long, text string"))
    assert {r.p: r.availability for r in audit(facts, "metric_availability").collect()} == {0: 1.0, 1: 0.5, 2: round(2 / 3, 6)}


def test_unreachable_calls_are_listed(spark):
    text = text_of(["call(a, x)", "call(d, x)", "call(b, x)", "call_unconditional(d, b)", "call_unconditional(b, d)"])
    facts = scan(spark.createDataFrame([(1, text)], "p long, text string"))
    assert [tuple(r) for r in audit(facts, "check_unreachable").collect()] == [(1, "SDL033", "x", "b, d")]
