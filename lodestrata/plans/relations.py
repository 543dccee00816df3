"""The rule library and the integrity checks: derived relations as set-valued SQL over facts.

``p`` is in the keys of every join and anti join, so programs never mix.
``reachable_call``, ``unconditional_reach`` and ``data_flows`` are fixpoints; see
``lodestrata.operators.closure`` for how Spark computes them.
"""

from __future__ import annotations

from lodestrata.sources.table_facts import CLAIMS, CODES, EFFECTS, GATES, TRIGGERS, VALUE_KINDS


def _in(names: str) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names.split()) + ")"


# The effects that each claim rules out, and parts of names that tell a secret.
BLOCKS = {
    "read_only": "chain_write crypto_sign db_write env_write fs_write net_write",
    "local_only": "agent_call chain_write net_read net_write",
    "no_network": "agent_call net_read net_write",
    "no_fs_write": "fs_write",
}
_SECRET_NAMES = "password token secret api_key apikey mnemonic".split()
_BLOCKED = " UNION ALL ".join(f"SELECT '{c}' AS claim, '{e}' AS kind" for c, effects in BLOCKS.items() for e in effects.split())

DERIVED: dict[str, str] = {
    "edge": "SELECT p, c1, c2 FROM call_unconditional UNION SELECT p, c1, c2 FROM call_conditional",
    "root_call": "SELECT DISTINCT p, c FROM call k WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.p = k.p AND e.c2 = k.c)",
    "leaf_call": "SELECT DISTINCT p, c FROM call k WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.p = k.p AND e.c1 = k.c)",
    "action_output_value": "SELECT DISTINCT p, a, v FROM leaf_call JOIN call USING (p, c) JOIN call_output USING (p, c)",
    "gated_action": "SELECT DISTINCT p, a FROM action_gate",
    "gate_strong": "SELECT DISTINCT p, a FROM action_gate WHERE kind = 'human_approval'",
    "flow_local": "SELECT DISTINCT i.p, i.v AS v1, o.v AS v2 FROM call_input i JOIN call_output o ON i.p = o.p AND i.c = o.c",
    "flow_param": "SELECT DISTINCT p, m.v AS v1, i.v AS v2 FROM action_param m JOIN call USING (p, a) JOIN root_call USING (p, c) JOIN call_input i USING (p, c)",
    "flow_edge": "SELECT DISTINCT e.p, o.v AS v1, i.v AS v2 FROM edge e JOIN call_output o ON o.p = e.p AND o.c = e.c1 JOIN call_input i ON i.p = e.p AND i.c = e.c2",
    "flow_arg": "SELECT DISTINCT p, v1, v2 FROM call_action_arg",
    "flow_callee": "SELECT DISTINCT k.p, w.v AS v1, o.v AS v2 FROM call_action k JOIN action_output_value w ON w.p = k.p AND w.a = k.a JOIN call_output o ON o.p = k.p AND o.c = k.c",
    "flow_cross": "SELECT DISTINCT x.p, w.v AS v1, m.v AS v2 FROM action x JOIN action y ON x.p = y.p AND x.s = y.s AND x.a <> y.a JOIN action_output_value w ON w.p = x.p AND w.a = x.a JOIN action_param m ON m.p = y.p AND m.a = y.a",
    "flow_base": " UNION ".join(f"SELECT p, v1, v2 FROM flow_{k}" for k in ("local", "param", "edge", "arg", "callee", "cross")),
    "value_reaches": "SELECT p, v AS v1, v AS v2 FROM value UNION SELECT p, v, v FROM action_param UNION SELECT p, v1, v2 FROM data_flows",
    "untrusted_source": "SELECT p, v FROM value WHERE kind IN ('param', 'untrusted') UNION SELECT p, m.v FROM action_param m JOIN action_trigger t USING (p, a) WHERE t.kind IN ('external', 'on_import', 'on_install')"
    " UNION SELECT p, v FROM call_output JOIN call_region_untrusted USING (p, c) JOIN call_effect e USING (p, c) WHERE e.kind IN ('net_read', 'agent_call', 'fs_read', 'db_read', 'env_read')",
    "sensitive_source": "SELECT p, v FROM value WHERE kind = 'sensitive_local' UNION SELECT p, v FROM call_output JOIN call_region_sensitive USING (p, c)",
    "secret_source": "SELECT p, v FROM value WHERE kind = 'secret' UNION SELECT p, v FROM call_output JOIN call_region_secret USING (p, c) UNION SELECT p, v FROM action_param WHERE " + " OR ".join(f"name LIKE '%{n.replace('_', '!_')}%' ESCAPE '!'" for n in _SECRET_NAMES),
    # what sources of a kind reach, forward: themselves where declared, and from their next values on
    "declared": "SELECT p, v FROM value UNION SELECT p, v FROM action_param",
    "flow_pair": "SELECT p, v1 AS c1, v2 AS c2 FROM flow_base",
    **{
        f"{k}_start": f"SELECT p, v AS c FROM {k}_source JOIN declared USING (p, v)"
        f" UNION SELECT f.p, f.c2 FROM flow_pair f JOIN {k}_source s ON s.p = f.p AND s.v = f.c1"
        for k in ("untrusted", "sensitive", "secret")
    },
    **{f"value_{k}": f"SELECT p, c AS v FROM {k}_reach" for k in ("untrusted", "sensitive", "secret")},
    "acall": "SELECT p, s, a, c FROM action JOIN call USING (p, a)",
    "call_in_untrusted_region": "SELECT p, c FROM call_region_untrusted UNION SELECT p, c FROM call_input JOIN value_untrusted USING (p, v)",
    "high_priv_call": "SELECT p, c FROM call_effect WHERE kind IN ('proc_exec', 'code_eval', 'chain_write', 'crypto_sign') UNION SELECT p, c FROM call_effect JOIN call_in_untrusted_region USING (p, c) WHERE kind = 'net_write'",
    "egress_call": "SELECT DISTINCT p, c FROM call_effect JOIN call_in_untrusted_region USING (p, c) WHERE kind IN ('net_write', 'agent_call')",
    "skill_egress": "SELECT DISTINCT p, s FROM acall JOIN egress_call USING (p, c)",
    "claim_blocks": f"SELECT DISTINCT p, s, b.claim, b.kind FROM skill_doc_claim d JOIN ({_BLOCKED}) b ON b.claim = d.claim",
    "source_kind": "SELECT p, v, 'secret' AS kind FROM secret_source UNION SELECT p, v, 'sensitive_local' FROM sensitive_source",
    # sink value, and a source that reaches it, of each call
    "call_reached": "SELECT DISTINCT i.p, i.c, i.v AS sink, r.v1 AS src FROM call_input i JOIN value_reaches r ON r.p = i.p AND r.v2 = i.v",
}
# Whether a call has an untrusted (sink, src) that differs from a given one in both needs five of them at most: any first
# one; if the given one shares its sink, one of another sink and one that differs from that in its source too; and the same
# with sinks and sources changed about.
_FIRST = "SELECT x.p, x.c, min(struct(x.sink, x.src)) AS w FROM untrusted_reached x {} GROUP BY x.p, x.c"
_AFTER = "JOIN witness_{} y ON y.p = x.p AND y.c = x.c AND y.w.{} <> x.{}"
DERIVED |= {
    "untrusted_reached": "SELECT DISTINCT t.p, t.c, t.sink, t.src FROM call_reached t JOIN untrusted_source u ON u.p = t.p AND u.v = t.src",
    "witness_1": _FIRST.format(""),
    "witness_2": _FIRST.format(_AFTER.format(1, "sink", "sink")),
    "witness_3": _FIRST.format(_AFTER.format(1, "src", "src")),
    "witness_4": _FIRST.format(_AFTER.format(1, "sink", "sink") + " JOIN witness_2 z ON z.p = x.p AND z.c = x.c AND z.w.src <> x.src"),
    "witness_5": _FIRST.format(_AFTER.format(1, "src", "src") + " JOIN witness_3 z ON z.p = x.p AND z.c = x.c AND z.w.sink <> x.sink"),
    "witness": " UNION ".join(f"SELECT p, c, w.sink, w.src FROM witness_{i}" for i in range(1, 6)),
}
_OPEN = "NOT EXISTS (SELECT 1 FROM gate_strong g WHERE g.p = k.p AND g.a = k.a)"
DERIVED |= {
    "label_dangerous_execution_primitives": "SELECT DISTINCT k.p, s, a, c FROM acall k JOIN call_effect e USING (p, c) WHERE e.kind IN ('proc_exec', 'code_eval') AND (EXISTS (SELECT 1 FROM call_in_untrusted_region u WHERE u.p = k.p AND u.c = k.c) OR EXISTS (SELECT 1 FROM call_code d WHERE d.p = k.p AND d.c = k.c AND d.kind IN ('encoded_binary', 'obfuscated')))"
    " UNION SELECT x.p, y.s, y.a, y.c FROM acall x JOIN edge e ON e.p = x.p AND e.c1 = x.c JOIN acall y ON y.p = e.p AND y.c = e.c2 AND y.a = x.a AND y.s = x.s JOIN call_effect f ON f.p = x.p AND f.c = x.c AND f.kind = 'net_read' JOIN call_effect g ON g.p = y.p AND g.c = y.c AND g.kind = 'proc_exec'",
    "label_behavior_claim_contradiction": "SELECT DISTINCT p, s, a, c, claim, kind FROM acall JOIN call_effect USING (p, c) JOIN claim_blocks USING (p, s, kind)",
    "label_unverifiable_dependency_source": "SELECT DISTINCT x.p, x.s, x.a, y.c AS exec, x.c AS src FROM acall x JOIN call_region_untrusted u ON u.p = x.p AND u.c = x.c JOIN call_effect f ON f.p = x.p AND f.c = x.c AND f.kind IN ('net_read', 'agent_call') JOIN call_output o ON o.p = x.p AND o.c = x.c JOIN call_reached r ON r.p = o.p AND r.src = o.v JOIN acall y ON y.p = r.p AND y.c = r.c AND y.a = x.a AND y.s = x.s AND y.c <> x.c JOIN call_effect g ON g.p = y.p AND g.c = y.c AND g.kind IN ('proc_exec', 'code_eval')"
    " UNION SELECT k.p, k.s, k.a, k.c, k.c FROM acall k JOIN call_region_untrusted u ON u.p = k.p AND u.c = k.c JOIN call_code d ON d.p = k.p AND d.c = k.c AND d.kind = 'unresolved_target' JOIN call_effect e ON e.p = k.p AND e.c = k.c AND e.kind IN ('proc_exec', 'code_eval', 'net_read')",
    "label_unsanitized_context_ingestion": f"SELECT DISTINCT k.p, k.s, k.a, k.c, r.src FROM acall k JOIN high_priv_call h ON h.p = k.p AND h.c = k.c JOIN call_reached r ON r.p = k.p AND r.c = k.c JOIN untrusted_source u ON u.p = r.p AND u.v = r.src WHERE {_OPEN} AND NOT EXISTS (SELECT 1 FROM value w WHERE w.p = r.p AND w.v = r.sink AND w.kind = 'literal')",
    "label_implicit_egress_channels": f"SELECT DISTINCT k.p, k.s, k.a, k.c, q.kind, r.src FROM acall k JOIN egress_call h ON h.p = k.p AND h.c = k.c JOIN call_reached r ON r.p = k.p AND r.c = k.c JOIN source_kind q ON q.p = r.p AND q.v = r.src WHERE {_OPEN}",
    "label_sensitive_local_resource_overreach": "SELECT DISTINCT k.p, k.s, k.a, k.c, q.kind, r.src FROM acall k JOIN egress_call h ON h.p = k.p AND h.c = k.c JOIN call_reached r ON r.p = k.p AND r.c = k.c JOIN source_kind q ON q.p = r.p AND q.v = r.src"
    " UNION SELECT k.p, k.s, k.a, k.c, q.kind, r.src FROM acall k JOIN call_reached r ON r.p = k.p AND r.c = k.c JOIN source_kind q ON q.p = r.p AND q.v = r.src WHERE NOT EXISTS (SELECT 1 FROM (SELECT p, v, a, 'secret' AS kind FROM value_secret_allowed_action UNION ALL SELECT p, v, a, 'sensitive_local' FROM value_sensitive_allowed_action) l WHERE l.p = k.p AND l.v = r.src AND l.a = k.a AND l.kind = q.kind)"
    f" UNION SELECT k.p, k.s, k.a, k.c, q.kind, r.src FROM acall k JOIN call_reached r ON r.p = k.p AND r.c = k.c JOIN source_kind q ON q.p = r.p AND q.v = r.src JOIN witness t ON t.p = r.p AND t.c = r.c AND t.sink <> r.sink AND t.src <> r.src WHERE {_OPEN}",
    "label_ungated_irreversible_operation": "SELECT DISTINCT k.p, k.s, k.a, k.c FROM acall k JOIN high_priv_call h ON h.p = k.p AND h.c = k.c WHERE NOT EXISTS (SELECT 1 FROM gated_action g WHERE g.p = k.p AND g.a = k.a)",
    "label_hardcoded_c2_communication": "SELECT DISTINCT k.p, k.s, k.a, k.c, t.v AS target FROM acall k JOIN call_effect e ON e.p = k.p AND e.c = k.c AND e.kind IN ('net_read', 'net_write') JOIN call_region t ON t.p = k.p AND t.c = k.c JOIN call_region_untrusted u ON u.p = k.p AND u.c = k.c JOIN call_code d ON d.p = k.p AND d.c = k.c AND d.kind = 'unresolved_target'",
    "label_shadow_credentials": "SELECT DISTINCT k.p, k.s, k.a, k.c, q.kind FROM acall k JOIN call_effect e ON e.p = k.p AND e.c = k.c AND e.kind IN ('fs_read', 'fs_list', 'env_read', 'db_read') JOIN (SELECT p, c, 'secret' AS kind FROM call_region_secret UNION ALL SELECT p, c, 'sensitive_local' FROM call_region_sensitive) q ON q.p = k.p AND q.c = k.c JOIN skill_egress g ON g.p = k.p AND g.s = k.s",
    "label_obfuscation": "SELECT DISTINCT k.p, k.s, k.a, k.c, d.kind AS code FROM acall k JOIN call_code d ON d.p = k.p AND d.c = k.c WHERE d.kind IN ('obfuscated', 'encoded_binary')",
    "label_dormant_malicious_payload": "SELECT DISTINCT k.p, k.s, k.a, k.c, 'remote_killswitch' AS pattern FROM acall k JOIN high_priv_call h ON h.p = k.p AND h.c = k.c JOIN call_conditional d ON d.p = k.p AND d.c2 = k.c JOIN value_untrusted u ON u.p = d.p AND u.v = d.v"
    " UNION SELECT k.p, k.s, k.a, k.c, d.kind FROM acall k JOIN call_code d ON d.p = k.p AND d.c = k.c WHERE d.kind IN ('obfuscated', 'encoded_binary')"
    " UNION SELECT k.p, k.s, k.a, k.c, concat('dead_', d.kind) FROM acall k JOIN call_code d ON d.p = k.p AND d.c = k.c WHERE d.kind IN ('obfuscated', 'encoded_binary') AND NOT EXISTS (SELECT 1 FROM reachable_call r WHERE r.p = k.p AND r.c = k.c)",
}
#: Fields of each label, in the order of its columns.
FIELDS = {
    "label_dangerous_execution_primitives": "s a c", "label_behavior_claim_contradiction": "s a c claim kind", "label_unverifiable_dependency_source": "s a exec src", "label_unsanitized_context_ingestion": "s a c src",
    "label_implicit_egress_channels": "s a c kind src", "label_sensitive_local_resource_overreach": "s a c kind src", "label_ungated_irreversible_operation": "s a c", "label_hardcoded_c2_communication": "s a c target",
    "label_shadow_credentials": "s a c kind", "label_obfuscation": "s a c code", "label_dormant_malicious_payload": "s a c pattern",
}
DERIVED["findings_all"] = " UNION ALL ".join(f"SELECT p, '{label[6:]}' AS label, concat_ws('|', {', '.join(f.split())}) AS fields, 'warning' AS severity FROM {label}" for label, f in FIELDS.items())
DERIVED["label_summary"] = "SELECT label, count(*) AS n_findings, count(DISTINCT p) AS n_programs FROM findings_all GROUP BY label"


def _missing(code: str, relation: str, key: str, target: str, target_key: str) -> str:
    return f"SELECT DISTINCT r.p, '{code}' AS code, '{relation}' AS relation, r.{key} AS subject FROM {relation} r WHERE NOT EXISTS (SELECT 1 FROM {target} t WHERE t.p = r.p AND t.{target_key} = r.{key})"


def _outside(code: str, relation: str, column: str, names: str) -> str:
    return f"SELECT DISTINCT p, '{code}' AS code, '{relation}' AS relation, {column} AS subject FROM {relation} WHERE {column} NOT IN {_in(names)}"


_ABOUT_CALLS = "call_effect call_code call_action call_action_arg call_region call_input call_output call_region_untrusted call_region_sensitive call_region_secret".split()
DERIVED |= {
    "check_single": "SELECT p, 'SDL005' AS code, count(*) AS n FROM skill GROUP BY p HAVING count(*) <> 1",
    "check_fk": " UNION ALL ".join([
        _missing("SDL010", "action", "s", "skill", "s"), *(_missing("SDL011", r, "a", "action", "a") for r in ("action_trigger", "action_gate", "action_param")), _missing("SDL012", "call", "a", "action", "a"),
        *(_missing("SDL013", r, "c", "call", "c") for r in _ABOUT_CALLS), *(_missing("SDL014", r, c, "call", "c") for r in ("call_unconditional", "call_conditional") for c in ("c1", "c2")),
        _missing("SDL015", "call_action", "a", "action", "a"), _missing("SDL016", "value", "a", "action", "a"),
        *(_missing(code, r, k, t, k) for r in ("value_sensitive_allowed_action", "value_secret_allowed_action") for code, k, t in (("SDL017", "v", "value"), ("SDL018", "a", "action"))),
    ]),
    "check_enum": " UNION ALL ".join([_outside("SDL020", "call_effect", "kind", EFFECTS), _outside("SDL021", "action_trigger", "kind", TRIGGERS), _outside("SDL022", "skill_doc_claim", "claim", CLAIMS), _outside("SDL023", "value", "kind", VALUE_KINDS), _outside("SDL024", "call_code", "kind", CODES), _outside("SDL025", "action_gate", "kind", GATES)]),
    "check_cross": "SELECT DISTINCT e.p, 'SDL031' AS code, e.c1, e.c2 FROM edge e JOIN call_home x ON x.p = e.p AND x.c = e.c1 JOIN call_home y ON y.p = e.p AND y.c = e.c2 WHERE x.a <> y.a",
    "inner_root": "SELECT DISTINCT k.p, k.a, k.c FROM call k WHERE NOT EXISTS (SELECT 1 FROM edge e JOIN call x ON x.p = e.p AND x.c = e.c1 WHERE e.p = k.p AND e.c2 = k.c AND x.a = k.a)",
    "check_root": "SELECT p, 'SDL032' AS code, a FROM call k WHERE NOT EXISTS (SELECT 1 FROM inner_root r WHERE r.p = k.p AND r.a = k.a) GROUP BY p, a HAVING count(DISTINCT c) >= 2",
    "inner_edge": "SELECT DISTINCT e.p, e.c1, e.c2 FROM edge e JOIN call x ON x.p = e.p AND x.c = e.c1 JOIN call y ON y.p = e.p AND y.c = e.c2 WHERE x.a = y.a",
    "check_unreachable": "SELECT k.p, 'SDL033' AS code, k.a, array_join(array_sort(collect_set(k.c)), ', ') AS calls FROM call k WHERE EXISTS (SELECT 1 FROM inner_root i WHERE i.p = k.p AND i.a = k.a) AND NOT EXISTS (SELECT 1 FROM inner_reach r WHERE r.p = k.p AND r.c = k.c) GROUP BY k.p, k.a",
    "used_value": " UNION ALL ".join(f"SELECT p, '{r}' AS relation, {v} AS v FROM {r}" for r, v in (("call_region", "v"), ("call_input", "v"), ("call_output", "v"), ("call_conditional", "v"), ("call_action_arg", "v1"), ("call_action_arg", "v2"))),
    "check_value_defined": "SELECT DISTINCT u.p, 'SDL040' AS code, u.relation, u.v FROM used_value u WHERE NOT EXISTS (SELECT 1 FROM value w WHERE w.p = u.p AND w.v = u.v) AND NOT EXISTS (SELECT 1 FROM action_param m WHERE m.p = u.p AND m.v = u.v)",
    "check_policy": " UNION ALL ".join(f"SELECT DISTINCT w.p, '{code}' AS code, w.v FROM value_kind w WHERE w.kind = '{kind}' AND NOT EXISTS (SELECT 1 FROM {allowed} l WHERE l.p = w.p AND l.v = w.v)" for code, kind, allowed in (("SDL050", "secret", "value_secret_allowed_action"), ("SDL051", "sensitive_local", "value_sensitive_allowed_action"))),
    "check_conflict": " UNION ALL ".join(f"SELECT p, '{code}' AS code, c FROM call_region_untrusted JOIN {r} USING (p, c)" for code, r in (("SDL060", "call_region_sensitive"), ("SDL061", "call_region_secret"))),
    # inputs that their call's action doesn't hold; what calls put out wanders along edges with each such value
    "input_asked": (
        "SELECT DISTINCT i.p, i.c, i.v FROM call_input i"
        " LEFT JOIN call_home k ON k.p = i.p AND k.c = i.c"
        " LEFT JOIN (SELECT p, a, v FROM action_param UNION SELECT p, a, v FROM value) h ON h.p = i.p AND h.a = k.a AND h.v = i.v"
        " WHERE h.v IS NULL"
    ),
    "passed_on": (
        "SELECT DISTINCT e.p, e.c2 AS c, o.v FROM edge e JOIN call_output o ON o.p = e.p AND o.c = e.c1"
        " JOIN (SELECT DISTINCT p, v FROM input_asked) q ON q.p = o.p AND q.v = o.v"
    ),
    "input_missing": "SELECT p, c, v FROM input_asked i WHERE NOT EXISTS (SELECT 1 FROM passed r WHERE r.p = i.p AND r.c = i.c AND r.v = i.v)",
    "metric_availability": (
        "SELECT g.p, round(coalesce(1 - CAST(m.n AS DOUBLE) / t.n, 1), 6) AS availability FROM program g"
        " LEFT JOIN (SELECT p, count(*) AS n FROM call_input GROUP BY p) t ON t.p = g.p"
        " LEFT JOIN (SELECT p, count(*) AS n FROM input_missing GROUP BY p) m ON m.p = g.p"
    ),
}

#: Fixpoints over p: what is reached from a relation of nodes along one of edges, and closures of pairs.
REACH = {"reachable_call": ("root_call", "edge"), "unconditional_reach": ("root_call", "call_unconditional"), "inner_reach": ("inner_root", "inner_edge"), "passed": ("passed_on", "edge")}
REACH |= {f"{k}_reach": (f"{k}_start", "flow_pair") for k in ("untrusted", "sensitive", "secret")}
CLOSURES = {"data_flows": ("flow_base", "v1", "v2"), "call_before": ("edge", "c1", "c2")}

#: What DuckDB is asked instead of the rule's own text: the same relation by another way, after the definition of each.
_ALL_KINDS = {"SDL020": ("call_effect", "kind", EFFECTS), "SDL021": ("action_trigger", "kind", TRIGGERS), "SDL022": ("skill_doc_claim", "claim", CLAIMS), "SDL023": ("value", "kind", VALUE_KINDS), "SDL024": ("call_code", "kind", CODES), "SDL025": ("action_gate", "kind", GATES)}
APART = {
    "label_sensitive_local_resource_overreach": f"""
        SELECT DISTINCT k.p, k.s, k.a, k.c, q.kind, r.src
        FROM acall k
        JOIN call_reached r ON r.p = k.p AND r.c = k.c
        JOIN source_kind q ON q.p = r.p AND q.v = r.src
        LEFT JOIN (SELECT DISTINCT p, c, 1 AS out FROM egress_call) h ON h.p = k.p AND h.c = k.c
        LEFT JOIN (SELECT DISTINCT p, v, a, 'secret' AS kind, 1 AS may FROM value_secret_allowed_action
                   UNION ALL SELECT DISTINCT p, v, a, 'sensitive_local', 1 FROM value_sensitive_allowed_action) l
          ON l.p = k.p AND l.v = r.src AND l.a = k.a AND l.kind = q.kind
        WHERE h.out = 1 OR l.may IS NULL OR ({_OPEN} AND EXISTS (
          SELECT 1 FROM call_reached t JOIN untrusted_source u ON u.p = t.p AND u.v = t.src
          WHERE t.p = r.p AND t.c = r.c AND t.sink <> r.sink AND t.src <> r.src))""",
    "check_enum": " UNION ALL ".join(
        f"SELECT x.p, '{code}' AS code, '{r}' AS relation, x.k AS subject FROM (SELECT DISTINCT p, {column} AS k FROM {r}) x"
        f" LEFT JOIN (SELECT unnest(string_split('{names}', ' ')) AS k) y ON x.k = y.k WHERE y.k IS NULL"
        for code, (r, column, names) in _ALL_KINDS.items()
    ),
    "check_unreachable": """
        SELECT k.p, 'SDL033' AS code, k.a, string_agg(DISTINCT k.c, ', ' ORDER BY k.c) AS calls FROM call k
        LEFT JOIN inner_reach r ON r.p = k.p AND r.c = k.c
        WHERE r.c IS NULL AND (k.p, k.a) IN (SELECT p, a FROM inner_root) GROUP BY k.p, k.a""",
    "check_conflict": " UNION ALL ".join(
        f"SELECT p, '{code}' AS code, c FROM call_region_untrusted INTERSECT SELECT p, '{code}', c FROM {r}"
        for code, r in (("SDL060", "call_region_sensitive"), ("SDL061", "call_region_secret"))
    ),
    "check_policy": " UNION ALL ".join(
        f"SELECT p, '{code}' AS code, v FROM (SELECT p, v FROM value WHERE kind = '{kind}' EXCEPT SELECT p, v FROM {allowed})"
        for code, kind, allowed in (("SDL050", "secret", "value_secret_allowed_action"), ("SDL051", "sensitive_local", "value_sensitive_allowed_action"))
    ),
    "metric_availability": """
        SELECT g.p, round(coalesce(avg(CASE
            WHEN EXISTS (SELECT 1 FROM action_param m JOIN call k ON k.p = m.p AND k.a = m.a WHERE k.p = i.p AND k.c = i.c AND m.v = i.v) THEN 1.0
            WHEN EXISTS (SELECT 1 FROM value w JOIN call k ON k.p = w.p AND k.a = w.a WHERE k.p = i.p AND k.c = i.c AND w.v = i.v) THEN 1.0
            WHEN EXISTS (SELECT 1 FROM call_before b JOIN call_output o ON o.p = b.p AND o.c = b.v1 WHERE b.p = i.p AND b.v2 = i.c AND o.v = i.v) THEN 1.0
            WHEN i.c IS NOT NULL THEN 0.0 END), 1.0), 6) AS availability
        FROM program g LEFT JOIN call_input i ON i.p = g.p GROUP BY g.p""",
    "root_call": "SELECT p, c FROM call EXCEPT SELECT p, c2 FROM edge",
    "leaf_call": "SELECT p, c FROM call EXCEPT SELECT p, c1 FROM edge",
    "value_untrusted": "SELECT p, v2 AS v FROM value_reaches WHERE (p, v1) IN (SELECT p, v FROM untrusted_source) GROUP BY ALL",
    "value_sensitive": "SELECT p, v2 AS v FROM value_reaches WHERE (p, v1) IN (SELECT p, v FROM sensitive_source) GROUP BY ALL",
    "value_secret": "SELECT p, v2 AS v FROM value_reaches WHERE (p, v1) IN (SELECT p, v FROM secret_source) GROUP BY ALL",
    "skill_egress": "SELECT DISTINCT x.p, x.s FROM action x WHERE EXISTS (SELECT 1 FROM call k JOIN egress_call e ON e.p = k.p AND e.c = k.c WHERE k.p = x.p AND k.a = x.a)",
    "label_obfuscation": "SELECT p, s, a, c, kind AS code FROM call_code JOIN call USING (p, c) JOIN action USING (p, a) WHERE kind = 'obfuscated' UNION SELECT p, s, a, c, kind FROM call_code JOIN call USING (p, c) JOIN action USING (p, a) WHERE kind = 'encoded_binary'",
    "label_ungated_irreversible_operation": "SELECT p, s, a, c FROM action JOIN call USING (p, a) JOIN high_priv_call USING (p, c) WHERE (p, a) NOT IN (SELECT p, a FROM action_gate) GROUP BY ALL",
    "label_hardcoded_c2_communication": "SELECT p, s, a, c, v AS target FROM call_region JOIN call USING (p, c) JOIN action USING (p, a) WHERE (p, c) IN (SELECT p, c FROM call_region_untrusted INTERSECT SELECT p, c FROM call_code WHERE kind = 'unresolved_target' INTERSECT SELECT p, c FROM call_effect WHERE kind LIKE 'net!_%' ESCAPE '!') GROUP BY ALL",
    "check_value_defined": "SELECT u.p, 'SDL040' AS code, u.relation, u.v FROM used_value u LEFT JOIN (SELECT p, v FROM value UNION SELECT p, v FROM action_param) d ON d.p = u.p AND d.v = u.v WHERE d.v IS NULL GROUP BY ALL",
    "check_root": "SELECT p, 'SDL032' AS code, a FROM call GROUP BY p, a HAVING count(DISTINCT c) >= 2 AND (p, a) NOT IN (SELECT p, a FROM inner_root)",
}
