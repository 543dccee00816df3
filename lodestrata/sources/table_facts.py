"""Facts of many programs derived from the driver tables, as SQL that Spark and DuckDB both run.

Every relation leads with ``p``, the program; ids are strings and only unique in
their program. A program is five customers; its actions are customers, its calls
are orders, its values are eight slots a customer. ``order_facts`` gives those of
one program at once, from its orders.
"""

from __future__ import annotations

from collections import defaultdict


def _pick(expression: str, names: str) -> str:
    """The name at the place that an integer expression gives."""
    return "CASE " + expression + "".join(f" WHEN {i} THEN '{n}'" for i, n in enumerate(names.split())) + " END"


# The kinds that facts can name.
EFFECTS = "action_call agent_call chain_write code_eval crypto_sign db_read db_write env_read env_write fs_list fs_read fs_write net_read net_write proc_exec stdout"
TRIGGERS = "external llm on_import on_install"
GATES = "allowlist budget_limit confirmation_prompt credential_bound human_approval"
CLAIMS = "credential_bound local_only no_fs_write no_network read_only"
VALUE_KINDS = "derived literal local param secret sensitive_local untrusted"
#: Kind of each slot of a customer's values.
SLOTS = "param untrusted secret sensitive_local literal derived local local"
CODES = "encoded_binary inline_code obfuscated script shell unresolved_target"

FACTS: dict[str, str] = {
    "orders_": "SELECT CAST(floor(o_custkey / 5) AS BIGINT) AS p, o_custkey AS cust, o_orderkey AS ok, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pv FROM orders",
    "customers_": "SELECT p, cust, lead(cust) OVER (PARTITION BY p ORDER BY cust) AS following FROM (SELECT DISTINCT p, cust FROM orders_) q",
    "items_": "SELECT DISTINCT p, cust, ok, l_partkey % 8 AS slot, l_linenumber % 2 AS side FROM lineitem JOIN orders_ ON l_orderkey = ok",
    "skill": "SELECT DISTINCT p, CAST(p AS STRING) AS s FROM orders_",
    "skill_doc_claim": f"SELECT DISTINCT p, CAST(p AS STRING) AS s, {_pick('p % 5', CLAIMS)} AS claim FROM orders_",
    "action": "SELECT p, CAST(cust AS STRING) AS a, CAST(p AS STRING) AS s FROM customers_",
    "action_trigger": f"SELECT p, CAST(cust AS STRING) AS a, {_pick('cust % 4', TRIGGERS)} AS kind FROM customers_",
    "action_gate": f"SELECT p, CAST(cust AS STRING) AS a, {_pick('cust % 7', GATES)} AS kind FROM customers_ WHERE cust % 7 < 5",
    "action_param": f"SELECT p, CAST(cust AS STRING) AS a, {_pick('cust % 3', 'user_password path query')} AS name, CAST(cust * 8 AS STRING) AS v FROM customers_",
    "call": "SELECT p, CAST(ok AS STRING) AS c, CAST(cust AS STRING) AS a FROM orders_",
    "call_effect": f"SELECT p, CAST(ok AS STRING) AS c, {_pick('ok % 16', EFFECTS)} AS kind FROM orders_",
    "call_code": f"SELECT p, CAST(ok AS STRING) AS c, {_pick('ok % 11', CODES)} AS kind FROM orders_ WHERE ok % 11 < 6",
    "call_unconditional": "SELECT p, CAST(ok AS STRING) AS c1, CAST(nx AS STRING) AS c2 FROM orders_ WHERE nx IS NOT NULL AND ok % 3 <> 0 UNION SELECT l.p, CAST(l.ok AS STRING), CAST(f.ok AS STRING) FROM orders_ l JOIN orders_ f ON l.cust = f.cust WHERE l.nx IS NULL AND f.pv IS NULL AND l.cust % 7 = 0 AND l.ok <> f.ok",
    "call_conditional": "SELECT p, CAST(ok AS STRING) AS c1, CAST(nx AS STRING) AS c2, CAST(cust * 8 + ok % 8 AS STRING) AS v FROM orders_ WHERE nx IS NOT NULL AND ok % 3 = 0",
    "call_region": "SELECT p, CAST(ok AS STRING) AS c, CAST(cust * 8 + ok % 8 AS STRING) AS v FROM orders_ WHERE ok % 5 = 0",
    "call_region_untrusted": "SELECT p, CAST(ok AS STRING) AS c FROM orders_ WHERE ok % 4 = 0",
    "call_region_sensitive": "SELECT p, CAST(ok AS STRING) AS c FROM orders_ WHERE ok % 6 = 0",
    "call_region_secret": "SELECT p, CAST(ok AS STRING) AS c FROM orders_ WHERE ok % 9 = 0",
    "call_input": "SELECT DISTINCT p, CAST(ok AS STRING) AS c, CAST(cust * 8 + slot AS STRING) AS v FROM items_ WHERE side = 1",
    "call_output": "SELECT DISTINCT p, CAST(ok AS STRING) AS c, CAST(cust * 8 + slot AS STRING) AS v FROM items_ WHERE side = 0",
    "value": f"SELECT DISTINCT p, CAST(cust * 8 + slot AS STRING) AS v, CAST(cust AS STRING) AS a, {_pick('slot', SLOTS)} AS kind FROM items_ WHERE slot < 7 OR cust % 10 <> 0",
    "call_action": "SELECT o.p, CAST(ok AS STRING) AS c, CAST(following AS STRING) AS a FROM orders_ o JOIN customers_ k ON o.cust = k.cust WHERE nx IS NULL AND following IS NOT NULL",
    "call_action_arg": "SELECT i.p, i.c, i.v AS v1, CAST(CAST(k.a AS BIGINT) * 8 AS STRING) AS v2 FROM call_output i JOIN call_action k ON i.p = k.p AND i.c = k.c",
    "value_sensitive_allowed_action": "SELECT p, CAST(cust * 8 + 3 AS STRING) AS v, CAST(cust AS STRING) AS a FROM customers_ WHERE cust % 2 = 0",
    "value_secret_allowed_action": "SELECT p, CAST(cust * 8 + 2 AS STRING) AS v, CAST(cust AS STRING) AS a FROM customers_ WHERE cust % 3 = 0",
    "program": "SELECT DISTINCT p FROM orders_",
    # of repeated declarations the last holds; here none is repeated
    "call_home": "SELECT p, c, a FROM call",
    "value_kind": "SELECT p, v, kind FROM value",
}

#: Items of an order as bits, four for each slot (from -7, as remainders keep their sign): sides -1, 0, 1, and none.
ITEM_BITS = "SELECT l_orderkey AS item_of, bit_or(shiftleft(1L, CAST((l_partkey % 8 + 7) * 4 + coalesce(l_linenumber % 2 + 1, 3) AS INT))) AS items FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL GROUP BY l_orderkey"
#: Facts of an order at most, and of each of its items.
ORDER_FACTS, ITEM_FACTS = 9, 3


def _rest(x: int, n: int) -> int:
    """The remainder as SQL has it, with the sign of x."""
    return x % n if x >= 0 else -(-x % n)


def _named(i: int, names: list[str]) -> str | None:
    return names[i] if 0 <= i < len(names) else None


_EFFECTS, _TRIGGERS, _GATES, _CLAIMS, _SLOTS, _CODES, _PARAMS = (x.split() for x in (EFFECTS, TRIGGERS, GATES, CLAIMS, SLOTS, CODES, "user_password path query"))
#: Slot and side (2: none) of each bit.
_AT = [(i // 4 - 7, (-1, 0, 1, 2)[i % 4]) for i in range(60)]


def order_facts(p: int, orders: list[tuple], number: dict[str, int]) -> list[tuple]:
    """(k, x, y, z): the facts of ``FACTS`` of one program, those of the relations that ``number`` gives a k; from its
    orders (cust, ok, nx, pv, items) as of ``orders_`` and ``ITEM_BITS``. What a rule needs and is null makes no fact."""
    out: list[tuple] = []
    put = lambda relation, x, y=None, z=None: out.append((number[relation], x, y, z))
    skill = str(p)
    if claim := _named(_rest(p, 5), _CLAIMS):
        put("skill_doc_claim", skill, claim)
    customers = sorted({o[0] for o in orders})
    following = dict(zip(customers, customers[1:]))
    for cust in customers:
        a = str(cust)
        put("action", a, skill)
        if kind := _named(_rest(cust, 4), _TRIGGERS):
            put("action_trigger", a, kind)
        if kind := _named(_rest(cust, 7), _GATES):
            put("action_gate", a, kind)
        put("action_param", a, str(cust * 8), _named(_rest(cust, 3), _PARAMS))
        if cust % 2 == 0:
            put("value_sensitive_allowed_action", str(cust * 8 + 3), a)
        if cust % 3 == 0:
            put("value_secret_allowed_action", str(cust * 8 + 2), a)
    outputs, called = defaultdict(set), defaultdict(set)
    firsts, lasts, values = defaultdict(set), defaultdict(set), set()
    for cust, ok, nx, pv, items in orders:
        if ok is None:
            continue
        c = str(ok)
        put("call", c, str(cust))
        if kind := _named(_rest(ok, 16), _EFFECTS):
            put("call_effect", c, kind)
        if kind := _named(_rest(ok, 11), _CODES):
            put("call_code", c, kind)
        own = str(cust * 8 + _rest(ok, 8))
        if nx is not None:
            if ok % 3:
                put("call_unconditional", c, str(nx))
            else:
                put("call_conditional", c, str(nx), own)
        else:
            lasts[cust].add(ok)
            if cust in following:
                put("call_action", c, str(following[cust]))
                called[c].add(str(following[cust] * 8))
        if pv is None:
            firsts[cust].add(ok)
        if ok % 5 == 0:
            put("call_region", c, own)
        for n, relation in ((4, "call_region_untrusted"), (6, "call_region_sensitive"), (9, "call_region_secret")):
            if ok % n == 0:
                put(relation, c)
        while items:
            low = items & -items
            items ^= low
            slot, side = _AT[low.bit_length() - 1]
            v = str(cust * 8 + slot)
            if side == 1:
                put("call_input", c, v)
            elif side == 0:
                put("call_output", c, v)
                outputs[c].add(v)
            if slot < 7 or cust % 10:
                values.add((v, _named(slot, _SLOTS)))
    for v, kind in values:
        put("value", v, kind)
    for cust, found in lasts.items():
        if cust % 7 == 0:
            for x in found:
                for y in firsts[cust]:
                    if x != y:
                        put("call_unconditional", str(x), str(y))
    for c, targets in called.items():
        for v in outputs.get(c, ()):
            for w in targets:
                put("call_action_arg", v, w)
    return out
