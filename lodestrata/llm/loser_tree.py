"""Loser trees: merging many sorted runs with one comparison a level."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class _End:
    """Above every key."""

    def __lt__(self, other) -> bool:
        return False


END = _End()


def merged(runs: list[Iterable[tuple]], key) -> Iterator[tuple]:
    """The items of sorted ``runs`` in order of ``key``; equal keys keep the order of the runs."""
    sources = [iter(r) for r in runs]
    n = len(sources)
    if not n:
        return
    items = [next(s, None) for s in sources]
    keys = [END if x is None else key(x) for x in items]

    def less(a: int, b: int) -> bool:
        ka, kb = keys[a], keys[b]
        if ka is END or kb is END:
            return kb is END and ka is not END
        return ka < kb or (not kb < ka and a < b)

    # leaves n..2n-1 are the runs, node i holds the loser of its match, node 0 the winner
    tree, winners = [0] * n, [0] * n + list(range(n))
    for i in range(n - 1, 0, -1):
        a, b = winners[2 * i], winners[2 * i + 1]
        winners[i], tree[i] = (a, b) if less(a, b) else (b, a)
    champion = winners[1] if n > 1 else 0
    while keys[champion] is not END:
        yield items[champion]
        items[champion] = x = next(sources[champion], None)
        keys[champion] = END if x is None else key(x)
        node = (champion + n) // 2
        while node:
            if less(tree[node], champion):
                champion, tree[node] = tree[node], champion
            node //= 2


def merged_front_coded(runs: list[list[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Merges front-coded runs of byte strings without comparing known prefixes again.

    A run holds (lcp, rest, payload): a string is the first ``lcp`` bytes of the
    string before it in the run, then ``rest``. The merged order is coded in the
    same way. For every run in the tree the common prefix of its head with the
    last winner that passed it is known; of two heads the one with the longer
    known prefix is smaller, and only if these are equal are bytes compared, from
    there on.
    """
    n = len(runs)
    if not n:
        return
    at = [0] * n
    heads: list[bytes | None] = [r[0][1] if r else None for r in runs]
    known = [0] * n  # of each head with the last winner that it met

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        ha, hb = heads[a], heads[b]
        if ha is None or hb is None:
            return (b, a) if ha is None else (a, b)
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ha == hb:
            known[b if a < b else a] = len(ha)
            return (a, b) if a < b else (b, a)
        i, end = ka, min(len(ha), len(hb))
        while i < end and ha[i] == hb[i]:
            i += 1
        a_first = i == len(ha) or (i < len(hb) and ha[i] < hb[i])
        known[b if a_first else a] = i
        return (a, b) if a_first else (b, a)

    tree, winners = [0] * n, [0] * n + list(range(n))
    for i in range(n - 1, 0, -1):
        winners[i], tree[i] = play(winners[2 * i], winners[2 * i + 1])
    champion = winners[1] if n > 1 else 0
    lcp = 0
    while heads[champion] is not None:
        head = heads[champion]
        yield lcp, head[lcp:], runs[champion][at[champion]][2]
        at[champion] += 1
        if at[champion] < len(runs[champion]):
            k, rest, _ = runs[champion][at[champion]]
            heads[champion], known[champion] = head[:k] + rest, k
        else:
            heads[champion], known[champion] = None, 0
        node = (champion + n) // 2
        while node:
            champion, tree[node] = play(champion, tree[node])
            node //= 2
        lcp = known[champion]


def front_coded(strings: Iterable[tuple[bytes, object]]) -> list[tuple[int, bytes, object]]:
    """Codes sorted strings."""
    out, before = [], b""
    for s, payload in strings:
        i, end = 0, min(len(s), len(before))
        while i < end and s[i] == before[i]:
            i += 1
        out.append((i, s[i:], payload))
        before = s
    return out
