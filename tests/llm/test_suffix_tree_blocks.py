"""Runs of op4 are counted in blocks: they lose no run, and take less room than rows of four numbers."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import suffix_tree_lm as lm

WORDS = [f"w{i}" for i in range(40)]


def texts(seed: int, n: int = 60) -> list[str]:
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, size=int(rng.integers(0, 90)), p=np.arange(40, 0, -1) / 820)) for _ in range(n)]


@pytest.mark.parametrize("length", [2, 3, 4])
@pytest.mark.parametrize("often", [0, 7])
def test_blocks_hold_all_runs(length, often):
    hashes = np.sort(lm.hashed_words([" ".join(WORDS).encode()])[0])
    frequent = SimpleNamespace(value=(hashes[:often],))
    every = SimpleNamespace(value=np.full(1 << 10, 2**64 - 1, dtype=np.uint64))
    groups: dict[int, list[bytes]] = {}
    wanted: Counter = Counter()
    size = 0
    for task in range(3):
        given, ids = texts(task), list(range(1000 * task, 1000 * task + 60))
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(given)], names=["doc_id", "text"])
        for made in lm._count_runs(length, every, frequent, parts=3, most=5)(iter([batch.slice(i, 5) for i in range(0, 60, 5)])):
            for part, block in zip(*(made.column(i).to_pylist() for i in (0, 1))):
                groups.setdefault(part, []).append(block)
                size += len(block)
        train = [t.encode() for t, out in zip(given, lm._is_held(ids)) if not out]
        symbols, _, place = lm.sequences(train)
        at = np.flatnonzero(place >= length - 1)
        context, key = lm._keys(symbols, length - 1)[at - 1], lm.runs(symbols, length)[at]
        wanted.update(zip(key.tolist(), context.tolist()))
    found = {}
    for blocks in groups.values():
        out = lm._merged(length, frequent)(pa.table({"part": [0] * len(blocks), "block": blocks}))
        context, symbol = (out.column(i).to_numpy().view(np.uint64) for i in (0, 1))
        n, inside = (out.column(i).to_pylist() for i in (2, 3))
        for k, c, own, sums in zip(lm._continued(length, context, symbol).tolist(), context.tolist(), n, inside):
            assert (k, c) not in found
            found[k, c] = own, sums
    kept = {k: n for k, n in wanted.items() if n >= lm.MIN_COUNT}
    inside = Counter()
    for (_, c), n in kept.items():
        inside[c] += n
    assert found == {(k, c): (n, inside[c]) for (k, c), n in kept.items()}


def test_arrays_come_back():
    for arrays in ([np.zeros(0, np.uint64)], [np.arange(5, dtype=np.uint64), np.array([2**64 - 1], np.uint64), np.zeros(0, np.uint64)]):
        out = lm._unpacked(lm._packed(arrays))
        assert len(out) == len(arrays) and all((x == y).all() and len(x) == len(y) for x, y in zip(out, arrays))


def test_a_run_takes_a_few_bytes():
    rng = np.random.default_rng(1)
    contexts = np.repeat(np.sort(rng.integers(0, 2**63, 3000, dtype=np.uint64)), 5)
    heads = np.arange(0, 15000, 5)
    block = lm._packed([np.diff(contexts[heads], prepend=np.uint64(0)), np.full(3000, 5), rng.integers(1, 20_000, 15000), np.zeros(0), np.ones(15000)])
    assert len(block) < 8 * 15000


def test_texts_are_scored_by_rounds(spark, monkeypatch):
    """Also rows without id or text and repeated ones: each is scored once, as in one round; what a round doesn't read is gone."""
    rows = [(i, t) for i, t in enumerate(texts(3))] + [(None, "w1 w2 w3 w4"), (5, None), (7, ""), (9, "w1 w2"), (9, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sort = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())
    whole = sort(lm.scored(spark, docs, min_share=0.02))
    rounds, write = [], lm._by_rounds

    def counted(session, frames, name):
        frames = list(frames)
        rounds.extend(df.count() for df in frames if name == "scores")
        return write(session, iter(frames), name)

    monkeypatch.setattr(lm, "_by_rounds", counted)
    monkeypatch.setattr(lm, "TEXT_TOKENS", 700)
    before = len(lm.made())
    assert sort(lm.scored(spark, docs, min_share=0.02)) == whole
    assert len(rounds) > 2 and sum(rounds) == len(rows) and max(rounds) < len(rows)
    assert len(lm.made()[before:]) == 2
