"""Open buckets are compared for themselves."""

import numpy as np

from lodestrata.llm import partenum_join as pj
from lodestrata.llm.hashing import hashed_words, shingles


def test_only_sets_of_a_bucket_are_compared(spark, monkeypatch):
    """Buckets chain into one another; sets are compared where they share a signature with one set, and no link is lost."""
    rng = np.random.default_rng(3)
    bags = [rng.choice(40, size=int(rng.integers(9, 22)), replace=False) for _ in range(250)]
    bags += [np.append(bags[i][1:], 40 + i) for i in range(0, 250, 5)]
    docs = spark.createDataFrame([(i, " ".join(f"w{w}" for w in bag)) for i, bag in enumerate(bags)], "doc_id long, text string")
    percent, lows, signed, sets = 80, pj.bands(), {}, []
    for bag in bags:
        items = shingles(hashed_words([" ".join(f"w{w}" for w in bag).encode()])[0], 1)
        signed[pj._digest(items)] = set(pj.signatures(items, lows, percent).tolist())
        sets.append(set(bag.tolist()))
    compared, blocks = [], pj._blocks

    def counted(session, members, *rest):
        compared.append([(r.cluster, r.h) for r in members.collect()])
        return blocks(session, members, *rest)

    monkeypatch.setattr(pj, "_blocks", counted)
    found = {r.doc_id: r.component_id for r in pj.jaccard_components(spark, docs, width=1, percent=percent).collect()}
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert found == dict(enumerate(root))
    clusters = {}
    for cluster, h in compared[0]:
        clusters.setdefault(cluster, []).append(h)
    assert max(map(len, clusters.values())) > 2
    assert all(signed[min(hs)] & signed[h] for hs in clusters.values() for h in hs)


def test_left_clusters_of_equal_members_are_one(spark):
    rows = [(c, h, h, 9) for c, hs in ((1, (5, 6)), (2, (6, 5)), (3, (5, 6, 7)), (4, (7,))) for h in hs]
    found = {}
    for r in pj._merged_clusters(spark.createDataFrame(rows, "cluster long, h long, root long, n long")).collect():
        found.setdefault(r.cluster, []).append(r.h)
    assert sorted(map(sorted, found.values())) == [[5, 6], [5, 6, 7], [7]]
