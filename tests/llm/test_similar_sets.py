"""Near-dedup by similarity: which sets of shingles are made for the exact check."""

import random

import numpy as np
from test_llm_small import documents

from fleetlens.llm import op1_simhash


def test_wide_maps_bound_the_overlap():
    """A pair of the wanted similarity always passes, also when one map is folded; long sets apart don't."""
    pick = np.random.default_rng(17)
    for n in (1, 3, 33, 500, 1000, 5000):
        for _ in range(20):
            pool = np.unique(pick.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
            one, other = pool[:n], pool[pick.integers(0, n // 4 + 1):][:n + int(pick.integers(0, n // 4 + 1))]
            common = len(np.intersect1d(one, other))
            if common >= 0.8 * (len(one) + len(other) - common):
                assert op1_simhash._may_reach(op1_simhash._wide(one), n, op1_simhash._wide(other), len(other), 0.8)
    a, b = pool[:5000], pool[4000:9000]
    assert not op1_simhash._may_reach(op1_simhash._wide(a), 5000, op1_simhash._wide(b), 5000, 0.8)


def test_only_likely_pairs_have_their_sets_made(spark, monkeypatch):
    """Long texts with one passage in common (too few to come last in the order) are candidates of each other; only the two near copies need their sets."""
    pick = random.Random(18)
    words = lambda n: [f"w{pick.randrange(10 ** 9)}" for _ in range(n)]
    passage = words(1500)
    texts = [passage + words(1500) for _ in range(6)]
    texts.append(texts[4][:-20] + words(20))
    made, plain = [], op1_simhash._shingle_sets

    def counted(docs, named, *rest):
        made.append(named.count())
        return plain(docs, named, *rest)
    monkeypatch.setattr(op1_simhash, "_shingle_sets", counted)
    rows = documents(spark, [(i, " ".join(t), "x", "s") for i, t in enumerate(texts)])
    found = {r.doc_id: r.component_id for r in op1_simhash.classes(rows, shingle=5, similarity=0.8).collect()}
    assert found == {i: i for i in range(6)} | {6: 4}
    assert max(made) == 2
