"""The length of matched prefixes does not depend on which sets a table has."""

import numpy as np

from docskein.llm import jaccard


def weak_pair():
    """Two texts of similarity 0.8 that share 6 levels of a path and in no tree 7."""
    rng = np.random.default_rng(5)
    for _ in range(20_000):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 49)]
        a, b = " ".join(words[:40]), " ".join(words)
        x, y = (jaccard.signature(s, 8) for s in jaccard.shingle_sets([a, b]))
        if np.cumprod(x == y, axis=0).sum(axis=0).max() == 6:
            return a, b


def test_a_pair_at_the_threshold_among_near_copies(spark, docs):
    rng = np.random.default_rng(6)
    rows = [(i, t) for i, t in enumerate(weak_pair())]
    for i in range(600):
        words = " ".join(f"v{x}" for x in rng.integers(0, 1 << 40, 104))
        rows += [(10 + 2 * i, words), (11 + 2 * i, words + " more")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_documents(docs(*rows[2:], *rows[:2])).collect()}
    assert got[0] == got[1] == (0, 1)
    assert all(got[i] == (i - i % 2, 1) for i in range(10, 1210))
