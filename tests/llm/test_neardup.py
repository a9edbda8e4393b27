import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import neardup as N


def runs(text, k=3):
    w = (text or "").lower().split()
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= 30 else None


def brute(docs, t=0.6):
    sets = sorted({(i, runs(x)) for i, x in docs if i is not None and runs(x)}, key=lambda p: p[0])
    return {(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if a != b and len(x & y) >= t * len(x | y) - 1e-9}


def corpus(rng, n):
    vocabulary = [f"w{k}" for k in range(300)]
    boiler = " ".join(rng.choice(vocabulary) for _ in range(25))
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            words = rng.choice(docs)[1].split()
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randint(0, 2)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 3))]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 90))] + boiler.split() * (rng.random() < 0.5)
        docs.append((i, " ".join(words).upper() if rng.random() < 0.2 else "  ".join(words)))
    return docs


@pytest.mark.parametrize("how", [{}, {"hot": 2, "block": 5}, {"hot_level": 12, "block": 7}])
def test_pairs_equal_brute_force(spark, how):
    docs = corpus(random.Random(len(how) + 1), 150) + [(900, None), (901, ""), (902, "too short"), (None, "x " * 50)]
    docs += docs[:8] + [(500 + k, docs[3][1]) for k in range(4)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for c in ("cls", "a", "b", "kind", "token", "size", "part"):
        df = df.withColumn(c, F.lit("x"))
    want = brute(docs)
    got = N.similar_pairs(df, **how)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert len(want) > 20


def test_groups_are_the_components_and_copies_can_stay_unexpanded(spark):
    docs = corpus(random.Random(9), 80)
    docs += [(500 + k, docs[3][1]) for k in range(6)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    parent = {i: i for i, x in docs if runs(x)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute(docs):
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["doc_id"]: r["group_id"] for r in N.groups(df).collect()}
    assert got == {i: root(i) for i in parent}
    few = {tuple(r) for r in N.similar_pairs(df, expand_up_to=3).collect()}
    assert few < brute(docs)
    for i in list(parent):
        parent[i] = i
    for a, b in few:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert {i: root(i) for i in parent} == got


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert N.similar_pairs(df).count() == 0 and N.groups(df).count() == 0


def test_the_ring_never_drops_a_pair_over_the_threshold():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (20, 200, 4000):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            keep = a[rng.random(len(a)) < rng.uniform(0.6, 1)]
            b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, n // 3))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            similar = common >= 0.6 * (len(a) + len(b) - common)
            passed = N.ring_filter([N.sketch_of(a)], np.array([len(a)]), [N.sketch_of(b)], np.array([len(b)]), 0.6)[0]
            assert passed or not similar


def test_slices_keep_equal_tokens_together():
    tokens = np.array([5, 1, 5, 2, 1, 9, 5, 9, 7], np.uint64)
    slices = list(N.token_slices(tokens, 2))
    assert sorted(np.concatenate(slices).tolist()) == list(range(9)) and len(slices) > 1
    for t in set(tokens.tolist()):
        assert sum(t in tokens[s] for s in slices) == 1
    assert list(N.token_slices(tokens[:0], 2)) == []
