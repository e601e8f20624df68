import random
import re

import numpy as np
import pytest

from hopweave.llm import graphs, jaccard

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_lower = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, k):
    w = _words((text or "").translate(_lower))
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_force(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted((d if d is not None else -1, len(sets[i]), best.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def components_of(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n"], r["keeper_id"] if r["keeper_id"] is not None else -1) for r in df.collect())


@pytest.mark.parametrize(("k", "num", "region"), [(3, 90, 256), (5, 80, 4)])
def test_equal_to_brute_force(documents, sample, k, num, region):
    got = components_of(jaccard.clusters(documents, k, num, 100, region_texts=region))
    assert got == brute_force(sample, k, num, 100)


def test_one_group_of_near_copies_in_many_small_regions(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert components_of(jaccard.clusters(df, 3, 90, 100, region_texts=6)) == brute_force(rows, 3, 90, 100)


def test_near_copies_meet_few_pivots(spark, monkeypatch):
    """The many regions of one group of near copies become few, so distances do not grow with the regions."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(200):
        w = list(base)
        for _ in range(rng.randrange(2, 7)):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    distances = []
    staged = jaccard.staged

    def watched(df, label):
        out = staged(df, label)
        if label == "distances" and out.columns == ["a", "b"]:
            distances.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "staged", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert components_of(jaccard.clusters(df, 5, 80, 100, region_texts=32)) == brute_force(rows, 5, 80, 100)
    assert distances and distances[0] <= 5 * jaccard.PIVOTS * len(rows)


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    for num in (80, 90):
        parts = jaccard.Parts(num, 100)
        for _ in range(600):
            n = int(rng.integers(1, 400))
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            cut = x[int(rng.integers(0, max(1, len(x) // 5) + 1)) :]
            y = np.unique(np.concatenate([cut, rng.integers(0, 2**63, int(rng.integers(0, 8))).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= num * (len(x) + len(y) - both) and len(x) + len(y) > 2 * both:
                assert set(parts(x)) & set(parts(y))


def test_one_of_each_group_stays(documents, sample):
    kept = jaccard.without_near_duplicates(documents, 5, 80, 100)
    assert kept.columns == documents.columns
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect())
    groups = {}
    for d, n, c in brute_force(sample, 5, 80, 100):
        groups.setdefault((c if n else ("empty", d)), d if c == -1 else c)
    assert ids == sorted(groups.values())


def test_empty_table(empty):
    assert jaccard.clusters(empty, 3, 90, 100).count() == 0
    assert jaccard.without_near_duplicates(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(101, 100), (103, 103), (102, 101), (100, 102), (102, 101)]
    got = {r["node"]: r["label"] for r in graphs.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
