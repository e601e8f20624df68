"""URL filter, quality ranking and toxicity: contracts, held-out accuracy and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopweave.llm import common, quality, toxicity, urls


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    plain = [f"{a}{b}" for a in ("mo", "ta", "ri", "ses", "lun") for b in ("ra", "ti", "no", "vel", "k")]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(rng.randrange(60, 200))]
        toxic, bad = i % 6 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = "vile" + rng.choice(["", "st", "ness", "ly", "r"])
        text = " ".join(w) + "."
        if bad:
            text = " ".join([w[0]] * 120) if i % 2 else " ".join(x + "###" for x in w)
        docs.append((i, text))
        labels.append((i, int(not bad), int(toxic and not bad)))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (None, "x")]
    labels += [(900, 1, 0), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string").coalesce(2).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).cache()


def accuracy(scored, labels, column, cut):
    rows = scored.join(labels.filter(F.col(column).isNotNull()), "doc_id").filter(common.held_out()).collect()
    return np.mean([(r["score"] >= cut) == (r[column] == 1) for r in rows])


def test_toxicity(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model, ["doc_id"])
    assert accuracy(scored, labels, "toxic", 0.5) > 0.97
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    kept = toxicity.without_toxic(docs.withColumn("score", F.lit("other")), labels)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {900, 901} <= {r["doc_id"] for r in kept.collect()}


def test_interaction_is_learnt():
    """Two terms that mean nothing alone and are toxic together."""
    rng = np.random.default_rng(4)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([5] * a + [6] * b + list(rng.integers(100, 200, 5)), dtype=np.int32))
        y.append(float(a and b))
    model = toxicity.fit(rows, np.array(y))
    score = lambda *t: model.score(np.array(t, dtype=np.int32))
    assert score(5, 6) > 0.5 > max(score(5), score(6), score())
    assert float(model.factors[5] @ model.factors[6]) > 0


def test_pair_of_neutral_terms_is_learnt():
    """Each of the two terms alone, and beside the other's absence, is as toxic as any text or less; together they are."""
    rng = np.random.default_rng(6)
    rows, y = [], []
    for _ in range(6000):
        a, b = rng.random() < 0.3, rng.random() < 0.3
        share = 0.5 if a and b else 0.0714 if a or b else 0.255
        rows.append(np.array([5] * a + [6] * b + list(set(rng.integers(100, 200, 5))), dtype=np.int32))
        y.append(float(rng.random() < share))
    y = np.array(y)
    size = 1 << toxicity.TABLE_BITS
    rows_of = np.bincount(np.concatenate(rows), minlength=size)
    toxic_of = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t]), minlength=size)
    z = np.abs(toxic_of - rows_of * y.mean()) / np.sqrt(np.maximum(rows_of, 1) * y.mean() * (1 - y.mean()))
    assert max(z[5], z[6]) < toxicity.LEAST_Z
    assert set(np.flatnonzero(toxicity.joint_terms(rows, y, rows_of, toxic_of, np.zeros(size, bool)))) == {5, 6}
    model = toxicity.fit(rows, y)
    score = lambda *t: model.score(np.array(t, dtype=np.int32))
    assert score(5, 6) > 0.6 > 0.35 > max(score(5), score(6))


def test_machine_equals_the_double_sum(labelled):
    """Scores of the table, recomputed in plain Python from words, hashes and the sum over all pairs."""
    import math
    import re
    from zlib import crc32

    docs, labels = labelled
    model = toxicity.train(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs.filter("doc_id % 9 = 0 or doc_id >= 900"), model, ["doc_id"]).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, s in scored.items():
        names = set()
        for w in re.findall(r"[^\W\d_]+", (texts[i] or "").lower()):
            names |= {w} | {w[:k] + "*" for k in toxicity.STEM_LETTERS if len(w) > k}
        t = sorted({crc32(n.encode()) % 2**toxicity.TABLE_BITS for n in names})
        raw = model.bias + sum(float(model.weights[a]) for a in t)
        raw += sum(float(model.factors[a] @ model.factors[b]) for k, a in enumerate(t) for b in t[:k] if model.factors[a].any() and model.factors[b].any())
        assert abs(s - 1 / (1 + math.exp(-max(-30.0, min(30.0, raw))))) < 1e-4


def test_toxicity_without_labels(labelled, spark):
    docs, labels = labelled
    none = toxicity.train(docs, labels.limit(0))
    assert all(r["score"] < 1e-6 for r in toxicity.score(docs.limit(5), none, ["doc_id"]).collect())
    assert toxicity.score(docs.limit(0), none, ["doc_id"]).count() == 0


def test_quality(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    scored = quality.score(docs, model, ["doc_id"])
    assert accuracy(scored, labels, "quality", quality.THRESHOLD) > 0.97
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    assert quality.above_quantile(scored, 0.5).count() >= scored.count() // 2
    assert quality.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_quality_scores_recomputed(labelled):
    """Scores of the table from the features, one by one; the fit's slope is that of the pairwise loss."""
    import math

    docs, labels = labelled
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.score(docs, model, ["doc_id"]).collect():
        raw = 0.0
        for x, m, s, w in zip(quality.features(texts[r["doc_id"]]), model.mean, model.spread, model.weights, strict=True):
            raw += max(-6.0, min(6.0, (x - m) / s)) * w
        at = raw - model.cut + math.log(quality.THRESHOLD / (1 - quality.THRESHOLD)) + 1e-9
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30.0, min(30.0, at))))) < 1e-9
    x = np.random.default_rng(2).normal(size=(60, len(quality.FEATURES)))
    y = (x[:, 0] - x[:, 3] + np.random.default_rng(3).normal(size=60) > 0).astype(int)
    fitted = quality.fit(x, y, pairs_per_row=3)
    z = np.clip((x - fitted.mean) / fitted.spread, -6, 6)
    rng = np.random.default_rng(11)
    rarer, other = sorted((np.flatnonzero(y == 1), np.flatnonzero(y == 0)), key=len)
    one, two = np.repeat(rarer, 3), rng.choice(other, len(rarer) * 3)
    pairs = list(zip(one, two)) if y[rarer[0]] else list(zip(two, one))
    loss = lambda w: sum(math.log1p(math.exp(-float((z[a] - z[b]) @ w))) for a, b in pairs) / len(pairs) + 0.005 * float(w @ w)
    least = loss(fitted.weights)
    for k in range(len(fitted.weights)):
        for step in (-0.05, 0.05):
            assert loss(fitted.weights + step * (np.arange(len(fitted.weights)) == k)) > least


def test_quality_learns_from_every_label(spark, monkeypatch):
    """More labelled rows than any sample held, in many blocks: weights, mean and cut are those of all rows."""
    n = 13_000
    monkeypatch.setattr(quality, "GATHERED", 50)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, len(quality.FEATURES)))
    y = (x[:, 0] - x[:, 3] + rng.normal(size=n) > -1).astype(int)
    rows = spark.createDataFrame([(i, int(b), a) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist()))], "doc_id long, y int, features array<double>").repartition(5).cache()
    model = quality.fit_all(rows)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.spread, x.std(0))
    bad = int((y == 0).sum())
    assert model.cut == pytest.approx(np.sort(model.raw(x))[[bad - 1, bad]].mean(), abs=1e-9)
    one = quality.pair_sums(x[:200], y[:200], model.weights)
    pairs = [x[i] - x[j] for i in range(200) for j in range(200) if y[i] == 1 and y[j] == 0]
    lost = [1 / (1 + np.exp(d @ model.weights)) for d in pairs]
    assert one[0] == len(pairs) and np.allclose(one[1:12], np.transpose(pairs) @ lost)
    assert np.allclose(one[12:].reshape(11, 11), sum(p * (1 - p) * np.outer(d, d) for p, d in zip(lost, pairs)))
    # every row moves the model: without one row of 13,000 it is another
    assert not np.array_equal(quality.fit_all(rows.filter("doc_id <> 12999")).weights, model.weights)


def test_quality_without_labels(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels.limit(0))
    assert all(r["score"] >= quality.THRESHOLD for r in quality.score(docs, model, ["doc_id"]).collect())


def expected_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    best = None
    for rule, _ in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_urls(spark):
    rng = random.Random(3)
    listed = [f"https://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['a', 'bb'])}.example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(999)}{rng.choice(['', '?q=1&r=2', '#top', '/'])}" for _ in range(400)]
    odd = [None, "", "no scheme", "http://", "HTTP://NET/", "x://NeT/a", "x://net", "x://net?a/", "a://b://net/", "ftp://é.NET/ü?x", "s://example.net/en/", "s://badexample.net/en/", "s://org/fr/x", "x://" + "a" * 20000 + ".net/" + "b" * 20000]
    every = listed + odd + odd
    pages = spark.createDataFrame([(i, u, "host of row", 3) for i, u in enumerate(every)], "page_id long, url string, tld string, f_length int").coalesce(2)
    for limit in (urls.EXPRESSION_RULES, 0):
        matched = urls.with_rule(urls.with_host_path(pages), urls.RULES, limit).collect()
        assert len(matched) == len(every)
        for r in matched:
            assert (r["host"], r["path"], r["rule"]) == expected_rule(every[r["page_id"]], urls.RULES)
    out = urls.judged(pages)
    assert out.columns == ["page_id", "url", "tld", "f_length", "host", "path", "rule", "score", "verdict"]
    rows = out.collect()
    verdicts = dict(urls.RULES)
    assert len(rows) == len(every) and all(r["verdict"] == verdicts[r["rule"]] for r in rows if r["rule"])
    agree = np.mean([(r["score"] >= 0.5) == (verdicts[r["rule"]] == "block") for r in rows if r["rule"] and r["page_id"] < 400])
    assert agree > 0.9
    assert urls.judged(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judged(pages, rules=(("nowhere/", "block"),)).collect()} == {"allow"}


def test_url_features_and_trees_by_hand(spark):
    """Features and leaf sums recomputed in plain Python."""
    import math
    import re
    from collections import Counter

    every = ["https://a-b.example.net/x/y1.html?q=1&r=2#top", "http://www.example.org/fr/", "s://h/" + "z9" * 4000, "", None, "no scheme", "x://ü.net/%20_-"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(every)], "i long, url string")
    for r in urls.with_features(urls.with_host_path(df), "url").collect():
        u, host, path = every[r["i"]] or "", r["host"], r["path"]
        n = len(u)
        bits = -sum(c / n * math.log2(c / n) for c in Counter(u).values()) if n else 0.0
        query = u.split("?", 1)[1].split("#")[0] if "?" in u else ""
        assert (r["f_length"], r["f_host_length"], r["f_labels"], r["f_depth"]) == (n, len(host), host.count("."), path.count("/"))
        assert r["f_digits"] == (1000 * len(re.findall("[0-9]", u)) // n if n else 0) and r["f_letters"] == (1000 * len(re.findall("[A-Za-z]", u)) // n if n else 0)
        assert abs(r["f_entropy"] - 100 * bits) <= 1 and (r["f_params"], r["f_fragment"]) == (query.count("=") + query.count("&"), int("#" in u))
        assert r["f_hyphens"] == u.count("-") + u.count("_") and r["tld"] == host.rpartition(".")[2]
    rng = random.Random(7)
    rows = [tuple(rng.randrange(6) for _ in urls.FEATURES) for _ in range(300)]
    rows = [(*x, int((x[0] > 2) != (x[3] > 3))) for x in rows]
    model = urls.fit(spark.createDataFrame(rows, ", ".join(f"{f} int" for f in urls.FEATURES) + ", y int"), trees=3, depth=2)
    margins = [model.bias] * len(rows)

    def leaf(node, x):
        while node.low is not None:
            node = node.low if x[urls.FEATURES.index(node.feature)] <= node.at else node.high
        return node

    for tree in model.trees:
        sums = {}
        for m, x in zip(margins, rows, strict=True):
            p = 1 / (1 + math.exp(-m))
            s = sums.setdefault(id(leaf(tree, x)), [0.0, 0.0])
            s[0], s[1] = s[0] + p - x[-1], s[1] + p * (1 - p)
        for x in rows:
            g, h = sums[id(leaf(tree, x))]
            assert abs(leaf(tree, x).value + urls.RATE * g / (h + urls.RIDGE)) < 1e-9
        margins = [m + leaf(tree, x).value for m, x in zip(margins, rows, strict=True)]
    assert np.mean([(m > 0) == (x[-1] == 1) for m, x in zip(margins, rows, strict=True)]) > 0.9
