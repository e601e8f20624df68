"""Quality scores by Bradley-Terry pairwise ranking.

Each text becomes a few shape features. In a preference pair a document labelled good wins over one labelled bad; the
probability that it does is the logistic function of the difference of the two scores, and the scores are linear in
the features, so the weights come from a logistic regression on feature differences (Newton steps, ridge). All
labelled rows that are not held out are learnt from: they are dealt out to blocks by hash, and every good row of a
block meets every bad one, so that pairs grow with the rows. The sums of a Newton step are made where the blocks are.
The cut between good and bad is the exact quantile of all learnt rows' scores at the share of bad labels; scores are
shifted so that it falls on ``THRESHOLD``.

A null text counts as empty; an empty text has features and a score like any other. Repeated rows get equal
scores. Without labels of both kinds every weight is zero, and all rows get the score just above the threshold.
Texts of any length are measured whole. Other columns, whatever their names, have no part in a score; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, known_labels, map_text, parts, small, staged, table

#: Rows of a block, about, and its rows of the rarer label at least, on average; parts that blocks are packed in.
BLOCK_ROWS, LEAST_RARER, PACKS = 256, 8, 512
#: Scores that come to the driver for the cut; more are narrowed by so many bins at a time first.
GATHERED, BINS = 20_000, 1024
#: Preference pairs for each row of the rarer label, where :func:`fit` draws them.
PAIRS_PER_ROW = 12
THRESHOLD = 0.3

_symbols = re.compile(r"[^\w\s.,;:'\"()\[\]-]").findall
_capital = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall
_digits = re.compile(r"[0-9]").findall

FEATURES = ("log_words", "word_length", "symbols", "capitals", "digits", "distinct_words", "repeated_neighbours", "repeated_triples", "sentence_ends", "repeated_lines", "one_letter_words")


def features(text: str | None) -> list[float]:
    """Shape of a whole text; every share lies between 0 and 1."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    letters = max(1, sum(map(len, words)))
    triples = list(zip(words, words[1:], words[2:], strict=False))
    return [
        np.log1p(len(words)),
        min(letters / n, 40.0) / 10.0,
        len(_symbols(text)) / letters,
        len(_capital(text)) / letters,
        len(_digits(text)) / letters,
        len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1.0 - len(set(triples)) / max(1, len(triples)),
        min(1.0, 10.0 * sum(text.count(c) for c in ".?!") / n),
        1.0 - len(set(lines)) / max(1, len(lines)),
        sum(len(w) == 1 for w in words) / n,
    ]


@dataclass
class Ranking:
    """Linear scores on standardised features; ``cut`` is the score that falls on the threshold."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6.0, 6.0) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.raw(x) - self.cut + np.log(THRESHOLD / (1.0 - THRESHOLD)) + 1e-9
        return 1.0 / (1.0 + np.exp(-np.clip(at, -30.0, 30.0)))


def fit(x: np.ndarray, y: np.ndarray, pairs_per_row: int = PAIRS_PER_ROW, ridge: float = 1e-2, seed: int = 11) -> Ranking:
    x = np.asarray(x, dtype=float).reshape(-1, len(FEATURES))
    mean = x.mean(0) if len(x) else np.zeros(len(FEATURES))
    spread = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(len(FEATURES))
    model = Ranking(mean, spread, np.zeros(len(FEATURES)), 0.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    z = np.clip((x - mean) / spread, -6.0, 6.0)
    rng = np.random.default_rng(seed)
    rarer, other = sorted((good, bad), key=len)
    one, two = np.repeat(rarer, pairs_per_row), rng.choice(other, len(rarer) * pairs_per_row)
    winner, loser = (one, two) if rarer is good else (two, one)
    diff = z[winner] - z[loser]
    w = model.weights
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(diff @ w, -30.0, 30.0)))
        slope = diff.T @ (1.0 - p) / len(diff) - ridge * w
        bend = (diff * (p * (1.0 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    raw = model.raw(x)
    share = len(bad) / len(y)
    # the quantile at the share of bad labels, in the middle of the gap between its two neighbours
    order = np.sort(raw)
    at = min(len(order) - 1, max(1, round(share * len(order))))
    model.cut = float((order[at - 1] + order[at]) / 2.0)
    return model


def _fields() -> list[pa.Field]:
    return [pa.field("features", pa.list_(pa.float64()))]


def featured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``features`` of every row."""
    return map_text(docs, keep, text, _fields(), lambda: lambda t: (features(t),))


def _packs(rows: DataFrame, blocks: int, moved: dict[int, int]) -> DataFrame:
    """(x, y, block) of ``rows`` (block, y, features) as bytes, a row for each pack of blocks, in an order that depends
    on the rows alone."""
    packs = min(blocks, PACKS)
    width = len(FEATURES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [b for b in batches if b.num_rows]
        if not every:
            return
        found = pa.Table.from_batches(every)
        block, y = found["block"].to_numpy(), found["y"].to_numpy()
        x = found["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        block = np.array([moved.get(b, b) for b in block.tolist()])
        of = block % packs
        order = np.lexsort((*x.T, y, block, of))
        x, y, block, of = x[order], y[order].astype(np.int64), block[order], of[order]
        for one in np.unique(of):
            a, b = np.searchsorted(of, (one, one + 1))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], type=pa.binary()) for v in (x[a:b], y[a:b], block[a:b])], names=["x", "y", "block"])

    to = F.create_map(*[F.lit(v) for kv in moved.items() for v in kv]) if moved else None
    place = F.col("block") if to is None else F.coalesce(F.try_element_at(to, F.col("block")), F.col("block"))
    spread = max(1, min(packs, 2 * rows.sparkSession.sparkContext.defaultParallelism))
    return staged(rows.repartition(spread, place % packs).mapInArrow(pack, "x binary, y binary, block binary"), "quality-packs")


def _over(packs: DataFrame, make: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """``make`` of every pack's x, y and block, on the driver, in an order that depends on the results alone."""
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                x, y, block = (np.frombuffer(batch.column(j)[i].as_py(), t) for j, t in enumerate((float, np.int64, np.int64)))
                made.append(np.asarray(make(x.reshape(-1, width), y, block), dtype=float))
            yield pa.RecordBatch.from_arrays([pa.array(made, type=pa.list_(pa.float64()))], names=["made"])

    return [np.array(v) for v in sorted(r["made"] for r in packs.mapInArrow(run, "made array<double>").collect())]


def pair_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of all pairs of a good and a bad row: their number, and the sums of the slope and of the bend at ``w``."""
    good, bad = z[y == 1], z[y == 0]
    p = 1.0 / (1.0 + np.exp(-np.clip((good @ w)[:, None] - (bad @ w)[None, :], -30.0, 30.0)))
    lost, bend = 1.0 - p, p * (1.0 - p)
    slope = good.T @ lost.sum(1) - bad.T @ lost.sum(0)
    cross = good.T @ bend @ bad
    square = (good * bend.sum(1)[:, None]).T @ good + (bad * bend.sum(0)[:, None]).T @ bad - cross - cross.T
    return np.concatenate([[p.size], slope, square.ravel()])


def _ranked(packs: DataFrame, raw: Callable[[np.ndarray], np.ndarray], rank: int, rows: int) -> float:
    """The raw score of that rank (from 0) among all ``rows``, exactly."""
    low, high, inside, below = -np.inf, np.inf, rows, 0

    def held(v: np.ndarray) -> np.ndarray:
        return v[(v >= low) & (v < high)]

    while inside > GATHERED:
        ends = np.array(_over(packs, lambda x, y, b: (lambda v: [v.min(), v.max()] if len(v) else [np.inf, -np.inf])(held(raw(x)))))
        least, most = ends[:, 0].min(), ends[:, 1].max()
        if least == most:
            return float(least)
        edges = np.unique(np.r_[np.linspace(least, most, BINS), np.nextafter(most, np.inf)])
        counts = np.sum(_over(packs, lambda x, y, b: np.bincount(np.searchsorted(edges, held(raw(x)), "right") - 1, minlength=len(edges) - 1)), axis=0).astype(int)
        upto = below + np.cumsum(counts)
        i = int(np.searchsorted(upto, rank, "right"))
        low, high, inside, below = edges[i], edges[i + 1], int(counts[i]), int(upto[i] - counts[i])
    return float(np.sort(np.concatenate(_over(packs, lambda x, y, b: held(raw(x)))))[rank - below])


def fit_all(rows: DataFrame, ridge: float = 1e-2) -> Ranking:
    """The ranking of ``rows`` (doc_id, y, features; staged, an id once), all of which are learnt from."""
    n = len(FEATURES)
    each = [F.get("features", F.lit(i)) for i in range(n)]
    known = rows.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("y") == 0, 1)).alias("bad"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(each)]).first()
    total, bad = known["rows"], known["bad"]
    if not total:
        return Ranking(np.zeros(n), np.ones(n), np.zeros(n), 0.0)
    mean = np.array([known[f"m{i}"] for i in range(n)])
    wide = rows.agg(*[F.avg((c - F.lit(float(m))) ** 2).alias(f"v{i}") for i, (c, m) in enumerate(zip(each, mean, strict=True))]).first()
    model = Ranking(mean, np.maximum(np.sqrt([wide[f"v{i}"] for i in range(n)]), 1e-3), np.zeros(n), 0.0)
    if not bad or bad == total:
        return model
    blocks = max(1, min(-(-total // BLOCK_ROWS), min(bad, total - bad) // LEAST_RARER))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(blocks)).alias("block"), "y", "features")
    # a block that got rows of one label only joins one that has both, so that no row is left without a partner
    kinds = {r["block"]: (r["low"], r["high"]) for r in dealt.groupBy("block").agg(F.min("y").alias("low"), F.max("y").alias("high")).collect()}  # BLOCK_ROWS rows for one of these
    full = sorted(b for b, (low, high) in kinds.items() if low < high)
    poor = sorted(b for b, (low, high) in kinds.items() if low == high)
    moved = {b: full[i % len(full)] for i, b in enumerate(poor)} if full else {b: 0 for b in kinds}
    packs = _packs(dealt, blocks, moved)
    shaped = lambda x: np.clip((x - model.mean) / model.spread, -6.0, 6.0)

    def summed(x: np.ndarray, y: np.ndarray, block: np.ndarray) -> np.ndarray:
        z, cuts = shaped(x), np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        return np.sum([pair_sums(z[a:b], y[a:b], w) for a, b in zip(cuts, cuts[1:], strict=False)], axis=0)

    w = model.weights
    for _ in range(30):
        sums = np.sum(_over(packs, summed), axis=0)
        slope = sums[1 : n + 1] / sums[0] - ridge * w
        bend = sums[n + 1 :].reshape(n, n) / sums[0] + ridge * np.eye(n)
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    # the quantile at the share of bad labels, in the middle of the gap between its two neighbours
    at = min(total - 1, max(1, bad))
    one = Ranking(model.mean, model.spread, w, 0.0)
    model.cut = (_ranked(packs, one.raw, at - 1, total) + _ranked(packs, one.raw, at, total)) / 2.0
    return model


def train_featured(found: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on every labelled row of ``found`` (doc_id, features; staged) that is not held out."""
    known = staged(known_labels(labels, "quality"), "quality-labels")
    one = found.join(small(known), "doc_id").groupBy("doc_id", "y").agg(F.max("features").alias("features"))
    return fit_all(staged(one, "quality-rows"))


def train(docs: DataFrame, labels: DataFrame) -> Ranking:
    return train_featured(staged(featured(docs, ["doc_id"]), "quality-features"), labels)


def score(docs: DataFrame, model: Ranking, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score`` of every row."""

    def make():
        return lambda texts: [model.score(np.array([features(t) for t in texts]))]  # a batch's scores in one product

    return map_text(docs, keep, text, [pa.field("score", pa.float64())], make, whole=True)


def above_quantile(scored: DataFrame, share: float, accuracy: int = 10_000) -> DataFrame:
    """The rows whose score is at or above the corpus's quantile ``share`` (a mergeable sketch over all rows)."""
    cut = scored.agg(F.percentile_approx("score", share, accuracy).alias("cut"))
    return scored.crossJoin(F.broadcast(cut)).filter(F.col("score") >= F.col("cut")).drop("cut")  # one row


def score_featured(found: DataFrame, model: Ranking) -> DataFrame:
    """``doc_id`` and ``score`` of every row of ``found`` (doc_id, features)."""
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "features").mapInArrow(run, f"doc_id {kind}, score double")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = staged(featured(docs, ["doc_id"]), "quality-features")  # read for the fit and for the scores
    model = train_featured(found, table(spark, sf_dir, "labels"))
    return score_featured(found, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
