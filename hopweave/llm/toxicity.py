"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and the stems (first letters) of longer words, hashed into a
fixed table. The score is ``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)`` over the terms that occur, so that a pair of
terms, such as an insult beside the mention of a group, weighs more than its parts.

A text of thousands of words holds millions of pairs, and those of chance terms would drown the rest (README has
figures), so the machine works on terms that tell something in the sample: those that lean to a label by themselves
(``LEAST_ROWS``, ``LEAST_Z``), and those that do so in a pair, however neutral alone. For the latter, the joint counts
of the ``PAIR_TERMS`` commonest terms, and of the ``PAIR_LEANING`` commonest that lean, are held against what two
separate weights would predict (``PAIR_ROWS``, ``PAIR_Z``); their table takes 18 MB of the driver.

It is fitted by mini-batch AdaGrad on the driver, on at most ``SAMPLE_ROWS`` labelled rows that are not held
out (the documented bound; about 2 KB of term numbers each). Scoring covers every row and every whole text.

A null or empty text has no terms and gets the score of the intercept alone. Repeated rows get equal scores. If
no labels are known, or only one kind, every score is the share of toxic labels (0.0 without labels). A score that
equals the threshold counts as toxic. Other columns, whatever their names, are passed through; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_text, held_out, label_sample, map_text, staged, table

SAMPLE_ROWS = 12_000
TABLE_BITS = 18
FACTORS = 4
STEM_LETTERS = (3, 4, 5)
THRESHOLD = 0.5
#: A term is used if it is in so many sampled rows, and its toxic rows exceed the expected ones by so many deviations.
LEAST_ROWS = 3
LEAST_Z = 4.0
#: Pairs of which so many of the commonest terms, and of the commonest leaning ones, are looked at, the rows that must hold both, and by how many deviations
#: their toxic rows must exceed what the terms' own shares predict (so many pairs are looked at that five happen).
PAIR_TERMS, PAIR_LEANING = 1_000, 500
PAIR_ROWS = 20
PAIR_Z = 7.0
#: Words whose terms a task keeps; the store is emptied when full.
KEPT_WORDS = 300_000

_word = re.compile(r"[^\W\d_]+").findall


class Terms:
    """Numbers of a text's hashed terms."""

    def __init__(self) -> None:
        self.kept: dict[str, tuple[int, ...]] = {}

    def _of_word(self, word: str) -> tuple[int, ...]:
        names = [word] + [f"{word[:k]}*" for k in STEM_LETTERS if len(word) > k]
        return tuple(crc32(n.encode("utf-8")) & ((1 << TABLE_BITS) - 1) for n in names)

    def __call__(self, text: str | None) -> np.ndarray:
        kept, out = self.kept, set()
        for word in set(_word((text or "").lower())):
            terms = kept.get(word)
            if terms is None:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                terms = kept[word] = self._of_word(word)
            out.update(terms)
        return np.fromiter(out, dtype=np.int32, count=len(out))


@dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, terms: np.ndarray) -> float:
        v = self.factors[terms]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[terms].sum() + 0.5 * (s @ s - np.einsum("ij,ij->", v, v)))

    def score(self, terms: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.raw(terms), -30.0, 30.0))))


def joint_terms(rows: list[np.ndarray], y: np.ndarray, rows_of: np.ndarray, toxic_of: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Whether a term stands in a pair that is toxic far more often than its two terms' shares predict."""
    out = np.zeros(len(rows_of), bool)
    order = np.argsort(-rows_of, kind="stable")
    names = np.unique(np.concatenate([order[:PAIR_TERMS], order[used[order]][:PAIR_LEANING]]))
    names = names[rows_of[names] >= PAIR_ROWS]
    if len(names) < 2:
        return out
    place = np.full(len(rows_of), -1, np.int32)
    place[names] = np.arange(len(names))
    both = np.zeros((2, len(names), len(names)), np.float32)  # rows that hold both terms: not toxic, toxic
    for kind in (0, 1):
        of = np.flatnonzero((y > 0) == bool(kind))
        for at in range(0, len(of), 512):
            block = np.zeros((min(512, len(of) - at), len(names)), np.float32)
            for i, k in enumerate(of[at : at + 512]):
                hit = place[rows[k]]
                block[i, hit[hit >= 0]] = 1.0
            both[kind] += block.T @ block
    logit = lambda p: np.log(p) - np.log1p(-p)
    share = float(y.mean())
    own, alone = logit((toxic_of[names] + share) / (rows_of[names] + 1.0)), toxic_of[names] / rows_of[names]
    for at in range(0, len(names), 64):
        k = slice(at, at + 64)
        n, toxic = both[0, k] + both[1, k], both[1, k]
        expected = 1.0 / (1.0 + np.exp(-(own[k, None] + own[None, :] - logit(share))))
        # a pair is never expected to be rarer toxic than either of its terms
        expected = np.maximum(expected, np.maximum(alone[k, None], alone[None, :]))
        z = (toxic - n * expected) / np.sqrt(np.maximum(n * expected * (1.0 - expected), 1e-9))
        z[np.arange(len(z)), np.arange(at, at + len(z))] = 0.0
        hit = (n >= PAIR_ROWS) & (z >= PAIR_Z)
        out[names[k][hit.any(1)]] = True
        out[names[hit.any(0)]] = True
    return out


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """Logistic loss, AdaGrad, L2 decay; the two labels weigh alike up to a factor of three."""
    size = 1 << TABLE_BITS
    rng = np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.0
    if not 0.0 < share < 1.0:
        logit = 30.0 if share == 1.0 else -30.0
        return FactorizationMachine(logit, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))
    w = np.zeros(size, np.float32)
    v = rng.normal(0.0, 0.01, (size, FACTORS)).astype(np.float32)
    b = float(np.log(share / (1.0 - share)))
    gw, gv, gb = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-1, np.float32), 1.0
    heavy = min(3.0, (1.0 - share) / share)
    rows_of = np.bincount(np.concatenate(rows), minlength=size)
    toxic_of = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t > 0]), minlength=size)
    z = np.abs(toxic_of - rows_of * share) / np.sqrt(np.maximum(rows_of, 1) * share * (1.0 - share))
    used = (rows_of >= LEAST_ROWS) & (z >= LEAST_Z)
    used |= joint_terms(rows, y, rows_of, toxic_of, used)
    rows = [r[used[r]] for r in rows]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            entry = np.concatenate([rows[k] for k in pick])
            lengths = np.array([len(rows[k]) for k in pick])
            of = np.repeat(np.arange(len(pick)), lengths)
            ve = v[entry]
            s = np.stack([np.bincount(of, ve[:, f], len(pick)) for f in range(FACTORS)], axis=1).astype(np.float32)
            raw = b + np.bincount(of, w[entry], len(pick)) + 0.5 * ((s * s).sum(1) - np.bincount(of, (ve * ve).sum(1), len(pick)))
            target = y[pick]
            g = ((1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - target) * np.where(target > 0, heavy, 1.0) / len(pick)).astype(np.float32)
            ge = g[of]
            db = float(g.sum())
            gb += db * db
            b -= rate * db / np.sqrt(gb)
            if not len(entry):
                continue
            by = np.argsort(entry, kind="stable")
            ids, first = np.unique(entry[by], return_index=True)
            dw = np.add.reduceat(ge[by], first) + decay * w[ids]
            dv = np.add.reduceat((ge[:, None] * (s[of] - ve))[by], first, axis=0) + decay * v[ids]
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            w[ids] -= rate * dw / np.sqrt(gw[ids])
            v[ids] -= rate * dv / np.sqrt(gv[ids])
    v[~used] = 0.0
    return FactorizationMachine(b, w, v)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fit on the labelled sample: its documents' terms are made on the executors; only their numbers move."""
    sample = staged(label_sample(labels, "toxic", sample_rows), "toxic-labels")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most SAMPLE_ROWS ids

    def make():
        terms = Terms()
        return lambda t: (terms(t).tobytes(),)

    found = map_text(texts, ["doc_id", "y"], "text", [pa.field("terms", pa.binary())], make)
    # a label belongs to one document; of rows that repeat its id, one counts
    one = found.groupBy("doc_id", "y").agg(F.max("terms").alias("terms")).orderBy("doc_id").collect()
    return fit([np.frombuffer(r["terms"], dtype=np.int32) for r in one], np.array([float(r["y"]) for r in one]))


def score(docs: DataFrame, model: FactorizationMachine, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score``; the model's table has a fixed size (5 MB)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fm, terms = shipped.value, Terms()
        return lambda t: (fm.score(terms(t)),)

    return map_text(docs, keep, text, [pa.field("score", pa.float64())], make)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns unchanged."""
    model = train(docs, labels, sample_rows)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fm, terms = shipped.value, Terms()
        return lambda t: fm.score(terms(t)) < threshold

    return filter_text(docs, make)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
