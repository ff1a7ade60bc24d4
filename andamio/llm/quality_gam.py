"""Operator 9: quality scores by an additive model with pairwise interactions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT, ACCEPT = 5, 0, 0.3
#: At most so many labelled documents are learnt from, those with the smallest hashes of their ids.
LEARNT = 20_000
BINS, COARSE, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, RIDGE = 150, 60, 0.15, 4, 2.0
#: Bytes in which the share of signs and capitals is taken, for junk inside clean texts.
WINDOW = 256

FEATURES = (
    "words", "mean_word", "spread_word", "capitals", "stops", "signs", "digits", "shouts", "beyond_ascii", "distinct_words",
    "most_frequent_word", "ends_in_sign", "single_letters", "line_words", "repeated_lines", "blanks", "worst_signs", "worst_capitals", "title_words",
)

_KIND = np.zeros((8, 256), bool)
_KIND[0, 65:91] = True
_KIND[1, [ord(c) for c in ".,;:"]] = True
_KIND[2, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_KIND[3, 48:58] = True
_KIND[4, [ord(c) for c in "!?"]] = True
_KIND[5, 128:] = True
_KIND[6, [9, 10, 11, 12, 13, 32]] = True
_SIGN_TAIL = frozenset("#$%&*+/<=>@[\\]^_`{|}~!?".encode())


def features(text: str | None) -> list[float]:
    """The features of a whole text; an empty or null one has zeros."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(raw, np.uint8)
    seen = np.bincount(codes, minlength=256)
    kinds = _KIND[:7] @ seen / len(codes)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    at = np.arange(0, len(codes), WINDOW)
    size = np.diff(np.append(at, len(codes)))
    # A short last window says little.
    size = np.maximum(size, min(len(codes), WINDOW // 2))
    worst = [float((np.add.reduceat(k[codes].astype(np.int32), at) / size).max()) for k in (_KIND[2] | _KIND[4], _KIND[0])]
    n = len(words)
    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), *map(float, kinds[:6]), len(counts) / n,
        max(counts.values()) / n, sum(w[-1] in _SIGN_TAIL for w in words) / n, float((lengths == 1).mean()),
        float(np.log1p(n / len(lines))), 1 - len(set(lines)) / len(lines), float(kinds[6]), *worst, sum(65 <= w[0] <= 90 for w in words) / n,
    ]


@dataclass
class Additive:
    """Bin edges by feature, a table of additions by feature and by pair of features."""

    edges: list[np.ndarray]
    start: float
    single: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.start)
        for i, table in enumerate(self.single):
            out += table[b[:, i]]
        for i, j, table in self.pairs:
            out += table[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The cut of adjacent bins that gains most: (gain, bins on the left)."""
    left_g, left_h = g.cumsum()[:-1], h.cumsum()[:-1]
    if not len(left_g):
        return 0.0, 0
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A tree over ordered bins with at most ``leaves`` leaves, as its value in each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_best_split(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, left, a, b = max(found)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + left), (a + left, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over a table of bins: a cut of one feature, then of the other on each side."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, gg.shape[0]):
            sides, gain = [], 0.0
            for a, b in ((0, cut), (cut, gg.shape[0])):
                sg, sh = gg[a:b].sum(0), hh[a:b].sum(0)
                more, left = _best_split(sg, sh)
                gain += more + float(_gain(sg.sum(), sh.sum()))
                sides.append((a, b, left, sg, sh))
            if gain > best:
                best, table = gain, np.zeros_like(gg)
                for a, b, left, sg, sh in sides:
                    table[a:b, :left] = sg[:left].sum() / (sh[:left].sum() + RIDGE)
                    table[a:b, left:] = sg[left:].sum() / (sh[left:].sum() + RIDGE)
                out = table.T if flip else table
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boosts one feature after the other in cycles, then the pairs that gain most.

    With no rows, or one label alone, the score is the smoothed share of the label.
    """
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(x.shape[1])]
    model = Additive(edges, start, [np.zeros(len(e) + 1) for e in edges])
    if not len(y) or y.min() == y.max():
        return model
    bins, f = model.bins(x), np.full(len(y), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, table in enumerate(model.single):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(bins[:, i], g, len(table)), np.bincount(bins[:, i], h, len(table)))
            table += step
            f += step[bins[:, i]]

    # Pairs are ranked on a coarse grid by what a table for them would gain.
    g, h = slopes()
    coarse = bins * COARSE // (np.array([len(t) for t in model.single]) + 0)
    gains = []
    for i in range(x.shape[1]):
        for j in range(i):
            cell = coarse[:, i] * COARSE + coarse[:, j]
            gains.append((float(_gain(np.bincount(cell, g, COARSE**2), np.bincount(cell, h, COARSE**2)).sum()), j, i))
    model.pairs = [(i, j, np.zeros((len(model.single[i]), len(model.single[j])))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slopes()
            cell = bins[:, i] * table.shape[1] + bins[:, j]
            both = [np.bincount(cell, v, table.size).reshape(table.shape) for v in (g, h)]
            step = RATE * pair_tree(*both)
            table += step
            f += step[bins[:, i], bins[:, j]]
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, learnt: int = LEARNT) -> Additive:
    """The model, from at most ``learnt`` labelled documents outside the held-out fold.

    The sample is bounded, so it is joined by broadcast and only its features come to
    the driver. Labels that are null are left out, and so are null ids; a document
    labelled 0 and 1 counts once with each.
    """
    common.small_batches(docs.sparkSession)
    usable = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(fold(F.col("doc_id")) != HELD_OUT).select("doc_id", "quality").distinct()
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(learnt)

    @F.pandas_udf("array<double>")
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(features)

    found = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", measured("text").alias("x"))
    rows = sorted((r.doc_id, r.quality, tuple(r.x)) for r in found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("x")).limit(learnt).collect())
    x = np.array([r[2] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in rows], float))


def quality_score(model: Additive, text: Column) -> Column:
    """The score of a text (0 to 1) by additions of table entries, a batch at a time."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            x = np.array([features(t) for t in part], float).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x), dtype="float64")

    return scored(text)


def judge(docs: DataFrame, labels: DataFrame, learnt: int = LEARNT) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    score depends on the text alone, null counting as empty. A null id has the empty
    string for its text. Repeated rows have equal scores; no rows in, no rows out;
    other columns are ignored. With no usable labels every score is 0.5.
    """
    model = train(docs, labels, learnt)
    rows = docs.select("doc_id", quality_score(model, F.col("text")).alias("score"))
    return rows.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, learnt: int = LEARNT) -> DataFrame:
    """The documents that the model accepts, with the columns of ``docs`` under any names.

    Null texts score as empty ones, repeated rows are each kept or each dropped, null ids
    are judged by their text; no rows in, no rows out. Without usable labels all stay.
    """
    model = train(docs, labels, learnt)
    rows = docs.select(common.whole_row(docs).alias("row"), quality_score(model, F.col("text")).alias("score"))
    return rows.filter(F.col("score") >= ACCEPT).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
