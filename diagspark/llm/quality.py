"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a dozen surface features. Cyclic boosting visits the features
in turn and adds, each time, one shallow tree over that feature's bins to its
lookup table; then the strongest pairs of features get tables of their own in
the same way. A score is the sigmoid of the sum of the bins' entries, so
scoring a batch is one ``searchsorted`` and one table look-up a feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fold, whole

FEATURES = (
    "log_words", "word_bytes", "upper_share", "symbol_share", "pipe_share", "digit_share", "distinct_share",
    "repeat_share", "line_repeat_share", "stop_share", "non_ascii_share", "line_words", "top_word_share",
)
_LOWER, _UPPER, _DIGIT = (bytes(range(a, b)) for a, b in ((97, 123), (65, 91), (48, 58)))
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?")


def text_features(text: str | None) -> list[float]:
    """FEATURES of one whole text; all 0 for null, empty or blank texts."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    size, count = len(raw), len(words)
    letters = size - len(raw.translate(None, _LOWER + _UPPER))
    upper = size - len(raw.translate(None, _UPPER))
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return [
        float(np.log1p(count)),
        sum(map(len, words)) / count,
        upper / max(letters, 1),
        (size - len(raw.translate(None, _SYMBOL))) / size,
        raw.count(b"|") / count,
        (size - len(raw.translate(None, _DIGIT))) / size,
        len(seen) / count,
        repeats / count,
        1 - len(set(lines)) / len(lines),
        (raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")) / count,
        (size - len(raw.decode("utf-8").encode("ascii", "ignore"))) / size,
        count / len(lines),
        max(seen.values()) / count,
    ]


def feature_rows(texts) -> np.ndarray:
    rows = [text_features(t) for t in texts]
    return np.array(rows, dtype=float).reshape(len(rows), len(FEATURES))


@dataclass
class AdditiveModel:
    """Bin edges, one table a feature, one table a chosen pair, and a constant."""

    edges: list[np.ndarray]
    constant: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.constant)
        for j, table in enumerate(self.single):
            total += table[b[:, j]]
        for (i, j), table in self.pairs.items():
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(grad, hess, ridge: float):
    return grad / (hess + ridge)


def _split(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best single cut of binned sums: its gain and the first bin to the right."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    left, right = g[:-1] ** 2 / (h[:-1] + ridge), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
    if not len(left):
        return 0.0, 0
    gain = left + right - g[-1] ** 2 / (h[-1] + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of depth two over one feature's bins, as the values of its leaves by bin."""
    out = np.zeros(len(grad))
    _, cut = _split(grad, hess, ridge)
    for lo, hi in ((0, cut), (cut, len(grad))):
        if lo == hi:
            continue
        gain, inner = _split(grad[lo:hi], hess[lo:hi], ridge)
        for a, b in ((lo, lo + inner), (lo + inner, hi)) if gain > 1e-9 else ((lo, hi),):
            out[a:b] = _leaf(grad[a:b].sum(), hess[a:b].sum(), ridge)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a two-way table: gain, and the four leaves' values by cell."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    parts = []
    for m in (g, h):
        a = m[:-1, :-1]
        b, c = m[:-1, -1:] - a, m[-1:, :-1] - a
        parts.append((a, b, c, m[-1, -1] - a - b - c))
    if not parts[0][0].size:
        return 0.0, np.zeros(grad.shape)
    gain = sum(p**2 / (q + ridge) for p, q in zip(*parts, strict=True)) - g[-1, -1] ** 2 / (h[-1, -1] + ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty(grad.shape)
    for rows, p in ((slice(0, i + 1), 0), (slice(i + 1, None), 2)):
        for cols, q in ((slice(0, j + 1), 0), (slice(j + 1, None), 1)):
            out[rows, cols] = _leaf(parts[0][p + q][i, j], parts[1][p + q][i, j], ridge)
    return float(gain[i, j]), out


def fit_additive(
    x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 6, pair_rounds: int = 60, rate: float = 0.15, ridge: float = 2.0
) -> AdditiveModel:
    """Boost the tables on features ``x`` and labels ``y`` (0 or 1).

    Without rows the model gives 0.5 to every text; with one class only it
    gives that class's smoothed share.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = AdditiveModel(edges, single=[np.zeros(len(e) + 1) for e in edges])
    if not len(x):
        return model
    share = (y.sum() + 1) / (len(y) + 2)
    model.constant = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    b, total = model.bins(x), np.full(len(y), model.constant)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.single):
            if len(table) > 1:
                r, h = slopes()
                step = rate * _tree(np.bincount(b[:, j], r, len(table)), np.bincount(b[:, j], h, len(table)), ridge)
                table += step
                total += step[b[:, j]]

    def two_way(i: int, j: int) -> tuple[float, np.ndarray]:
        shape = len(model.single[i]), len(model.single[j])
        cell, (r, h) = b[:, i] * shape[1] + b[:, j], slopes()
        return _quadrants(*(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (r, h)), ridge)

    ranked = sorted(((two_way(i, j)[0], i, j) for i in range(len(edges)) for j in range(i)), reverse=True)
    chosen = [(i, j) for gain, i, j in ranked[:pairs] if gain > 0]
    model.pairs = {(i, j): np.zeros((len(model.single[i]), len(model.single[j]))) for i, j in chosen}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            step = rate * two_way(i, j)[1]
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> AdditiveModel:
    """Fit on at most ``sample`` labelled rows of the training fold.

    The training fold is the rows whose crc32(doc_id as text) mod 3 is not 1;
    the sample is the labelled ids with the smallest hashes, so it is the same
    in every run. Null qualities and ids do not train. Only the sample's
    features (13 numbers a row) reach the driver.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    known = docs.select("doc_id", "text").join(chosen, "doc_id")
    columns = ", ".join(f"{name} double" for name in FEATURES)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(feature_rows(batch["text"]), columns=list(FEATURES)).assign(quality=batch["quality"].to_numpy(dtype=float))

    rows = known.select("text", F.col("quality").cast("double").alias("quality")).mapInPandas(features, f"{columns}, quality double")
    table = rows.orderBy(*rows.columns).limit(2 * sample).toPandas().to_numpy(dtype=float)
    return fit_additive(table[:, :-1], (table[:, -1] > 0.5).astype(float))


def score_quality(docs: DataFrame, model: AdditiveModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` from 0 to 1 of every whole text (null: as empty)."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score(feature_rows(batch)))

    return docs.withColumn(score, scored(whole(text)))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Repeated rows give repeated rows; a null doc_id is in the training fold
    but has no label; null and empty texts get the score of an empty text; an
    empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    model = train_quality(docs, labels, sample)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
