"""Language identification: family first, then one-versus-one inside it.

Linear support vector machines over hashed letter trigrams. One machine a
language family, against all others, picks the family; within it, one machine
for each two languages, and the language with most wins (ties: larger sum of
margins) is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import fold

#: The family of common two-letter language codes; any other language is a family by itself.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
}
DIMENSIONS = 4096
_SPACE = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
_BLOCK = 1 << 22
_PACKED = np.dtype([("place", ">u2"), ("count", "<f4")])


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), f"only-{lang}")


def _letters(text: str | None) -> bytes:
    """Lower-cased UTF-8 with one space for each ASCII character that is no letter, and one at either end."""
    return b" " + (text or "").lower().encode("utf-8", "replace").translate(_SPACE) + b" "


def _hashes(raw: bytes) -> np.ndarray:
    """The bucket of each three bytes in a row."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(20)


def trigram_counts(text: str | None) -> np.ndarray:
    """Counts of the whole text's trigram buckets."""
    total, raw = np.zeros(DIMENSIONS), _letters(text)
    for at in range(0, max(len(raw) - 2, 0), _BLOCK):
        total += np.bincount(_hashes(raw[at : at + _BLOCK + 2]), minlength=DIMENSIONS)
    return total


def packed_counts(counts: np.ndarray) -> bytes:
    """The counts that are not 0, each behind 4096 less its bucket; such bytes are in the order of the whole vectors' bytes."""
    held = np.flatnonzero(counts)
    out = np.empty(len(held), _PACKED)
    out["place"], out["count"] = DIMENSIONS - held, counts[held]
    return out.tobytes()


def unpacked_counts(raw, into: np.ndarray) -> None:
    """Add what ``packed_counts`` gave to a vector of zeros."""
    held = np.frombuffer(raw, _PACKED)
    into[DIMENSIONS - held["place"].astype(np.int64)] = held["count"]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit_linear_svm(x: np.ndarray, y: np.ndarray, rows: np.ndarray, strength: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Weights of a linear SVM (hinge loss, no offset) by dual coordinate descent on some rows of ``x``; ``y`` is -1 or 1."""
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(rows)), np.einsum("ij,ij->i", x, x)[rows]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            if square[i]:
                one = x[rows[i]]
                new = min(max(alpha[i] - (y[i] * (w @ one) - 1) / square[i], 0.0), strength)
                w += ((new - alpha[i]) * y[i]) * one
                alpha[i] = new
    return w


@dataclass
class LanguageModel:
    """``weights``: a column for each family, then for each pair of languages of one family."""

    families: list[str]
    members: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    scale: np.ndarray

    def margins(self, texts) -> np.ndarray:
        """Mean weight of each text's trigrams, a column a machine; texts are taken in blocks of bounded size."""
        out, held, ids, size = np.zeros((len(texts), self.weights.shape[1])), [], [], 0
        table = self.weights.astype(np.float32)

        def flush() -> None:
            if not held:
                return
            raw = b"".join(held)
            rows = table[_hashes(raw)]
            ends = np.cumsum([len(h) for h in held])
            for i, n, end in zip(ids, map(len, held), ends, strict=True):
                if n > 2:
                    out[i] = rows[end - n : end - 2].mean(axis=0, dtype=np.float64)
            held.clear()
            ids.clear()

        for i, text in enumerate(texts):
            raw = _letters(text)
            if len(raw) > _BLOCK:  # a very long text by itself, in pieces
                total = np.zeros(table.shape[1])
                for at in range(0, len(raw) - 2, _BLOCK):
                    total += table[_hashes(raw[at : at + _BLOCK + 2])].sum(axis=0, dtype=np.float64)
                out[i] = total / (len(raw) - 2)
                continue
            held.append(raw)
            ids.append(i)
            size += len(raw)
            if size >= _BLOCK // 4:
                flush()
                size = 0
        flush()
        return out

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: 'und' and 0 if it has no letter or nothing was learned."""
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.families:
            return langs, scores
        chance = 1 / (1 + np.exp(-np.clip(self.margins(texts) * self.scale, -20, 20)))
        best, first = chance[:, : len(self.families)].argmax(axis=1), len(self.families)
        column = {pair: first + k for k, pair in enumerate(self.pairs)}
        for i, text in enumerate(texts):
            if not has_letter(text):
                continue
            names = self.members[best[i]]
            score = float(chance[i, best[i]]) if len(self.families) > 1 else 1.0
            if len(names) == 1:
                langs[i], scores[i] = names[0], score
                continue
            won = {name: [0.0, 0.0, 1.0] for name in names}
            for a, b in combinations(names, 2):
                p = float(chance[i, column[a, b]])
                for name, q in ((a, p), (b, 1 - p)):
                    won[name][0] += q > 0.5
                    won[name][1] += q
                    won[name][2] = min(won[name][2], q)
            langs[i] = max(names, key=lambda name: won[name][:2])
            scores[i] = score * won[langs[i]][2]
        return langs, scores


def fit_languages(x: np.ndarray, langs: list[str]) -> LanguageModel:
    """Train all machines on trigram counts ``x`` and their languages."""
    names = sorted(set(langs))
    families = sorted({family_of(n) for n in names})
    members = [[n for n in names if family_of(n) == f] for f in families]
    pairs = [pair for group in members for pair in combinations(group, 2)]
    label, kin = np.array(langs, dtype=object), np.array([family_of(n) for n in langs], dtype=object)
    sums = np.maximum(x.sum(axis=1), 1e-12)
    unit = x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12).astype(x.dtype)[:, None]
    columns, tasks = [], [(np.ones(len(x), bool), kin == f) for f in families] + [((label == a) | (label == b), label == a) for a, b in pairs]
    scale = []

    def summed(w: np.ndarray) -> np.ndarray:
        # In parts, as a product with doubles makes doubles of all counts.
        return np.concatenate([x[:0] @ w, *(x[at : at + 256] @ w for at in range(0, len(x), 256))])

    for rows, positive in tasks:
        y = np.where(positive[rows], 1.0, -1.0)
        w = fit_linear_svm(unit, y, np.flatnonzero(rows)) if len(set(y)) == 2 else np.zeros(x.shape[1])
        columns.append(w)
        scale.append(3.0 / max(float(np.median(np.abs(summed(w)[rows] / sums[rows]))), 1e-9) if rows.any() else 1.0)
    weights = np.stack(columns, axis=1) if columns else np.zeros((DIMENSIONS, 0))
    return LanguageModel(families, members, pairs, weights, np.array(scale))


def train_languages(docs: DataFrame, sample: int = 2_000) -> LanguageModel:
    """Fit on at most ``sample`` documents of the training fold.

    The fold is the rows whose crc32(doc_id as text) mod 5 is not 0 and whose
    lang is not null; the sample takes, of each language, the rows with the
    smallest hashes in turn, so rare languages are in it. What reaches the
    driver is the counts of a sampled row that are not 0.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 5) != 0))
    # Ranks within a language and one of 64 buckets of the hash, so a hot language is dealt to many tasks.
    light = rows.select("doc_id", "lang", F.xxhash64("doc_id", "lang").alias("h"))
    part = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "doc_id")
    near = light.withColumn("n", F.row_number().over(part)).where(F.col("n") <= sample // 16)
    chosen = near.orderBy("n", "h", "doc_id").limit(sample).select("doc_id", "lang").distinct()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = [packed_counts(trigram_counts(t).astype(np.float32)) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "x": vectors})

    known = rows.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"]).select("lang", "text")
    table = known.mapInPandas(counted, "lang string, x binary").orderBy("lang", "x").limit(2 * sample).toArrow()
    # One copy of the vectors on the driver.
    langs, x = table.column("lang").to_pylist(), np.zeros((table.num_rows, DIMENSIONS), np.float32)
    for row, vector in zip(x, table.column("x"), strict=True):
        unpacked_counts(vector.as_buffer(), row)
    del table
    return fit_languages(x, langs)


def add_language(docs: DataFrame, model: LanguageModel, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a column struct<lang, score> of every whole text."""

    @F.pandas_udf("lang string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            langs, scores = model.predict(list(batch))
            yield pd.DataFrame({"lang": langs, "score": scores})

    return docs.withColumn(name, predicted(F.col(text)))


def languages(docs: DataFrame, sample: int = 2_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Null texts and texts without a letter are 'und' with score 0, as is every
    text if no labelled row exists. Repeated rows give repeated rows; a null
    doc_id counts as '' for the fold; an empty table gives no rows.
    """
    model = train_languages(docs, sample)
    found = add_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
