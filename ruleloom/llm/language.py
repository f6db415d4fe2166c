"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a classifier over hashed byte n-grams of the lower-cased letters
predicts whether the language's bit is one. Classifiers are log ratios of smoothed n-gram frequencies, scaled and
weighted by how well they separate the fitting documents. A document goes to the codeword of least weighted logistic loss;
the softmax over losses is its score, and a small lead over the second codeword flags it as ambiguous.

Fitted on at most ``SAMPLE`` documents per language and ``SAMPLE_TOTAL`` of all, of at most ``FIT_CHARS`` characters; more than ``MOST_GROUPS`` languages
raise ``ValueError``. Every text is scored whole, a part of its bytes at a time.

Defined cases: a null or empty text or one without letters (Unicode category L) is ``und`` with score 0; with no labelled row every text is ``und``; one learned
language takes all texts; equal losses go to the first language in name order; repeated rows get equal results; rows with a null ``doc_id`` keep it and are not
held out; an empty table gives an empty result; columns other than ``doc_id``, ``text`` and ``lang`` are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_map
from .grams import FIT_CHARS, bounded_sample, grams, parts

SAMPLE, SAMPLE_TOTAL, ORDERS, BITS, AMBIGUOUS = 500, 12_000, (2, 3, 4), 14, 0.2
_SPACED = bytes(i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))


def features(text: str) -> Iterator[np.ndarray]:
    """N-gram buckets of a whole text, part by part."""
    raw = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACED) + b" "
    whole = np.frombuffer(raw, np.uint8)
    for start, end in parts(raw):
        yield grams(whole[start : end + max(ORDERS) - 1], ORDERS, BITS, end - start)


def codebook(n: int) -> np.ndarray:
    """``n`` codewords of +-1: all distinct splits up to seven languages, else the best of 64 pseudo-random books."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 7:
        # every two-way split once: the first language's bit is always one
        splits = [s for k in range(1, n) for s in combinations(range(1, n), k)]
        return np.array([[-1 if i in s else 1 for s in splits] for i in range(n)], np.int8)
    length = math.ceil(10 * math.log2(n))
    best, apart = None, -1
    for seed in range(64):
        book = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, length))
        book = book[:, np.abs(book.sum(axis=0)) < n]
        wide = book.astype(np.float32)
        gaps = (book.shape[1] - wide @ wide.T) / 2 + length * np.eye(n)
        if gaps.min() > apart:
            best, apart = book, gaps.min()
    return best


class Model:
    """``weights`` (n-gram, bit), codewords, bit weights, learned languages."""

    def __init__(self, languages: list[str], texts: list[list[str]]):
        self.languages, self.code = languages, codebook(max(1, len(languages)))
        size = len(ORDERS) << BITS
        counts = np.full((len(languages), size), 0.5, np.float32)
        for i, own in enumerate(texts):
            for part in (p for t in own for p in features(t)):
                counts[i] += np.bincount(part, minlength=size)
        shares = counts / counts.sum(axis=1, keepdims=True) if languages else counts
        bits = self.code.shape[1]
        self.weights = np.zeros((size, bits), np.float32)
        for b in range(bits):
            one, other = self.code[:, b] > 0, self.code[:, b] < 0
            if languages and one.any() and other.any():
                self.weights[:, b] = np.log(shares[one].mean(axis=0) / shares[other].mean(axis=0))
        self.scale, self.bit_weight = np.ones(bits), np.ones(bits) / bits
        margins = [(i, m) for i, own in enumerate(texts) for m in map(self.margins, own) if m is not None]
        if margins and len(languages) > 1:
            signed = np.array([self.code[i] * m for i, m in margins])
            self.scale = 4.0 / np.maximum(1e-6, np.median(np.abs(signed), axis=0))
            accuracy = np.clip((signed > 0).mean(axis=0), 0.5, 0.999)
            self.bit_weight = np.log(accuracy / (1 - accuracy)) + 1e-3
            self.bit_weight /= self.bit_weight.sum()

    def margins(self, text: str) -> np.ndarray | None:
        """Mean weight of the text's n-grams by bit."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for part in features(text):
            total += self.weights.take(part, axis=0).sum(axis=0, dtype=np.float64)
            n += len(part)
        return total / n if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = self.margins(text) * self.scale
        loss = (np.logaddexp(0, -self.code * margin) * self.bit_weight).sum(axis=1)
        share = np.exp(-4 * (loss - loss.min()))
        share /= share.sum()
        first, second = np.argsort(-share, kind="stable")[:2]
        return self.languages[first], float(share[first]), bool(share[first] - share[second] < AMBIGUOUS)


def remainder(column: str, divisor: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(divisor))


def fit(docs: DataFrame, most: int = SAMPLE) -> Model:
    """Learn from ``docs(doc_id, text, lang)``, at most ``most`` rows of each language."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(F.length("text") <= FIT_CHARS)
    rows = bounded_sample(known.select("doc_id", "text", "lang"), "lang", most, SAMPLE_TOTAL)
    languages = sorted({r["lang"] for r in rows})
    return Model(languages, [[r["text"] for r in rows if r["lang"] == lang] for lang in languages])


def _predict(columns, model: Model) -> dict:
    got = [model.predict(t.as_py()) for t in columns[1]]
    return {"doc_id": columns[0], "held_out": columns[2], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "ambiguous": [g[2] for g in got]}


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` for each row; held-out rows (remainder 2 of 4) are not learned from."""
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = model or fit(docs.where(~held))
    return batch_map(docs.select("doc_id", "text", held.alias("held_out")), _predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean", model)
