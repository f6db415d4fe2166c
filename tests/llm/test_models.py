"""The trained operators against slow, plain implementations of their fits and scores."""

import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest

from ruleloom.llm import grams, language, quality

from .conftest import crc

M32, M64 = 2**32 - 1, 2**64 - 1
letter = lambda b: (b + 1) * 0x9E3779B97F4A7C15 % 2**64 >> 29 & M32


def plain_gram(raw, place, bits):
    h = 0
    for k, b in enumerate(raw):
        h = letter(b) if not k else (h * 0x9E3779B1 + letter(b)) & M32
    x = (h ^ h >> 15) * 0x85EBCA6B & M32
    return (x >> 32 - bits) + (place << bits)


def plain_grams(raw, orders, bits):
    return [plain_gram(raw[i : i + n], k, bits) for k, n in enumerate(orders) for i in range(len(raw) - n + 1)]


def plain_word(raw, bits):
    h = sum(letter(b) * pow(0x100000001B3, i, 2**64) for i, b in enumerate(raw)) & M64
    return (h ^ h >> 31) * 0xBF58476D1CE4E5B9 % 2**64 >> 64 - bits


def plain_quality_features(text):
    body = (text or "").encode()
    if not body:
        return []
    words = "".join(chr(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c) for c in body).encode("latin-1").split(b" ")
    shape = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 else ord("0") if 48 <= c <= 57 else ord("n") if c >= 128 else c for c in body)
    first = 1 << quality.WORD_BITS
    second = first + (len(quality.ORDERS) << quality.GRAM_BITS)
    return [plain_word(w, quality.WORD_BITS) for w in words if w] + [g + first for g in plain_grams(b" " + body + b" ", quality.ORDERS, quality.GRAM_BITS)] + [
        g + second for g in plain_grams(b" " + shape + b" ", quality.SHAPE_ORDERS, quality.GRAM_BITS)]


def plain_language_features(text):
    raw = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in (" " + text.lower() + " ").encode())
    return plain_grams(raw, language.ORDERS, language.BITS)


TEXTS = ["The river, 12 times Ünder\tthe bridge.", "a", "ß é 日本", "x" * 150 + " end", "Tab\tand\nline  two spaces", "BUY!!! $$$ now 99"]


@pytest.mark.parametrize("part", [grams.PART, 64, 8])
def test_features_do_not_depend_on_the_parts(monkeypatch, part):
    monkeypatch.setattr(grams, "PART", part)
    for text in (t for t in TEXTS if max(map(len, t.encode().split())) < part):
        for own, plain in ((quality.features, plain_quality_features), (language.features, plain_language_features)):
            assert Counter(np.concatenate(list(own(text))).tolist()) == Counter(plain(text)), text
    for size in (1, 7, 8, 9, 100):
        raw = (b"ab " * size)[:size]
        cuts = list(grams.parts(raw))
        assert cuts[0][0] == 0 and cuts[-1][1] == size and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False)) and all(0 < e - s <= part for s, e in cuts)


def test_quality_scores_are_the_fitted_weights_averaged():
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=quality.SIZE), 0.25)
    for text in [*TEXTS, "", None]:
        found = plain_quality_features(text)
        logit = 0.25 + (sum(float(model.value[f]) for f in found) / len(found) if found else 0)
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)


def test_quality_fit_is_plain_gradient_descent(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 2)
    texts = ["the old mill by the river", "BUY now $$$", "a stone bridge", "### $$$ ###", "", "slow water and old stone"]
    marks, weights = [1, 0, 1, 0, 1, 1], [1.0, 2.0, 1.0, 2.0, 1.0, 1.0]
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.1, (quality.SIZE, quality.DIM)).astype(np.float32).astype(float)
    layer = rng.normal(0, 0.5, (quality.DIM, 2)).astype(np.float32).astype(float)
    mass = [sum(w for w, m in zip(weights, marks, strict=True) if m == k) for k in (0, 1)]
    bias = [math.log(m / sum(mass)) for m in mass]
    scale, step, steps = len(weights) / sum(weights), 0, 2 * len(texts)
    for _ in range(2):
        for i in rng.permutation(len(texts)).tolist():
            rate = quality.RATE * (1 - step / steps)
            step += 1
            counts = Counter(plain_quality_features(texts[i]))
            if not counts:
                continue
            n = sum(counts.values())
            mean = [sum(c * vectors[f][d] for f, c in counts.items()) / n for d in range(quality.DIM)]
            logits = [sum(mean[d] * layer[d][k] for d in range(quality.DIM)) + bias[k] for k in (0, 1)]
            share = [math.exp(z) / sum(map(math.exp, logits)) for z in logits]
            error = [(share[k] - (marks[i] == k)) * weights[i] * scale for k in (0, 1)]
            back = [sum(layer[d][k] * error[k] for k in (0, 1)) for d in range(quality.DIM)]
            for d in range(quality.DIM):
                for k in (0, 1):
                    layer[d][k] -= rate * 0.1 * (mean[d] * error[k] + quality.DECAY * layer[d][k])
            square = max(sum((c / n) ** 2 for c in counts.values()), 1e-4)
            for f, c in counts.items():
                for d in range(quality.DIM):
                    vectors[f][d] -= rate / square * c / n * back[d]
    value = (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32)
    model = quality.train(texts, marks, weights)
    want = quality.Model(value, bias[1] - bias[0])
    for text in [*texts, *TEXTS, None]:
        assert model.score(text) == pytest.approx(want.score(text), abs=1e-3)


def test_language_fit_and_decoding_by_loops():
    own = {"de": ["der die und das", "ein haus und der baum"], "en": ["the of and to in", "a house and the tree"], "fr": ["le la et les des", "une maison et les arbres"]}
    names = sorted(own)
    model = language.Model(names, [own[n] for n in names])
    book = language.codebook(3)
    size = len(language.ORDERS) << language.BITS
    counts = {n: Counter(f for t in own[n] for f in plain_language_features(t)) for n in names}
    total = {n: sum(counts[n].values()) + size / 2 for n in names}
    share = lambda n, f: (counts[n][f] + 0.5) / total[n]
    side = lambda b, sign: [n for n, word in zip(names, book, strict=True) if word[b] == sign]

    def weight(f, b):
        return math.log(statistics.mean(share(n, f) for n in side(b, 1)) / statistics.mean(share(n, f) for n in side(b, -1)))

    bits = range(book.shape[1])
    margins = lambda t: [statistics.mean(weight(f, b) for f in plain_language_features(t)) for b in bits]
    signed = [[m * s for m, s in zip(margins(t), word, strict=True)] for n, word in zip(names, book, strict=True) for t in own[n]]
    scale = [4 / statistics.median(abs(row[b]) for row in signed) for b in bits]
    right = [min(0.999, max(0.5, statistics.mean(int(row[b] > 0) for row in signed))) for b in bits]
    of_bit = [math.log(r / (1 - r)) + 1e-3 for r in right]
    for text in ["und das haus", "the tree of the house", "les maisons", "la und the"]:
        found = margins(text)
        loss = [sum(math.log(1 + math.exp(-s * m * k)) * w for s, m, k, w in zip(word, found, scale, of_bit, strict=True)) / sum(of_bit) for word in book]
        weightings = [math.exp(-4 * (x - min(loss))) for x in loss]
        first, second = sorted(range(3), key=lambda i: loss[i])[:2]
        got = model.predict(text)
        assert got[0] == names[first] and got[1] == pytest.approx(weightings[first] / sum(weightings), abs=1e-4)
        assert got[2] == ((weightings[first] - weightings[second]) / sum(weightings) < language.AMBIGUOUS)


def test_only_letters_make_a_language():
    model = language.Model(["de", "en"], [["der die das"], ["the of and"]])
    for text in (None, "", " \n", "²½ ①", "12 + 3", "٣ ९", "_-‿"):
        assert model.predict(text) == ("und", 0.0, True)
    for text in ("x", "1 ª", "ǅ", "日", "½ ʰ"):
        assert model.predict(text)[0] in ("de", "en")
    assert language.Model([], []).predict("the") == ("und", 0.0, True)


def test_long_texts_take_little_memory():
    import tracemalloc

    text = " ".join(random.Random(1).choice(["alder", "birch", "éclair"]) for _ in range(700_000))
    model = language.Model(list("abcdefg"), [[f"{c}x{c} hello {c}{c}"] for c in "abcdefg"])
    scorer = quality.Model(np.zeros(quality.SIZE), 0.0)
    for run in (model.predict, scorer.score):
        tracemalloc.start()
        run(text)
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
        tracemalloc.stop()


NAMED = "doc_id long, text string, lang string, held_out int, score int, _at int, _n int, _share int, quality int"


def test_models_on_hard_rows(spark):
    """Nulls in every column, ties, repeated rows, no rows and columns with the operators' own names."""
    good, bad = "der fluss und das haus am berg", "the river and the house on the hill"
    rows = [(i, bad if i % 2 else good, "en" if i % 2 else "de", 1, 1, 1, 1, 1, 1) for i in range(60)]
    rows += [rows[3], rows[3], (None, good, "de", *[None] * 6), (None, None, None, *[None] * 6), (70, "", "en", *[2] * 6), (71, good, None, *[2] * 6)]
    df = spark.createDataFrame(rows, NAMED)
    got = [r.asDict() for r in language.identify(df).collect()]
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 2
    assert all(r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"], 4) == 2) for r in got)
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    assert sorted(r["lang_pred"] for r in got if r["doc_id"] is None) == ["de", "und"]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, 1, None), (4, None, None), (None, 1, 1), (999, 0, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    scored = [r.asDict() for r in quality.classify(df, marks).collect()]
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in scored if r["doc_id"] is not None and r["doc_id"] < 60)
    assert len({r["score"] for r in scored if r["doc_id"] == 3}) == 1
    kept = quality.keep_good(df, marks)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= set(range(1, 60, 2))
    no_labels = quality.classify(df, marks.limit(0)).collect()
    assert {r["score"] for r in no_labels} == {0.5}
    empty = spark.createDataFrame([], NAMED)
    assert language.identify(empty).count() == quality.classify(empty, marks).count() == quality.keep_good(empty, marks).count() == 0
    assert {r["lang_pred"] for r in language.identify(df.withColumn("lang", df["lang"].substr(9, 1).cast("string")).where("doc_id IS NULL"), language.Model([], [])).collect()} == {"und"}
