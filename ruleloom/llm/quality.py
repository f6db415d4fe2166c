"""Document quality by supervised subword embeddings.

Hashed words, hashed byte n-grams and n-grams of character shapes each have a learned vector; a document is the
average of its vectors, and a softmax layer gives the probability of label 1. Vectors and layer are trained
together by plain stochastic gradient descent in numpy, one document a step. As the layer is linear in the average, a trained
model scores by one number per feature, the difference of its two logits.

Fitted on at most ``SAMPLE`` labelled rows of each label, of texts of at most ``FIT_CHARS`` characters. Every text is scored whole, a part of its bytes at a
time; a word of more than 65,536 bytes counts as several.

Defined cases: null and empty texts score the base rate; a document with several label rows counts by each, and one labelled 0 and 1 by both; labels other than 0 and
1, null ones and those without a document are passed over; no labelled row gives 0.5 everywhere, one label alone its clipped rate; repeated rows get equal results; rows
with a null ``doc_id`` keep it, are scored, not held out and not learned from; an empty table gives an empty result; columns other than ``doc_id``, ``text`` and
``quality`` are not read by ``classify`` and pass through ``keep_good`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_map
from .grams import FIT_CHARS, bounded_sample, grams, parts, word_hashes
from .language import remainder

SAMPLE, WORD_BITS, GRAM_BITS, ORDERS, SHAPE_ORDERS = 3000, 16, 15, (1, 3, 5), (2, 3, 5)
DIM, EPOCHS, RATE, DECAY, THRESHOLD = 8, 6, 0.4, 1e-5, 0.3
_SHAPES = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 else 48 if 48 <= i <= 57 else 110 if i >= 128 else i for i in range(256))
SIZE = (1 << WORD_BITS) + (len(ORDERS) + len(SHAPE_ORDERS) << GRAM_BITS)


def features(text: str | None) -> Iterator[np.ndarray]:
    """Feature numbers of a whole text, repeats included, part by part."""
    if not text:
        return
    body = text.encode("utf-8", "surrogatepass")
    spaced = b" " + body.translate(_WORDS) + b" "
    raw, plain, shape = (np.frombuffer(b, np.uint8) for b in (b" " + body + b" ", spaced, b" " + body.translate(_SHAPES) + b" "))
    base, more = 1 << WORD_BITS, max(ORDERS + SHAPE_ORDERS) - 1
    for start, end in parts(spaced):
        n, held = end - start, slice(start, end + more)
        yield np.concatenate([
            word_hashes(plain[start:end], WORD_BITS), grams(raw[held], ORDERS, GRAM_BITS, n) + base,
            grams(shape[held], SHAPE_ORDERS, GRAM_BITS, n) + (base + (len(ORDERS) << GRAM_BITS))])


_WORDS = bytes(i + 32 if 65 <= i <= 90 else 32 if 9 <= i <= 13 else i for i in range(256))


class Model:
    """``value`` per feature (logit of 1 less logit of 0) and ``bias``."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value.astype(np.float32), bias

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for part in features(text):
            total += float(self.value.take(part).sum(dtype=np.float64))
            n += len(part)
        logit = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def train(texts: list[str | None], marks: list[int], weights: list[float], seed: int = 7) -> Model:
    """Embeddings and softmax by stochastic gradient descent over documents; ``weights`` undo uneven sampling."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (SIZE, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    mass = [sum(w for w, m in zip(weights, marks, strict=True) if m == k) for k in (0, 1)]
    if not texts or not all(mass):
        rate = mass[1] / sum(mass) if texts else 0.5
        return Model(np.zeros(SIZE), float(np.log(np.clip(rate, 0.01, 0.99) / (1 - np.clip(rate, 0.01, 0.99)))))
    bias = np.log(np.array(mass, np.float32) / sum(mass))
    bags = []
    for text in texts:
        ids, counts = np.unique(np.concatenate([np.zeros(0, np.int32), *features(text)]), return_counts=True)
        bags.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    scale = len(weights) / sum(weights)
    steps, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)).tolist():
            rate = RATE * (1 - step / steps)
            step += 1
            ids, share = bags[i]
            if not len(ids):
                continue
            own = vectors[ids]
            mean = share @ own
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            error = p
            error[marks[i]] -= 1
            error *= np.float32(weights[i] * scale)
            back = layer @ error
            layer -= np.float32(rate * 0.1) * (np.outer(mean, error) + np.float32(DECAY) * layer)
            # a document's average moves by the rate, whatever its number of features
            vectors[ids] = own - np.float32(rate) / max(float(share @ share), 1e-4) * share[:, None] * back[None]
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def held(column: str = "doc_id"):
    return F.coalesce(remainder(column, 5) == 0, F.lit(False))


def fit(docs: DataFrame, marks: DataFrame, most: int = SAMPLE) -> Model:
    """Learn ``marks(doc_id, quality)`` from ``docs(doc_id, text)`` outside the held-out fold."""
    labelled = marks.where(~held()).where("quality IN (0, 1)").select("doc_id", "quality")
    rates = {r["quality"]: r["n"] for r in labelled.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    # the sample is drawn before texts are met, so that only its bounded number of identifiers is sent to them
    drawn = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in bounded_sample(labelled, "quality", most)], "doc_id long, quality int")
    met = docs.where(F.length("text") <= FIT_CHARS).select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = sorted(met.collect(), key=lambda r: (r["doc_id"], r["quality"], r["text"]))
    drawn = {k: sum(r["quality"] == k for r in rows) for k in (0, 1)}
    return train([r["text"] for r in rows], [r["quality"] for r in rows], [rates[r["quality"]] / drawn[r["quality"]] for r in rows])


def _score(columns, model: Model) -> dict:
    scores = [model.score(t.as_py()) for t in columns[1]]
    return {"doc_id": columns[0], "held_out": columns[2], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}


def classify(docs: DataFrame, marks: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; rows of the held-out fold (remainder 0 of 5) are not learned from."""
    model = model or fit(docs, marks)
    return batch_map(docs.select("doc_id", "text", held().alias("held_out")), _score, "doc_id long, held_out boolean, score double, predicted int", model)


def keep_good(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns as they were."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    model = fit(docs, marks)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) >= THRESHOLD for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)))
