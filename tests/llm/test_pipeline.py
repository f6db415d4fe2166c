"""The pipeline against its stages in plain Python."""

import math
import re
from pathlib import Path

import pytest

import corpus_pipeline
from ruleloom.llm import quality, secrets, simhash
from ruleloom.llm.catalogue import vocabulary

from .test_models import plain_quality_features
from .test_operators import SECRETS, roots, spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
HARD = "doc_id long, text string, lang string, source string, n_chars long, keys int, component_id long, kept boolean, node long"


def plain_good(model, text):
    found = plain_quality_features(text)
    logit = model.bias + (sum(float(model.value[f]) for f in found) / len(found) if found else 0.0)
    return 1 / (1 + math.exp(-logit)) >= 0.3


def plain_redacted(text):
    found = spans(text, SECRETS)
    found += secrets.novel_spans(text, sorted(found))
    hidden = set()
    for start, _, end in found:
        hidden.update(range(start, end))
    out = ""
    for i, c in enumerate(text):
        if i not in hidden:
            out += c
        elif i - 1 not in hidden or any(s == i for s, _, _ in found) and not any(s < i < e for s, _, e in found):
            out += "[secret]"
    return out


def firsts(kept):
    """Of each group of similar texts the smallest identifier, by all pairs."""
    ids = sorted(kept)
    own = [simhash.wide_fingerprint(kept[i], 5) for i in ids]
    words = [(int.from_bytes(bits.tobytes(), "big"), set(keys.tolist())) for bits, keys in own]
    radius = simhash.wide_radius(0.8)
    near = [(i, j) for i in range(len(ids)) for j in range(i) if (words[i][0] ^ words[j][0]).bit_count() <= radius and words[i][1] & words[j][1]]
    return {ids[r] for r in roots(len(ids), near)}


def test_run(spark):
    from tokenizers import Tokenizer

    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, marks)
    kept = {r["doc_id"]: r["text"] for r in docs.collect() if plain_good(model, r["text"])}
    first: dict = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i] or ""), i)
    kept = {i: kept[i] for i in first.values()}
    kept = {i: plain_redacted(kept[i] or "") for i in firsts(kept)}
    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    plain.no_truncation()
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    got: dict = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want and 0 < len(want) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[1:]])
def test_stages_on_hard_rows(spark, name):
    """Nulls in every column, ties, repeated rows, no rows and columns with the operators' own names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    text = "one two three four five six seven eight nine ten"
    known = [(5, text), (2, text), (2, text), (None, "a text of its own with no identifier at all"), (7, None), (8, ""), (9, "password=abcdefgh12345678 and more")]
    rows = [(i, t, "en" if i == 5 else None, None, 10, 3, 7, True, 5) for i, t in known]
    df = spark.createDataFrame(rows, HARD)
    out = stage(spark, df, SF)
    got = out.collect()
    ids = sorted((r["doc_id"] for r in got), key=str)
    if name == "best-fit packing":
        assert ids == sorted((r[0] for r in rows), key=str)
    else:
        assert out.columns == df.columns and all((r["keys"], r["component_id"], r["kept"], r["node"]) == (3, 7, True, 5) for r in got)
        want = {"exact dedup": [2, 2, 7, 9, None], "simhash near-dedup": [2, 2, 7, 9, None], "secret scans": [2, 2, 5, 7, 8, 9, None]}[name]
        assert ids == sorted(want, key=str)
    if name == "secret scans":
        assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got}[9] == ("[secret] and more", 17) and {r["doc_id"]: r["text"] for r in got}[7] is None
    empty = stage(spark, spark.createDataFrame([], HARD), SF)
    assert empty.count() == 0


def test_quality_stage_on_hard_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    more = spark.createDataFrame([(None, "a plain text of some words", None, None, None), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0)], docs.schema)
    every = docs.unionByName(more)
    got = dict(corpus_pipeline.STAGES)["quality classifier"](spark, every, SF).collect()
    want = [r for r in every.collect() if plain_good(model, r["text"])]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert corpus_pipeline.STAGES[0][1](spark, every.limit(0), SF).count() == 0
