"""Best-fit packing planned on a histogram of lengths.

Documents become byte-level BPE ids followed by id 0; one longer than the sequence is cut, its first piece
taking the remainder so that all later pieces fill a sequence each. The plan runs best-fit decreasing over
*counts* of lengths (at most ``limit`` numbers, whatever the corpus), so the driver holds nothing that grows
with the documents. A piece then takes its slot by a join on its rank within its length; ranks come
from counts per (length, salt), so one length held by a third of all pieces is ranked by many tasks.

Defined cases: null and empty texts are the single id 0; texts of any length are encoded whole; repeated rows are packed as often as they occur;
rows with a null ``doc_id`` are packed like others and keep it; an empty table gives an empty result; ties within a length are broken by ``doc_id`` and
piece; columns other than ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_map, shuffle_width, stored

LIMIT = 2048
#: The tokenizer's splitting pattern, and the characters for whose classes all regular-expression engines agree.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSAFE = re.compile("[^\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ɏ]|<\\|")


class ByteEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the library's own.

    Where the file's merges are in the order of their ids, merging by rank gives the same ids, and a rank encoder
    built from that file takes the texts of common characters; any other text goes through the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.ranked = _rank_encoder(json.load(f))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.ranked is None or _UNSAFE.search(text):
            return self.whole(text)
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False).tobytes()


def _rank_encoder(spec: dict):
    """A rank encoder of a byte-level BPE file, or None where ranks could give other ids than the merges."""
    import tiktoken

    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    model, split = spec["model"], spec["pre_tokenizer"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    added = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    in_order = [vocab.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges)))
    if not in_order or len(vocab) != 256 + len(merges) or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict[str, ByteEncoder] = {}


def _encoder(path: str) -> ByteEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def _cut(columns, path: str, limit: int) -> dict:
    out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
    encode = _encoder(path).encode
    for doc_id, text in zip(columns[0].to_pylist(), columns[1], strict=True):
        ids = encode(text.as_py()) + b"\0\0\0\0"
        total = len(ids) // 4
        start, length, piece = 0, (total - 1) % limit + 1, 0
        while start < total:
            for name, value in zip(out, (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                out[name].append(value)
            start, length, piece = start + length, limit, piece + 1
    return out


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of ``docs(doc_id, text)``, before placement."""
    return batch_map(docs.select("doc_id", "text"), _cut, "doc_id long, piece int, start long, length long, ids_crc32 long", tokenizer_path, limit)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: ``(length, first_rank, past_rank, first_sequence, per_sequence, offset)``.

    Sequences filled alike are one group of (how many, free, contents). A length goes to the group with the
    least room that holds it; one sequence takes as many as it can, being the tightest after each, so whole groups
    move at once and the number of groups stays bounded by the lengths.
    """
    groups: dict[int, list[list]] = {}  # free -> [[how many, ((length, per sequence), ...)]]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        fresh: list[tuple[int, list]] = []

        def place(n: int, free: int, held: tuple, left: int) -> int:
            """Fill up to n sequences; returns how many pieces are left."""
            fits = free // length
            full = min(n, left // fits)
            if full:
                fresh.append((free - fits * length, [full, (*held, (length, fits))]))
                left -= full * fits
            if left and n > full:
                fresh.append((free - left * length, [1, (*held, (length, left))]))
                left, full = 0, full + 1
            if n > full:
                fresh.append((free, [n - full, held]))
            return left

        for free in sorted(k for k in groups if k >= length):
            for n, held in groups.pop(free):
                left = place(n, free, held, left) if left else (fresh.append((free, [n, held])) or 0)
            if not left:
                break
        if left:
            place(-(-left // (limit // length)), limit, (), left)
        for free, group in fresh:
            groups.setdefault(free, []).append(group)
    slots, sequence, ranks = [], 0, Counter()
    for free in sorted(groups):
        for n, held in groups[free]:
            offset = 0
            for length, each in held:
                slots.append((length, ranks[length], ranks[length] + n * each, sequence, each, offset))
                ranks[length] += n * each
                offset += each * length
            sequence += n
    return slots


def place(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Give every row of a stored pieces table its ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    salts = max(16, shuffle_width(spark))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)).cast("int"))
    cells = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    # at most limit lengths reach the driver
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = cells.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).select("length", "_salt", "_before")
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("_local", local).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_local") - 1)
    slots = spark.createDataFrame(plan(counts, limit), "length long, _from long, _past long, _first long, _each long, _offset long")
    at = F.col("_rank") - F.col("_from")
    # the plan has a few rows per length, a number that the limit bounds and the corpus does not
    return ranked.join(F.broadcast(slots), "length").where("_rank >= _from AND _rank < _past").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_first") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_each")) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece with its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return place(stored(pieces(docs, tokenizer_path, limit)), limit)
