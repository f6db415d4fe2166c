"""BPE encoding and decoding through a table of distinct words.

Spark splits the texts at ASCII white space, where the tokenizer splits as well. A block of documents keeps its
distinct words and, per document, the positions of its words in that list. The words are dealt by hash, each
distinct one is encoded once, and the ids come back to the block by position. The tokenizer has
no decoder, so decoding joins each id with its piece, ids being the row numbers of the piece table, and puts a space between pieces; this too is done
once per distinct word. A word occurs at most once per block, so even the most frequent one adds
only one row per block to its partition, and nothing grows with its occurrences. A task forgets its words when it holds more than ``MOST_WORDS``, so its
memory is bounded; a word that comes again then is encoded again.

Defined cases: null and empty texts and texts of white space only have no ids and decode to the empty text; a text of any length is encoded whole, in the
block of the documents around it; special-token strings inside a text are special tokens, as in the library; repeated rows give repeated results; rows with a
null ``doc_id`` keep it; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, shuffle_width

BLOCK_CHARS, MOST_WORDS = 32_000_000, 1_000_000
_DOCS = "doc_ids: binary, nulls: binary, lengths: binary, indexes: array<binary>, buckets: binary"
_BLOCKS = f"route int, block string, bucket int, words binary, docs struct<{_DOCS}>"
_CODED = f"block string, bucket int, counts binary, ids binary, docs struct<{_DOCS}>"


def _tokenizer(path: str, cache: dict = {}):  # noqa: B006  one per worker
    if path not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        cache[path] = Tokenizer.from_file(path)
        cache[path].no_truncation()
        cache[path].no_padding()
    return cache[path]


def _small(raw: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw if isinstance(raw, bytes) else np.ascontiguousarray(raw).tobytes())


def _large(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _planes(numbers: np.ndarray) -> list[bytes]:
    """Word numbers as one byte each, 255 announcing three more in planes of their own; all compressed."""
    more = (numbers[numbers >= 255] - 255).astype(np.uint32)
    return [_small(np.minimum(numbers, 255).astype(np.uint8)), *(_small((more >> 8 * k & 255).astype(np.uint8)) for k in range(3))]


def _unplaned(planes: list[bytes]) -> np.ndarray:
    first, *more = (_large(p, np.uint8) for p in planes)
    numbers = first.astype(np.uint32)
    numbers[first == 255] += sum(p.astype(np.uint32) << 8 * k for k, p in enumerate(more))
    return numbers


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Block:
    """Documents as word numbers; the numbers are dealt anew by frequency when the block closes."""

    def __init__(self, buckets: int, serial: int):
        self.buckets, self.serial, self.chars = buckets, serial, 0
        self.ids: list = []
        self.lengths: list[np.ndarray] = []
        self.found: list[np.ndarray] = []
        self.numbers = _Numbers()

    def add(self, doc_ids: list, words: pa.ListArray) -> None:
        """Documents and their split texts; empty words do not count. A list's offsets need not begin at 0."""
        found = words.flatten().dictionary_encode()
        known = np.array([self.numbers[w] if w else -1 for w in found.dictionary.to_pylist()], np.int64)
        numbers = known[found.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
        real = numbers >= 0
        ends = np.concatenate([[0], np.cumsum(real)])
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))])
        self.ids += doc_ids
        self.found.append(numbers[real].astype(np.uint32))
        self.lengths.append(np.diff(ends[offsets]).astype(np.uint32))

    def rows(self) -> list[dict]:
        """The documents, and a row of words for each bucket; named by content, so that a recomputed block is the same."""
        flat = np.concatenate(self.found)
        order = np.argsort(-np.bincount(flat, minlength=len(self.numbers)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = list(self.numbers)
        dealt: list[list] = [[] for _ in range(self.buckets)]
        own = np.zeros(len(words), np.uint16)
        for n, at in enumerate(order.tolist()):
            raw = words[at].encode("utf-8", "surrogatepass")
            own[n] = bucket = zlib.crc32(raw) % self.buckets
            dealt[bucket].append(raw)
        docs = {
            "doc_ids": _small(np.array([0 if i is None else i for i in self.ids], np.int64)),
            "nulls": _small(bytes(i is None for i in self.ids)),
            "lengths": _small(np.concatenate(self.lengths)),
            "indexes": _planes(rank[flat]),
            "buckets": _small(own),
        }
        name = xxhash.xxh3_128_hexdigest(b"".join([docs["doc_ids"], docs["lengths"], *docs["indexes"], *(b"\n".join(w) for w in dealt)]))
        name += f"-{TaskContext.get().partitionId() if TaskContext.get() else 0}-{self.serial}"
        out = [{"route": int(name[:7], 16) % self.buckets, "block": name, "docs": docs}]
        return out + [{"route": b, "block": name, "bucket": b, "words": _small(b"\n".join(w))} for b, w in enumerate(dealt) if w]


def blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Word blocks of ``docs(doc_id, text)``: a row of documents as word numbers and a row per bucket of distinct words."""
    schema = arrow_schema(docs.sparkSession, _BLOCKS)
    words = F.split(F.translate("text", "\t\n\r", "   "), " ").alias("words")

    def run(batches):
        block = _Block(buckets, 0)
        for batch in batches:
            # a few documents at a time, so that blocks close near their size
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                block.chars += sum(part.column(2).to_pylist())
                block.add(part.column(0).to_pylist(), part.column(1))
                if block.chars >= BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist(block.rows(), schema)
                    block = _Block(buckets, block.serial + 1)
        if block.ids:
            yield pa.RecordBatch.from_pylist(block.rows(), schema)

    return docs.select("doc_id", words, F.coalesce(F.length("text"), F.lit(0)).alias("n")).mapInArrow(run, _BLOCKS)


def word_ids(parts: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode each distinct word of a bucket once: ``counts, ids`` in place of ``words``; rows of documents pass."""
    schema = arrow_schema(parts.sparkSession, _CODED)

    def run(batches):
        tokenizer, table = _tokenizer(tokenizer_path), {}
        for batch in batches:
            for row in batch.to_pylist():
                out = {"block": row["block"], "bucket": row["bucket"], "docs": row["docs"]}
                if row["words"] is None:
                    yield pa.RecordBatch.from_pylist([out], schema)
                    continue
                raw = row["words"]
                words = zstandard.ZstdDecompressor().decompress(raw).split(b"\n")
                if len(table) + len(words) > MOST_WORDS:
                    table.clear()
                fresh = [w for w in words if w not in table]
                for word, got in zip(fresh, tokenizer.encode_batch([w.decode("utf-8", "surrogatepass") for w in fresh], add_special_tokens=False), strict=True):
                    table[word] = np.array(got.ids, np.uint32).tobytes()
                coded = [table[w] for w in words]
                counts = np.fromiter(map(len, coded), np.uint32, len(coded)) // 4
                yield pa.RecordBatch.from_pylist([out | {"counts": _small(counts), "ids": _small(b"".join(coded))}], schema)

    return parts.mapInArrow(run, _CODED)


def _pieces(path: str, cache: dict = {}) -> pa.Array:  # noqa: B006  one per worker
    """The piece of each id, by row number."""
    if path not in cache:
        tokenizer = _tokenizer(path)
        cache[path] = pa.array([tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())], pa.string())
    return cache[path]


def _joined(texts: pa.Array, lengths: np.ndarray) -> pa.Array:
    """Runs of ``lengths`` texts with spaces between them."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts), " ")


def _runs(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``values[start : start + count]`` for every start and count, one after the other."""
    before = np.cumsum(counts) - counts
    return values[np.repeat(starts - before, counts) + np.arange(counts.sum())]


def encode_decode(docs: DataFrame, tokenizer_path: str, texts: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, with ``texts`` also ``ids`` (the
    little-endian unsigned 32-bit bytes) and ``decoded``."""
    buckets = min(shuffle_width(docs.sparkSession), 65_535)
    # a bucket is one part of the distinct words and is read by one task
    coded = word_ids(blocks(docs, buckets).repartitionById(buckets, F.col("route")), tokenizer_path)
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if texts else "")
    schema = arrow_schema(docs.sparkSession, ddl)

    def join_back(block: pa.Table) -> pa.Table:
        pieces = _pieces(tokenizer_path)
        rows = block.to_pylist()
        (row,) = (r["docs"] for r in rows if r["docs"] is not None)
        parts = sorted((r["bucket"], r["counts"], r["ids"]) for r in rows if r["docs"] is None)
        # words stand bucket by bucket; ``place`` is where a word number stands
        order = np.argsort(_large(row["buckets"], np.uint16), kind="stable")
        counts = np.concatenate([np.zeros(0, np.int64), *(_large(c, np.uint32) for _, c, _ in parts)]).astype(np.int64)
        if len(counts) != len(order):
            raise RuntimeError("a block lost words")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids = np.concatenate([np.zeros(0, np.uint32), *(_large(i, np.uint32) for _, _, i in parts)])
        starts = np.cumsum(counts) - counts
        shown = _joined(pieces.take(pa.array(ids)), counts)
        numbers, lengths = place[_unplaned(row["indexes"])], _large(row["lengths"], np.uint32).astype(np.int64)
        nulls = zstandard.ZstdDecompressor().decompress(row["nulls"])
        doc_ids = [None if null else i for i, null in zip(_large(row["doc_ids"], np.int64).tolist(), nulls, strict=True)]
        out: dict[str, list] = {f.name: [] for f in schema}
        first, ends = 0, np.cumsum(lengths)
        while first < len(doc_ids):
            # documents of about a million words at a time, one at least
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 1_000_000, side="right")))
            own = numbers[ends[first] - lengths[first] : ends[last - 1]]
            tokens = _runs(ids, starts[own], counts[own]).astype("<u4")
            upto = np.concatenate([[0], np.cumsum(counts[own])])
            bounds = upto[np.concatenate([[0], ends[first:last] - ends[first] + lengths[first]])].tolist()
            heard = counts[own] > 0  # words of characters that the tokenizer drops are silent
            n_heard = np.diff(np.concatenate([[0], np.cumsum(heard)])[np.concatenate([[0], ends[first:last] - ends[first] + lengths[first]])])
            texts_ = _joined(shown.take(pa.array(own[heard])), n_heard).to_pylist()
            raw = tokens.tobytes()
            for doc_id, start, end, text in zip(doc_ids[first:last], bounds, bounds[1:], texts_, strict=False):
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(end - start)
                out["ids_sha256"].append(hashlib.sha256(raw[4 * start : 4 * end]).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                if texts:
                    out["ids"].append(raw[4 * start : 4 * end])
                    out["decoded"].append(text)
            first = last
        return pa.Table.from_pydict(out, schema)

    return coded.groupBy("block").applyInArrow(join_back, ddl)
