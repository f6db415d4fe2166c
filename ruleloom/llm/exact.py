"""Exact duplicates by Patricia tries over length-and-content-hash partitions.

Texts are equal when identical after each run of ASCII white space became one space; a null text is an
empty one. The documents are read once. Each map task inserts the full byte strings into compressed radix tries, one per partition of (length, hash),
whose terminals hold the smallest identifier and a count, and writes a key per document and a terminal per distinct text, so a text held by a third of all
rows goes on once per task. When a task's tries hold more than ``SPILL_BYTES`` of labels, their largest subtrees are spilled until half of it is left:
the terminals below are written as partial owners, the other subtrees stay in place.

Each merging task then inserts its partition's strings in byte order into one trie and adds partial owners up. In that order a subtree
left of the last string is complete, so beyond ``SPILL_BYTES`` complete subtrees are spilled as results and the path of the last string stays. Owners go back
to the documents by length, hash and SHA-256 of the full string; that join's document side may be hot, adaptive execution splits it.
``keep_first`` needs the owners only, so its map tasks write no keys and their terminals go to the merging tasks without a table between.

Defined cases: null and empty texts are equal; texts of any length are compared whole; equal texts tie towards the smallest ``doc_id``; a null ``doc_id`` loses
against any other, and a text that only such rows have is kept by them; rows repeated with one ``doc_id`` are kept or dropped together; an empty table gives an
empty result; columns other than ``doc_id`` and ``text`` are not read by ``exact_dedup`` and pass through ``keep_first`` whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, shuffle_width, stored

SPILL_BYTES = 24 << 20
_SPACES = re.compile(rb" {2,}")
_TO_SPACE = bytes(32 if 9 <= i <= 13 else i for i in range(256))
_KEY = "n_bytes long, hash long, text_sha256 string"
_OWNERS = f"{_KEY}, owner long, rows long"
#: A row of a document has no body and no rows; a row of a terminal has both.
_BOTH = f"doc_id long, {_OWNERS}, body binary"


def normalise(text: str | None) -> bytes:
    """UTF-8 with every run of bytes 0x20, 0x09-0x0D made one space; empty for null."""
    if not text:
        return b""
    raw = text.encode("utf-8", "surrogatepass").translate(_TO_SPACE)
    return _SPACES.sub(b" ", raw) if b"  " in raw else raw


class Node:
    """A radix-trie node: the label on its incoming edge, children by first byte, and the owner if terminal."""

    __slots__ = ("label", "children", "owner", "rows")

    def __init__(self, label: bytes, owner: int | None = None, rows: int = 0):
        self.label, self.children, self.owner, self.rows = label, {}, owner, rows

    def size(self) -> int:
        """Label bytes of this node and all below."""
        total, stack = 0, [self]
        while stack:
            node = stack.pop()
            total += len(node.label)
            stack += node.children.values()
        return total


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    if a == b[: len(a)]:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


Terminal = tuple[bytes, int | None, int]


class Patricia:
    """A compressed trie of full byte strings; each terminal has the smallest identifier and the row count."""

    def __init__(self):
        self.root = Node(b"")
        self.size = 0

    def insert(self, key: bytes, owner: int | None, rows: int = 1) -> None:
        node, rest = self.root, key
        while rest:
            child = node.children.get(rest[0])
            if child is None:
                node.children[rest[0]] = Node(rest, owner, rows)
                self.size += len(rest)
                return
            n = _shared(child.label, rest)
            if n < len(child.label):
                stem = Node(child.label[:n])
                child.label = child.label[n:]
                stem.children[child.label[0]] = child
                node.children[rest[0]] = stem
                child = stem
            node, rest = child, rest[n:]
        node.owner = _smaller(node.owner, owner) if node.rows else owner
        node.rows += rows

    def terminals(self) -> Iterator[Terminal]:
        yield from _below(self.root, b"")

    def spill(self, first: int) -> list[Terminal]:
        """Takes the subtree of the root's child ``first`` out of the trie and returns its terminals."""
        child = self.root.children.pop(first)
        self.size -= child.size()
        return list(_below(child, b""))

    def spill_before(self, last: bytes) -> list[Terminal]:
        """Takes out all but the path of ``last``, the greatest key so far: whatever branches off it is complete."""
        out, node, path, rest = [], self.root, b"", last
        while True:
            if node.rows and rest:
                out.append((path, node.owner, node.rows))
                node.owner, node.rows = None, 0
            on_path = rest[0] if rest else None
            for first in [c for c in node.children if c != on_path]:
                child = node.children.pop(first)
                self.size -= child.size()
                out += _below(child, path)
            if on_path is None:
                return out
            node = node.children[on_path]
            path, rest = path + node.label, rest[len(node.label) :]


def _below(node: Node, path: bytes) -> Iterator[Terminal]:
    stack = [(node, path)]
    while stack:
        node, path = stack.pop()
        path += node.label
        if node.rows:
            yield path, node.owner, node.rows
        stack += [(child, path) for child in node.children.values()]


def key_of(body: bytes) -> tuple[int, int, str]:
    """Length, content hash and full digest."""
    return len(body), xxhash.xxh3_64_intdigest(body) - (1 << 63), hashlib.sha256(body).hexdigest()


class LocalTries:
    """The tries of a map task, one per partition of (length, hash)."""

    def __init__(self, parts: int, most: int):
        self.parts, self.most, self.held = parts, most, 0
        self.tries: dict[int, Patricia] = {}

    def insert(self, key: tuple[int, int, str], body: bytes, owner: int | None) -> None:
        trie = self.tries.setdefault((key[0] * 31 + key[1]) % self.parts, Patricia())
        was = trie.size
        trie.insert(body, owner)
        self.held += trie.size - was

    def spill(self) -> list[Terminal]:
        """The terminals of the largest subtrees, taken out until half of the allowed bytes are left; nothing below the limit."""
        if self.held <= self.most:
            return []
        found = sorted(((child.size(), part, first) for part, trie in self.tries.items() for first, child in trie.root.children.items()), reverse=True)
        out: list[Terminal] = []
        for size, part, first in found:
            if self.held <= self.most // 2:
                break
            out += self.tries[part].spill(first)
            self.held -= size
        return out

    def rest(self) -> Iterator[Terminal]:
        for trie in self.tries.values():
            yield from trie.terminals()


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _batches(terminals: Iterator[Terminal], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Terminals as rows, about ``most`` bytes of bodies a batch."""
    rows, held = [], 0
    for body, owner, count in terminals:
        rows.append((None, *key_of(body), owner, count, body))
        held += len(body)
        if held > most:
            yield _columns(rows, schema)
            rows, held = [], 0
    if rows:
        yield _columns(rows, schema)


def _map_side(docs: DataFrame, keys: bool = True) -> DataFrame:
    """Partial owners of the distinct texts of ``docs(doc_id, text)`` and, with ``keys``, a key per row, from one reading."""
    schema, parts, most = arrow_schema(docs.sparkSession, _BOTH), shuffle_width(docs.sparkSession), SPILL_BYTES

    def run(batches):
        tries = LocalTries(parts, most)
        for batch in batches:
            own = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = normalise(text.as_py())
                key = key_of(body)
                if keys:
                    own.append((doc_id, *key, None, None, None))
                tries.insert(key, body, doc_id)
                yield from _batches(iter(tries.spill()), schema)
            if keys:
                yield _columns(own, schema)
        yield from _batches(tries.rest(), schema)

    return docs.select("doc_id", "text").mapInArrow(run, _BOTH)


def _merged(terminals: DataFrame) -> DataFrame:
    """``n_bytes, hash, text_sha256, owner, rows`` of each distinct text, from partial owners."""
    schema, most = arrow_schema(terminals.sparkSession, _OWNERS), SPILL_BYTES

    def rows(found: list[Terminal]) -> pa.RecordBatch:
        return _columns([(*key_of(body), owner, count) for body, owner, count in found], schema)

    def run(batches):
        trie, last = Patricia(), b""
        for batch in batches:
            for owner, count, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                trie.insert(body, owner, count)
                last = body
                if trie.size - len(last) > most:
                    yield rows(trie.spill_before(last))
        yield rows(list(trie.terminals()))

    dealt = terminals.select("owner", "rows", "body", "n_bytes", "hash").repartition("n_bytes", "hash").sortWithinPartitions("body")
    return dealt.select("owner", "rows", "body").mapInArrow(run, _OWNERS)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    both = stored(_map_side(docs))
    owners = _merged(both.where("rows IS NOT NULL")).withColumnsRenamed({"owner": "keep_id", "rows": "group_size"})
    own = both.where("rows IS NULL").select("doc_id", "n_bytes", "hash", "text_sha256")
    return own.join(owners, ["n_bytes", "hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose normalised text no smaller ``doc_id`` has, all columns kept.

    The owners are the rows that stay, so no document is met by its key and nothing is written on the way."""
    kept = _merged(_map_side(docs, keys=False)).select(F.col("owner").alias("_keep")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_keep"]), "left_semi")
