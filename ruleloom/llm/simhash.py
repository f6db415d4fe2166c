"""SimHash near-duplicates by tiled exact comparison of fingerprints.

``near_dedup``: fingerprints of 64 bits come from XXH64 values (seed 42) of word shingles. Only distinct fingerprints are
compared, so copies cost nothing. Two of them at most three bits apart agree on one of four 16-bit quarters, and
on one of four 12-bit parts of the other 48 bits, so each fingerprint enters 16 buckets keyed by 28 bits, and every
linked pair shares one.

``similar``: for a Jaccard similarity of sets of five-word shingles, 0.8 by default, 64 bits are too coarse. Fingerprints have 512 bits, and
texts link when they differ in no more bits than pairs of that similarity do, two and a half standard deviations allowed. Buckets for so many bits do not exist, so texts
meet where one of 20 bands of four least shingle values is equal, which pairs of that similarity miss once in 30,000 times.

A bucket of more than ``TILE_ROWS`` fingerprints is dealt over the pairs of its tiles: up to ``MOST_TILES`` tiles, more only where a tile would
pass ``LARGEST_TILE`` rows, so rows are sent on a bounded number of times and no task holds more than two tiles of any group. Inside, rows sorted by
population count are compared tile by tile with exclusive-or and bit counts, skipping tile pairs whose counts differ beyond the radius.
A task returns a spanning forest of the links it finds, not the links.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and links like any other;
fewer words than the shingle make one shingle; very long texts are read whole; repeated rows get equal results; a row without a ``doc_id`` links like others and is
never the smallest one, so a component that only such rows have has none; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are not read
by ``near_dedup`` and ``similar`` and pass through ``representatives`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_map, components, stored

RADIUS, TILE, TILE_ROWS, MOST_TILES, LARGEST_TILE = 3, 512, 1 << 14, 16, 1 << 20
#: Words of 64 bits in a wide fingerprint, bands, and least values in a band.
WIDE, BANDS, BAND_ROWS = 8, 20, 4


def _shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 values (seed 42) of all word shingles, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 42)], np.uint64)
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(s, 42) for s in map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def _majority(values: np.ndarray) -> np.ndarray:
    """The bits set in more than half of ``values`` (shingle, word), as words."""
    raw = values.astype(">u8").view(np.uint8).reshape(len(values), -1)
    counts = np.zeros(8 * raw.shape[1], np.int64)
    for start in range(0, len(raw), 16_384):
        counts += np.unpackbits(raw[start : start + 16_384], axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(counts * 2 > len(raw)).view(">u8").astype(np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits over the XXH64 values of all shingles, repeats included."""
    found = _shingles(text, words)
    return int(_majority(found[:, None])[0]) if len(found) else 0


def _fingerprints(columns, words: int) -> dict:
    return {"doc_id": columns[0], "fp": np.array([fingerprint(t.as_py(), words) for t in columns[1]], np.uint64).view(np.int64)}


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of ``docs(doc_id, text)``."""
    return batch_map(docs.select("doc_id", "text"), _fingerprints, "doc_id long, fp long", words)


def buckets(distinct: DataFrame) -> DataFrame:
    """``(table, key, fp, node)``: the 16 buckets of each distinct fingerprint."""
    fp = F.col("fp")

    def bits(shift: int, width: int):
        return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    keys = []
    for quarter in range(4):
        rest = [i for i in range(64) if not 16 * quarter <= i < 16 * quarter + 16]
        for part in range(4):
            own = rest[12 * part : 12 * part + 12]
            if own[-1] - own[0] == 11:
                low = bits(own[0], 12)
            else:  # the part lies on both sides of the quarter
                first = sum(1 for i in own if i < 16 * quarter)
                low = bits(own[0], first).bitwiseOR(F.shiftleft(bits(own[first], 12 - first), first))
            keys.append(F.struct(F.lit(4 * quarter + part).alias("table"), F.shiftleft(bits(16 * quarter, 16), 12).bitwiseOR(low).alias("key")))
    return distinct.select(F.explode(F.array(*keys)).alias("k"), "fp", "node").select("k.table", "k.key", "fp", "node")


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (row, word) differ in at most ``radius`` bits."""
    apart = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
    for k in range(1, a.shape[1]):
        apart += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return apart <= radius


def tile_links(fps: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Forest edges (node, node) over all pairs of ``fps`` (row, word) within ``radius``, tile pair by tile pair."""
    pop = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(pop, kind="stable")
    fps, nodes, pop = fps[order], nodes[order], pop[order]
    label = np.arange(len(fps))  # of two joined labels the smaller stays, followed through ``parent``
    parent = label.tolist()

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def current(at: slice) -> np.ndarray:
        values, back = np.unique(label[at], return_inverse=True)
        label[at] = np.array([find(v) for v in values.tolist()], np.int64)[back]
        return label[at]

    out = []
    for a in range(0, len(fps), TILE):
        left = slice(a, a + TILE)
        for b in range(a, len(fps), TILE):
            if pop[b] - pop[min(a + TILE, len(fps)) - 1] > radius:
                break
            right = slice(b, b + TILE)
            one, two = current(left), current(right)
            if one[0] == one[-1] == two[0] == two[-1] and (one == one[0]).all() and (two == one[0]).all():
                continue
            near = _near(fps[left], fps[right], radius)
            # a link of every row that still joins two labels, until none does
            while (near := near & (one[:, None] != two[None, :])).any():
                rows = np.flatnonzero(near.any(axis=1))
                for i, j in zip(rows.tolist(), near[rows].argmax(axis=1).tolist(), strict=True):
                    x, y = find(a + i), find(b + j)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out.append((int(nodes[a + i]), int(nodes[b + j])))
                one, two = current(left), current(right)
    return out


def tiled_links(rows: DataFrame, key: list[str], fps: list[str], radius: int) -> DataFrame:
    """Edges ``(u, v)`` between ``node`` values of ``rows(key, fps, node)`` that span all links within ``radius`` inside the buckets of ``key``."""
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.greatest(F.ceil(F.col("n") / LARGEST_TILE), F.least(F.lit(MOST_TILES), F.ceil(F.col("n") / TILE_ROWS))).cast("int")
    met = rows.join(sizes.select(*key, tiles.alias("tiles")), key)
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least(j, tile).alias("i"), F.greatest(j, tile).alias("j")))
    names = [*key, "i", "j"]
    dealt = met.select(*key, *fps, "node", F.explode(pairs).alias("p")).select(*key, "p.i", "p.j", *fps, "node")
    schema = arrow_schema(rows.sparkSession, "u long, v long")

    def compare(batches):
        for group in _groups(batches, len(names)):
            if len(group) > 1:
                edges = tile_links(np.ascontiguousarray(group[:, :-1]).view(np.uint64), group[:, -1], radius)
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], schema=schema)

    return dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(compare, "u long, v long")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[np.ndarray]:
    """The other columns of each run of rows with equal first ``n_keys`` columns, a run at a time."""
    held: list[np.ndarray] = []
    last = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        keys, values = np.column_stack(cols[:n_keys]), np.column_stack(cols[n_keys:])
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
            key = tuple(keys[start].tolist()) if start < end else last
            if key != last and held:
                yield np.concatenate(held)
                held = []
            last = key
            held.append(values[start:end])
    if held:
        yield np.concatenate(held)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(u, v)`` between ``node`` values of ``distinct(fp, node)`` that span all links within ``radius``; one of more
    than ``RADIUS`` raises ``ValueError``, as the buckets would miss links."""
    if radius > RADIUS:
        raise ValueError(f"buckets are complete for {RADIUS} differing bits, not for {radius}")
    return tiled_links(buckets(distinct), ["table", "key"], ["fp"], radius)


def _with_components(own: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``own(doc_id, node, ...)`` with ``component_id``, the smallest ``doc_id`` over ``nodes(node, doc_id)`` of a component of ``edges``."""
    rooted = stored(nodes.join(components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc_id"))
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return own.join(rooted.join(first, "root").select("node", "component_id"), "node")


def near_dedup(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (the smallest ``doc_id`` reachable over links)."""
    own = stored(fingerprints(docs, words))
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.col("fp")))
    return _with_components(own.withColumn("node", F.col("fp")), distinct, links(distinct, radius)).select("doc_id", "fp", "component_id")


def wide_radius(least: float) -> int:
    """Bits of a wide fingerprint in which texts of Jaccard similarity ``least`` differ on average, and two and a half standard deviations more."""
    share = math.acos(2 * least / (1 + least)) / math.pi
    return math.floor(64 * WIDE * share + 2.5 * math.sqrt(64 * WIDE * share * (1 - share)))


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    x = values + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_FACTORS = _mixed(np.arange(BANDS * BAND_ROWS, dtype=np.uint64), 1) | np.uint64(1)


def wide_fingerprint(text: str | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Majority bits over ``WIDE`` mixes of each distinct shingle's value, and the keys of the bands of least values."""
    found = np.unique(_shingles(text, words))
    if not len(found):
        found = np.zeros(1, np.uint64)
    bits = _majority(np.column_stack([_mixed(found, 2 + k) for k in range(WIDE)]))
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(found), 4096):
        least = np.minimum(least, (_mixed(found[start : start + 4096], 9)[:, None] * _FACTORS).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = _mixed(keys ^ column, 5)
    return bits, keys


def _wide(columns, words: int) -> dict:
    found = [wide_fingerprint(t.as_py(), words) for t in columns[1]]
    out = {f"f{k}": np.array([bits[k] for bits, _ in found], np.uint64).view(np.int64) for k in range(WIDE)}
    return {"doc_id": columns[0], "keys": [keys.view(np.int64) for _, keys in found]} | out


def similar(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: ``doc_id, component_id`` (the smallest ``doc_id`` reachable over links of texts whose sets of shingles of
    ``words`` words have a Jaccard similarity of about ``least`` or more, as their fingerprints of 512 bits tell it)."""
    fps = [f"f{k}" for k in range(WIDE)]
    ddl = "doc_id long, keys array<long>, " + ", ".join(f"{f} long" for f in fps)
    own = stored(batch_map(docs.select("doc_id", "text"), _wide, ddl, words).withColumn("node", F.xxhash64(*fps, "keys")))
    nodes = stored(own.groupBy("node", *fps, "keys").agg(F.min("doc_id").alias("doc_id")))
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    # most keys are of one text only; fingerprints follow the few that meet another
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = stored(keyed.join(shared, "key").join(nodes.select("node", *fps), "node"))
    return _with_components(own.select("doc_id", "node"), nodes.select("node", "doc_id"), tiled_links(met, ["key"], fps, wide_radius(least))).select("doc_id", "component_id")


def representatives(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that have the smallest ``doc_id`` of their component of ``similar`` texts, all columns kept.

    Rows without a ``doc_id`` stay where any component has only such rows."""
    found = similar(docs, words, least)
    first = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["_keep"]), "left_semi")
