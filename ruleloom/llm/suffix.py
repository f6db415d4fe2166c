"""Repeated passages: every byte covered by a 200-byte string that also starts somewhere else goes.

A corpus-wide suffix array would sort every byte, so only suffixes that can tie for long enough are sorted.
Each 200-byte string has one anchor, the leftmost of its 32-byte grams with the least hash; strings that are equal have equal anchors at
the same offset. Runs of strings with one anchor form a context, at most 368 bytes. Contexts whose anchor occurs nowhere else
hold no repeated string. Of the others, contexts that are equal as a whole are counted together, first within a document, then before they
are sent on (so a passage held by a third of all documents stays one row), and distinct contexts of one anchor
are a suffix bucket.

Buckets are sorted by a blockwise difference-cover construction, some buckets at a time: the suffixes that start at the anchors, at their
places in the text of the bucket's contexts, and those of the mirrored text, which read leftwards. Ranks of the cover's nine residues modulo 73 are
computed first by doubling; suffixes that tie over 73 bytes are ordered by the ranks of two sample positions at the same distance from both. Prefix
lengths shared by neighbours in the two orders tell for every offset which strings are equal.

A bucket of more than ``SPLIT`` distinct contexts is cut into blocks before it is sorted: strings that start ``low`` to ``high`` bytes before the anchor
share the bytes from ``low`` before it to ``200 - high`` behind its start, so for every such range the contexts part by those bytes. Blocks are sorted
like buckets. Strings of a block that is still larger have 188 of 200 bytes in common and are grouped by the other 12. Memory is thus bounded by two such
buckets in any task.

Defined cases: null and short texts keep all bytes; a very long text is read in parts of a million string starts; rows repeated with equal ``doc_id`` and text
repeat one another, so they are removed like other copies; rows with a null ``doc_id`` are documents like others and keep it; a string may repeat inside its own
document, overlapping itself; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_map, stored

WINDOW, GRAM = 200, 32
#: A perfect difference set: every residue modulo PERIOD is a difference of two members (fixed values).
PERIOD, COVER = 73, (0, 1, 3, 7, 15, 31, 36, 54, 63)
BATCH_CONTEXTS, CHUNK_BYTES, PART_STARTS = 4_000, 1 << 18, 1 << 20
#: Distinct contexts of a bucket above which it is split, and the number of string starts a part of it stands for.
SPLIT, RANGE = 20_000, 13


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_BYTES = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_POWERS = [np.uint64(pow(0xD6E8FEB86659FD93, 1 << k, 1 << 64)) for k in range(5)]


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of documents concatenated in ``text``: hash of the anchor, its place, first and last string start."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(text) < WINDOW:
        return none
    h = _BYTES[text]
    for k, power in enumerate(_POWERS):
        step = 1 << k
        h = h[:-step] * power + h[step:]
    h = _mix(h)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, have = WINDOW - GRAM + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(len(place) + 1, np.int32)
    long = ends - starts >= WINDOW
    valid[starts[long]] += 1
    valid[ends[long] - WINDOW + 1] -= 1
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(at):
        return none
    place = place[at]
    first = np.concatenate([[True], place[1:] != place[:-1]])
    last = np.concatenate([first[1:], [True]])
    return h[place[first]].view(np.int64), place[first], at[first], at[last]


_CONTEXTS = "key long, h long, ch long, a int, off short, n short, times int"


def _times(doc: np.ndarray, h: np.ndarray, ch: np.ndarray) -> np.ndarray:
    """How often a document has a context, at the first place it does; 0 at the others."""
    order = np.lexsort((ch, h, doc))
    change = np.zeros(len(order), bool)
    change[:1] = True
    for x in (doc, h, ch):
        change[1:] |= x[order[1:]] != x[order[:-1]]
    first = np.flatnonzero(change)
    times = np.zeros(len(order), np.int64)
    times[order[first]] = np.diff(np.append(first, len(order)))
    return times


def contexts(docs: DataFrame) -> DataFrame:
    """``key, h, ch, a, off, n, times`` per context of ``docs(key, text)``: hashes of anchor and of the whole context, its start, the
    anchor's offset in it, the number of 200-byte strings, and at its first place in the document how often it is there (else 0)."""
    schema = arrow_schema(docs.sparkSession, _CONTEXTS)

    def chunk(keys: list[int], bases: list[int], raws: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(raws)
        ends = np.cumsum([len(r) for r in raws])
        h, place, a, b = anchors(np.frombuffer(whole, np.uint8), ends)
        doc = np.searchsorted(ends, a, side="right")
        digest = xxhash.xxh3_64_intdigest
        view = memoryview(whole)
        ch = np.array([digest(view[s:e]) for s, e in zip(a.tolist(), (b + WINDOW).tolist(), strict=True)], np.uint64).view(np.int64)
        before = np.concatenate([[0], ends[:-1]]) - np.array(bases)
        cols = (np.array(keys, np.int64)[doc], h, ch, a - before[doc], place - a, b - a + 1, _times(doc, h, ch))
        return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches):
        keys, bases, raws, size = [], [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                # a long text is read in parts that hold its string starts once each; a context cut in two is two contexts
                for base in range(0, len(raw) - WINDOW + 1, PART_STARTS):
                    part = raw[base : base + PART_STARTS + WINDOW - 1]
                    keys.append(key)
                    bases.append(base)
                    raws.append(part)
                    size += len(part)
                    if size >= CHUNK_BYTES:
                        yield chunk(keys, bases, raws)
                        keys, bases, raws, size = [], [], [], 0
        if raws:
            yield chunk(keys, bases, raws)

    return docs.select("key", "text").mapInArrow(run, _CONTEXTS)


#: For residues i and j of two positions the least distance at which both positions meet the sample.
_IN_COVER = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
SHIFT = np.array([[np.flatnonzero(_IN_COVER[i : i + PERIOD] & _IN_COVER[j : j + PERIOD])[0] for j in range(PERIOD)] for i in range(PERIOD)])


class CoverSorter:
    """Order of suffixes of ``text`` by their first ``depth`` bytes or more, bucket by bucket.

    Sample positions are those whose residue modulo PERIOD is in COVER, 9 of 73. Their ranks by ``depth`` bytes come from
    ranks by PERIOD bytes, doubled: the position one period further is a sample position too. Any two positions have a distance below
    PERIOD at which both meet the sample, so a tie over PERIOD bytes is settled by two ranks.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.text = np.concatenate([text, np.zeros(depth + 2 * PERIOD + 1, np.uint8)])
        usable = len(self.text) - PERIOD
        sample = np.flatnonzero(np.isin(np.arange(PERIOD), COVER))
        sample = (np.arange(0, usable, PERIOD)[:, None] + sample[None]).ravel()
        self.sample = sample[sample < usable]
        self.rank_at = np.full(len(self.text) + depth + PERIOD, -1, np.int64)
        rank = self._dense(self.blocks(self.sample))
        self.rank_at[self.sample] = rank
        have = PERIOD
        while have < depth:
            rank = self._dense(rank * (len(rank) + 2) + self.rank_at[self.sample + have] + 1)
            self.rank_at[self.sample] = rank
            have *= 2

    @staticmethod
    def _dense(keys: np.ndarray) -> np.ndarray:
        return np.unique(keys, return_inverse=True)[1].astype(np.int64)

    def blocks(self, positions: np.ndarray) -> np.ndarray:
        """The first PERIOD bytes at each position, as values that sort like the bytes."""
        view = np.lib.stride_tricks.sliding_window_view(self.text, PERIOD)
        return np.ascontiguousarray(view[positions]).view(f"S{PERIOD}").ravel()

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the suffixes at ``i`` come after those at ``j``, for pairs that tie over PERIOD bytes: two sample ranks each."""
        d = SHIFT[i % PERIOD, j % PERIOD]
        return self.rank_at[i + d] > self.rank_at[j + d]

    def order(self, positions: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Indices that sort ``positions`` by bucket, then by suffix."""
        prefix = self._dense(self.blocks(positions))
        order = np.lexsort((prefix, bucket))
        change = np.ones(len(order), bool)
        change[1:] = (bucket[order[1:]] != bucket[order[:-1]]) | (prefix[order[1:]] != prefix[order[:-1]])
        tied = ~change
        tied[:-1] |= ~change[1:]
        places = np.flatnonzero(tied)
        order[places] = self._settled(order[places], np.cumsum(change)[places], positions)
        return order

    def _settled(self, order: np.ndarray, group: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """``order`` with each run of one ``group`` sorted by sample ranks: Batcher's merge network, a numpy comparison of all pairs at a time."""
        size, p = len(order), 1
        while p < size:
            k = p
            while k:
                low = np.arange(k % p, size - k)
                low = low[((low - k % p) // k % 2 == 0) & (low // (2 * p) == (low + k) // (2 * p))]
                low = low[group[low] == group[low + k]]
                low = low[self.after(positions[order[low]], positions[order[low + k]])]
                order[low], order[low + k] = order[low + k], order[low]
                k //= 2
            p *= 2
        return order


def _side(text: np.ndarray, positions: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``positions`` by bucket and bytes, and the prefix up to ``depth`` each shares with the one before (-1 across buckets)."""
    sorter = CoverSorter(text, depth)
    order = sorter.order(positions, bucket)
    view = np.lib.stride_tricks.sliding_window_view(sorter.text, depth)
    shared = np.full(len(order), -1)
    for start in range(1, len(order), 4096):
        a, b = order[start : start + 4096], order[start - 1 : start + 4095][: len(order[start : start + 4096])]
        differ = view[positions[a]] != view[positions[b]]
        own = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
        shared[start : start + 4096] = np.where(bucket[a] == bucket[b], own, -1)
    return order, shared


def repeated(bucket: np.ndarray, bodies: list[bytes], off: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each context and distance 0..168 of a string's start before the anchor: whether another context of the bucket has the string.

    A context takes part with distances from ``low`` to ``high`` only.
    """
    size, reach = len(bodies), WINDOW - GRAM + 1
    text = np.frombuffer(b"".join(bodies), np.uint8)
    anchor = np.cumsum([0, *map(len, bodies)])[:-1] + off
    by_right, shares_right = _side(text, anchor, bucket, WINDOW)
    # what stands before an anchor, read backwards, is a suffix of the mirrored text
    by_left, shares_left = _side(text[::-1], len(text) - anchor, bucket, reach - 1)
    found = np.zeros((size, reach), bool)
    group_right, group_left = np.empty(size, np.int64), np.empty(size, np.int64)
    for r in range(reach):
        held = np.flatnonzero((off - n < r) & (r <= off) & (low <= r) & (r <= high))
        if len(held) < 2:
            continue
        group_right[by_right] = np.cumsum(shares_right < WINDOW - r)
        group_left[by_left] = np.cumsum(shares_left < r)
        _, back, count = np.unique(group_left[held] * (size + 1) + group_right[held], return_inverse=True, return_counts=True)
        found[held, r] = count[back] > 1
    return found


_REPS = "h long, large boolean, count long, key long, a int, off short, n short, body binary"
_BUCKETED = ("h", "count", "key", "a", "off", "n", "body", "low", "high")
_SPANS = "key long, s int, e int"


def _bodies(joined: DataFrame) -> DataFrame:
    schema = arrow_schema(joined.sparkSession, _REPS)

    def run(batches):
        for batch in batches:
            rows = []
            for key, raw, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = zstandard.ZstdDecompressor().decompress(raw.as_py())
                rows += [{"h": w["h"], "large": w["large"], "count": w["count"], "key": key, "a": w["a"], "off": w["off"], "n": w["n"], "body": text[w["a"] : w["a"] + w["n"] - 1 + WINDOW]} for w in wanted]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return joined.mapInArrow(run, _REPS)


def _sorted_buckets(reps: DataFrame) -> DataFrame:
    """Spans of once-occurring contexts that share a string with another context of their bucket ``h``."""
    schema = arrow_schema(reps.sparkSession, _SPANS)

    def settle(cols: list[list]) -> pa.RecordBatch | None:
        h, count, key, a, off, n, bodies, least, most = cols
        off, n, a, least, most = (np.array(c, np.int64) for c in (off, n, a, least, most))
        found = repeated(np.array(h, np.int64), bodies, off, n, least, most)
        found[np.array(count) > 1] = False
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        if not len(i):
            return None
        start, end = a[i] + off[i] - high + 1, a[i] + off[i] - low + WINDOW
        return pa.RecordBatch.from_arrays([pa.array(np.array(key, np.int64)[i]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], schema=schema)

    def run(batches):
        cols: list[list] = [[] for _ in _BUCKETED]
        for batch in batches:
            new = [c.to_pylist() for c in batch.columns]
            for row in zip(*new, strict=True):
                if len(cols[0]) >= BATCH_CONTEXTS and row[0] != cols[0][-1]:
                    if (out := settle(cols)) is not None:
                        yield out
                    cols = [[] for _ in _BUCKETED]
                for col, value in zip(cols, row, strict=True):
                    col.append(value)
        if cols[0] and (out := settle(cols)) is not None:
            yield out

    return reps.select(*_BUCKETED).repartition("h").sortWithinPartitions("h").mapInArrow(run, _SPANS)


def _unsettled(rows: DataFrame, *names: str) -> DataFrame:
    """The values of ``names`` under which several contexts meet, one of them occurring once, and their number ``d``."""
    return rows.groupBy(*names).agg(F.count("*").alias("d"), F.min("count").alias("least")).where("d > 1 AND least = 1").drop("least")


def _split_buckets(reps: DataFrame, split: int) -> tuple[DataFrame, DataFrame]:
    """``(parts, spans)`` of large buckets: parts of at most ``split`` contexts with ``low`` and ``high``, and the spans found in larger parts."""
    reach = WINDOW - GRAM
    ranges = F.explode(F.array(*(F.struct(F.lit(r).alias("low"), F.lit(min(r + RANGE - 1, reach)).alias("high")) for r in range(0, reach + 1, RANGE))))
    rows = reps.select("h", "count", "key", "a", "off", "n", "body", ranges.alias("range")).select("*", "range.low", "range.high").drop("range")
    rows = rows.where("high > off - n AND low <= off")  # some string starts in the range, so the context holds the common bytes
    rows = rows.withColumn("part", F.xxhash64("h", "low", F.expr(f"substring(body, off - low + 1, low + {WINDOW} - high)")))
    known = stored(_unsettled(rows, "part"))
    met = rows.join(known, "part")
    strings = met.where(F.col("d") > split).select("*", F.explode(F.expr("sequence(greatest(int(low), off - n + 1), least(int(high), int(off)))")).alias("r"))
    rest = F.concat(F.expr("substring(body, off - r + 1, int(r - low))"), F.expr(f"substring(body, off + {WINDOW} - high + 1, int(high - r))"))
    strings = strings.select("part", "r", rest.alias("rest"), "count", "key", (F.col("a") + F.col("off") - F.col("r")).alias("s"))
    again = stored(_unsettled(strings, "part", "r", "rest").drop("d"))
    spans = strings.where("count = 1").join(again, ["part", "r", "rest"]).select("key", "s", (F.col("s") + WINDOW).alias("e"))
    return met.where(F.col("d") <= split).withColumn("h", F.col("part")).select(*_BUCKETED), spans


def _packed(columns) -> dict:
    compress = zstandard.ZstdCompressor(level=1).compress
    return {"doc_id": columns[0], "key": columns[1], "raw": [compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in columns[2]]}


def _cut(columns, texts: bool) -> dict:
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") + ("kept",) * texts
    out: dict[str, list] = {k: [] for k in names}
    for doc_id, raw, spans in zip(columns[0].to_pylist(), columns[1], columns[2].to_pylist(), strict=True):
        text = zstandard.ZstdDecompressor().decompress(raw.as_py())
        kept, at, removed, runs, until = [], 0, 0, 0, -1
        for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
            if s > until:
                kept.append(text[at:s])
                runs, removed, until, at = runs + 1, removed + e - s, e, e
            elif e > until:
                removed, until, at = removed + e - until, e, e
        kept.append(text[at:])
        left = b"".join(kept)
        for name, value in zip(names, (doc_id, len(text), removed, runs, hashlib.sha256(left).hexdigest(), left), strict=False):
            out[name].append(value)
    return out


def remove_repeats(docs: DataFrame, texts: bool = False, split: int = SPLIT) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, with ``texts`` also the bytes ``kept``.

    Buckets of more than ``split`` distinct contexts are split before they are sorted.
    """
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    every = stored(contexts(keyed))
    # small tables are written first: joins of two scans can be split at a frequent anchor
    first = every.where("times > 0")
    known = stored(first.groupBy("h").agg(F.sum("times").alias("c")).where("c > 1").select("h"))
    shared = stored(first.join(known, "h"))
    distinct = stored(shared.groupBy("h", "ch").agg(F.sum("times").alias("count"), F.min(F.struct("key", "a", "off", "n")).alias("rep")))
    whole = shared.join(distinct.where("count > 1").select("h", "ch"), ["h", "ch"]).select("key", "a", "n").unionByName(every.where("times = 0").select("key", "a", "n"))
    whole = whole.select("key", F.col("a").alias("s"), (F.col("a") + F.col("n") - 1 + WINDOW).alias("e"))
    mixed = stored(_unsettled(distinct, "h").select("h", (F.col("d") > split).alias("large")))
    wanted = distinct.join(mixed, "h").select("h", "large", "count", "rep.*").groupBy("key").agg(F.collect_list(F.struct("h", "large", "count", "a", "off", "n")).alias("wanted"))
    packed = batch_map(keyed.select("doc_id", "key", "text"), _packed, "doc_id long, key long, raw binary")
    reps = _bodies(packed.select("key", "raw").join(wanted, "key"))
    every_start = (F.lit(0).alias("low"), F.lit(WINDOW - GRAM).alias("high"))
    if mixed.where("large").isEmpty():
        small = reps.select(*_BUCKETED[:-2], *every_start)
    else:
        reps = stored(reps)
        parts, more = _split_buckets(reps.where("large"), split)
        small = reps.where("NOT large").select(*_BUCKETED[:-2], *every_start).unionByName(parts)
        whole = whole.unionByName(more)
    spans = whole.unionByName(_sorted_buckets(small)).groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return batch_map(packed.join(spans, "key", "left").select("doc_id", "raw", "spans"), _cut, ddl, texts)
