"""Media columns: texts stored losslessly as TIFF files, and TIFF files read into one row per page.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are grey samples in rows of 64. The last eight
rows are an LZW strip, the first eight of the others a PackBits strip, those between are deflated tiles with horizontal
differencing, each a page of its own (fewer rows have fewer pages).

Defined cases: null and empty texts are one row of zeros; texts of any length are stored whole; equal texts give equal files; repeated rows give equal
rows; rows with a null ``doc_id`` keep it; a null or damaged file gives one page row with ``error`` set in ``page_rows``; an empty table gives an empty
result; columns other than ``doc_id`` and ``text`` (``id`` and ``media``) are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from . import tiff
from .common import arrow_schema, batch_map

ROW, SIDE, STRIP = 64, 64, 8


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (ROW - len(raw) % ROW if len(raw) % ROW or not raw else 0)


def to_tiff(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    rest, last = rows[:-STRIP], rows[-STRIP:]
    pages = [(rest[:STRIP], tiff.PACKBITS, 1, 0)] if len(rest) else []
    pages += [(rest[STRIP:], tiff.DEFLATE, 2, SIDE)] if len(rest) > STRIP else []
    return tiff.write([*pages, (last, tiff.LZW, 1, 0)])


def feature(pages: list[tiff.Page]) -> str:
    """Page shapes, mean, deviation and the four most frequent samples of all pages."""
    samples = np.concatenate([p.pixels.ravel() for p in pages])
    counts = np.bincount(samples, minlength=256)
    n = int(counts.sum())
    total = int((counts * np.arange(256)).sum())
    square = int((counts * np.arange(256) ** 2).sum())
    top = sorted(range(256), key=lambda v: (-int(counts[v]), v))[:4]
    shapes = "+".join(f"{p.width}x{p.height}" for p in pages)
    return f"pages={shapes};mean={total / n:.4f};var={square / n - (total / n) ** 2:.4f};top={','.join(map(str, top))}"


def _digest(columns) -> dict:
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages")
    out: dict[str, list] = {n: [] for n in names}
    for doc_id, text in zip(columns[0].to_pylist(), columns[1], strict=True):
        n_bytes, payload = payload_of(text.as_py())
        media = to_tiff(payload)
        pages = tiff.read(media)
        back = b"".join(p.pixels.tobytes() for p in pages)
        row = (doc_id, n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(pages), len(pages))
        for name, value in zip(names, row, strict=True):
            out[name].append(value)
    return out


def digests(docs: DataFrame) -> DataFrame:
    """Each text of ``docs(doc_id, text)`` stored as TIFF, read back, and described."""
    return batch_map(docs.select("doc_id", "text"), _digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int")


def _encode(columns) -> dict:
    return {"doc_id": columns[0], "media": [to_tiff(payload_of(t.as_py())[1]) for t in columns[1]]}


def encode(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: the TIFF file of each text."""
    return batch_map(docs.select("doc_id", "text"), _encode, "doc_id long, media binary")


def page_rows(files: DataFrame) -> DataFrame:
    """One row per page of ``files(id, media)``: its shape, scheme and samples; ``error`` instead for a damaged file."""
    ddl = "id long, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"
    schema = arrow_schema(files.sparkSession, ddl)
    names = [f.name for f in schema]

    def run(columns) -> dict:
        out: dict[str, list] = {n: [] for n in names}
        for id_, media in zip(columns[0].to_pylist(), columns[1], strict=True):
            try:
                rows = [(id_, k, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None) for k, p in enumerate(tiff.read(media.as_py() or b""))]
            except ValueError as e:
                rows = [(id_, *[None] * 9, str(e))]
            for row in rows:
                for name, value in zip(names, row, strict=True):
                    out[name].append(value)
        return out

    return batch_map(files.select("id", "media"), run, ddl)
