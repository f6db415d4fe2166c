"""Secret scans: fixed formats, and strings that a primed compressor finds new in a sensitive context.

The fixed formats are assignments of a long value to a telling name, access-key identifiers and long hexadecimal runs.
Further spans come from novelty: a candidate of mixed characters near a sensitive word is compressed
after its surroundings by zstandard primed with a dictionary of identifiers and of the text around it; the
bytes it adds, less those of its surroundings alone, divided by its length, are its novelty. Names, repeated
values and words cost little; keys cost nearly their entropy and are reported.

A candidate is taken whole, whatever its length, together with what follows it after dots (a signed token is one candidate).
What is reported makes the next line sensitive too: lines of the same width, a short last line and lines that are new
themselves are reported with it. The body of an armoured private key is one span.

A span starts at a token's beginning, behind an equals sign where a name and its value are one run. Values of letters only or of
digits only are no candidates: a compressor cannot tell them from words and numbers it has not seen.

Defined cases: null and empty texts have no spans; offsets are code points, ends exclusive; a text of any length is scanned whole, in
time linear in it; novelty spans do not overlap each other (ties go to the earlier start), and those touching a fixed one are left out
unless they continue a span or are a key's body; repeated rows give equal rows; rows with a null ``doc_id`` keep it; an empty table
gives an empty result; columns other than ``doc_id`` and ``text`` are not read by ``scan`` and pass through ``redact`` whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import zstandard
from pyspark.sql import DataFrame

from .common import batch_map

KINDS = ("assign", "access", "hex", "novel")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_ASSIGN = re.compile("(" + "|".join(map(_either, _NAMES)) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_CLASS = bytes(49 if chr(i) in "0123456789abcdef" else 48 for i in range(256))
_NAME_PARTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that make a context sensitive, and how far before a candidate they count.
_SENSITIVE = re.compile(r"(?i)passw|passwd|pwd|secret|token|api.?key|access.?key|private.?key|credential|bearer|authorization|client.?id")
_NEAR = 48
_RUN = "[A-Za-z0-9+/_=-]"
_CANDIDATE = re.compile(rf"{_RUN}{{16,}}(?:(?:\.{_RUN}{{0,15}}+)*\.{_RUN}{{16,}})*")
#: The next line, real or escaped, if it holds nothing but one run, quoted or not.
_NEXT = re.compile(r"""["']?[ \t]*[+,\\]?[ \t]*(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*["']?([A-Za-z0-9+/_.-]++={0,2}+)(?=["']?[ \t]*[+,;)\\]?[ \t]*(?:[\r\n]|\\[rn]|-----END|\Z))""")
_ARMOUR = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
#: From this width on, a line as wide as the one before continues it, and a short line may end it.
_WIDE = 32
#: Bytes a candidate must add per character, and the least it must add.
NOVELTY, LEAST_BYTES = 0.6, 10
#: Identifiers the compressor knows beforehand (fixed values).
IDENTIFIERS = """
access_key access_token api_key apikey app_id application authorization auth_token bearer bucket callback certificate
client_id client_secret config configuration connection_string content-type cookie credential credentials database
default_value description development environment example expires_in export function header hostname identifier
import index insert interface integer localhost login message metadata namespace object parameter passphrase passwd
password path placeholder port private_key production project property protocol provider public_key query refresh_token
region register request resource response return role secret secret_key secret_access_key security select server
service session_id session_token settings signature staging status storage string subscription template tenant
timestamp token token_type update username value variable version webhook your_api_key_here changeme
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 xxxxxxxxxxxxxxxxxxxx
"""


class Novelty:
    """Marginal compressed bytes of a candidate after its surroundings."""

    def __init__(self):
        self.words = " ".join(IDENTIFIERS.split()).encode()

    def added(self, before: str, candidate: str, after: str) -> int:
        around = (before + " " + after).encode("utf-8", "surrogatepass")
        primed = zstandard.ZstdCompressionDict(self.words + b" " + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compress = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False).compress
        return len(compress(around + b" " + candidate.encode())) - len(compress(around))


_NOVELTY = Novelty()


def _mixed(candidate: str) -> bool:
    return any(c.isdigit() for c in candidate) and any(c.isalpha() for c in candidate)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed formats."""
    out = []
    lower = text.lower()
    if any(name in lower for name in _NAME_PARTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"1" * 16 in text.encode("utf-8", "surrogatepass").translate(_HEX_CLASS):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out)


def _bodies(text: str) -> list[tuple[int, int]]:
    """What stands between the two marks of armoured private keys, without the space and quotes around it."""
    out, opened = [], None
    for m in _ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            opened = m.end()
        elif opened is not None:
            body = text[opened : m.start()]
            start = opened + re.match(r"(?:[\s\"',+]|\\[rn])*", body).end()
            end = start + len(text[start : m.start()].rstrip(" \t\r\n\"'+,"))
            if any(map(_mixed, re.findall(_RUN + "{16,}", body))):
                out.append((start, end))
            opened = None
    return out


def _new(text: str, start: int, end: int) -> bool:
    if not _mixed(text[start:end]):
        return False
    added = _NOVELTY.added(text[max(0, start - 256) : start], text[start:end], text[end : end + 256])
    return added >= LEAST_BYTES and added >= NOVELTY * (end - start)


def _continued(text: str, end: int, width: int) -> list[tuple[int, int]]:
    """The lines after ``end`` that go on with a reported run of ``width`` characters ending there."""
    out: list[tuple[int, int]] = []
    while m := _NEXT.match(text, end):
        start, end, line = *m.span(1), m[1]
        if not any(c.isalnum() for c in line):
            break
        last = False
        if not (width >= _WIDE and len(line) == width and (_mixed(line) or line != line.lower() and line != line.upper())):
            if len(line) >= 16 and _new(text, start, end):
                pass
            elif width >= _WIDE and len(line) < width and (line.endswith("=") or len(line) < 16 and (_mixed(line) or re.search("[a-z][A-Z]", line)) or re.match(r"\s*-----END", text[end : end + 80])):
                last = True
            else:
                break
        out.append((start, end))
        width = len(line)
        if last:
            break
    return out


def _value_start(text: str, start: int, end: int, word: int) -> int:
    """Where the value in the run ``start`` to ``end`` begins if a sensitive word ends at ``word``: behind the word's equals sign,
    slash or dot, or at the run's start, never inside a token."""
    if word <= start:
        return start + (text[start] == ".")
    value = text.find("=", word, end - 16)
    if value >= 0:
        return value + 1
    return word + 1 if text[word] in "/." else start


def novel_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of incompressible candidates in a sensitive context that touch no ``taken`` span, and of what continues them or a taken value."""
    words = [m.end() for m in _SENSITIVE.finditer(text)]
    held = sorted((s, e) for s, _, e in taken)
    inside = lambda start, end: any(s <= start and end <= e for s, e in held)
    # fixed values first, so that what continues them is known when candidates are met
    found = _bodies(text)
    for start, kind, end in taken:
        if kind == 0:
            found += _continued(text, end, len(_ASSIGN.match(text, start)[2]))
    out: list[tuple[int, int]] = []
    for span in sorted(found):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    known, at, reach = list(out), 0, 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(known) and known[at][1] <= start:
            at += 1
        if at < len(known) and known[at][0] < end or start < reach:
            continue
        word = bisect_left(words, start - _NEAR)
        if word == len(words) or words[word] > end - 16:
            continue
        start = _value_start(text, start, end, words[word])
        if end - start < 16 or any(s < end and start < e for s, e in held):
            continue
        pieces = [(start + p.start(), start + p.end()) for p in re.finditer(_RUN + "{16,}", text[start:end])]
        if _new(text, start, end) or len(pieces) > 1 and any(_new(text, *p) for p in pieces):
            lines = _continued(text, end, end - start)
            out += [(start, end), *lines]
            reach = lines[-1][1] if lines else end
    return sorted((s, 3, e) for s, e in out if not inside(s, e))


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan(columns) -> dict:
    out: dict[str, list] = {n: [] for n in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")}
    for doc_id, text in zip(columns[0].to_pylist(), columns[1], strict=True):
        text = text.as_py() or ""
        base = base_spans(text)
        extra = novel_spans(text, base) if _SENSITIVE.search(text) else []
        counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
        row = (doc_id, *counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(sorted(base + extra)), len(extra))
        for name, value in zip(out, row, strict=True):
            out[name].append(value)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts and spans of secrets."""
    return batch_map(docs.select("doc_id", "text"), _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redact_text(text: str | None, mark: str = "[secret]") -> str | None:
    """``text`` with every span of a secret replaced by ``mark``; overlapping spans are replaced as one."""
    if not text:
        return text
    base = base_spans(text)
    spans = sorted(base + (novel_spans(text, base) if _SENSITIVE.search(text) else []))
    out, at, until = [], 0, 0
    for start, _, end in spans:
        if start >= until:
            out += [text[at if at > until else until : start], mark]
        until = max(until, end)
    return "".join(out) + text[until:] if spans else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced, every other column as it was."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            clean = pa.array([redact_text(t.as_py()) for t in batch.column(place)], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([clean if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, StructType([f for f in docs.schema.fields]))
