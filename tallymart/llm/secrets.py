"""Secrets in texts: keyword hits first, anchored patterns at the hits, then embedded checksums."""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.words import prefer_small_batches, texts_as_bytes

#: Kinds in their order; the first three are the base, the others carry a checksum.
KINDS = ("assign", "access", "hex", "github", "npm")
#: Patterns and least lengths of the base kinds.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: Tokens that end in six base-62 digits of the CRC-32 of what is between prefix and checksum.
CHECKED = {"github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), "npm": re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")}
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
_DIGITS = (string.digits + string.ascii_uppercase + string.ascii_lowercase).encode()
SCHEMA = "id long, n_assign long, n_access long, n_hex long, base array<struct<kind:string,start:long,end:long>>, found array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def keyword_automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


def base62_crc(payload: bytes) -> bytes:
    value, out = zlib.crc32(payload), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS[digit : digit + 1] + out
    return out


def scan(text: bytes, keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """Byte spans ``(start, rank of kind, end)`` in order.

    Every match of a keyword kind starts at a keyword, and patterns are tried
    at hits from left to right, none inside the last match of its kind: what a
    leftmost non-overlapping search finds. A hex run has no keyword; its
    pattern runs over the text.
    """
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    hits = sorted({(at - length + 1, kind) for at, (kind, length) in keywords.iter(text.lower().decode("latin-1"))})
    free = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            good = m is not None and m.end(2) - m.start(2) >= ASSIGN_LEAST
        elif kind == "access":
            m = ACCESS.match(text, start)
            good = m is not None and m.end() - start >= ACCESS_LEAST
        else:
            m = CHECKED[kind].match(text, start)
            good = m is not None and base62_crc(m.group(1)) == m.group(2)
        if m is not None:
            free[kind] = m.end()
        if good:
            found.append((start, KINDS.index(kind), m.end()))
    return sorted(found)


def in_code_points(text: bytes, found: list[tuple[int, int, int]]) -> list[dict]:
    """Spans by kind name with code-point offsets; the text is decoded up to each span once."""
    if not found:
        return []
    places, at, count = {}, 0, 0
    for place in sorted({p for s, _, e in found for p in (s, e)}):
        count += len(text[at:place].decode("utf-8", "replace"))
        at = place
        places[place] = count
    return [{"kind": KINDS[k], "start": places[s], "end": places[e]} for s, k, e in found]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base, found)``: spans in code points, end exclusive, by start and kind.

    ``base`` holds the first three of KINDS, ``found`` those and the checked
    tokens. A null or empty text has no spans; repeated rows give repeated
    rows; texts are scanned whole, in time linear in their length.
    """
    prefer_small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = keyword_automaton()
        for batch in batches:
            every = [in_code_points(t, scan(t, keywords)) if t else [] for t in texts_as_bytes(batch.column(1))]
            base = [[s for s in spans if s["kind"] in KINDS[:3]] for spans in every]
            counts = [pa.array([sum(s["kind"] == k for s in spans) for spans in base], pa.int64()) for k in KINDS[:3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, _SPANS), pa.array(every, _SPANS)], ["id", "n_assign", "n_access", "n_hex", "base", "found"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
