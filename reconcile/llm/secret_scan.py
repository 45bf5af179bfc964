"""Secret scans: known forms, and stretches of high entropy found by a sliding window."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

#: The forms whose spans are always reported.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

WINDOW = 20
#: Per class: its kind, its runs, and the bits a character that a window must reach.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9A-Fa-f]{%d,}" % WINDOW), 3.0),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW), 3.9),
)
#: Candidates that are random or long by design, and no secrets.
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|sha(?:1|256|384|512)[-:][A-Za-z0-9+/=]+"  # checksums that name themselves
    r"|ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789(?:\+/|-_)=?",  # the letters of base64
    re.IGNORECASE,
)
#: What marks leave of a candidate (a plus sign belongs to no word), and the pieces that make no secret: words in
#: lower case or capitalised, and what is made up by a fifth or more.
PIECE, PLAIN = re.compile(r"[A-Za-z0-9]+|\+"), re.compile(r"[A-Za-z][a-z]*")
MADE_UP = re.compile(r"example|sample|placeholder|abcdefghij|0123456789|x{8,}", re.IGNORECASE)
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_CLOG = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]


def high_entropy(run: str, least: float, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Unions of overlapping windows of run with at least ``least`` bits a character and two of the
    kinds lower case, upper case, digit (of hexadecimal runs: a letter and a digit)."""
    counts: dict[str, int] = {}
    kinds = [0, 0, 0]
    weighted, begin, end = 0.0, None, 0

    def kind(c: str) -> int | None:
        return 2 if c.isdigit() else 1 if c.isupper() else 0 if c.islower() else None

    for i, c in enumerate(run):
        n = counts.get(c, 0)
        weighted += _CLOG[n + 1] - _CLOG[n]
        counts[c] = n + 1
        if (k := kind(c)) is not None:
            kinds[k] += 1
        if i >= window:
            gone = run[i - window]
            n = counts[gone]
            weighted -= _CLOG[n] - _CLOG[n - 1]
            counts[gone] = n - 1
            if (k := kind(gone)) is not None:
                kinds[k] -= 1
        if i >= window - 1 and log2(window) - weighted / window >= least - 1e-9 and sum(map(bool, kinds)) >= 2:
            start = i - window + 1
            if begin is not None and start > end:
                yield begin, end
                begin = None
            begin = start if begin is None else begin
            end = i + 1
    if begin is not None:
        yield begin, end


def suspicious(string: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the pieces of string that are neither words nor made up."""
    found = [
        m.span() for m in PIECE.finditer(string)
        if not PLAIN.fullmatch(m[0]) and 5 * sum(map(len, MADE_UP.findall(m[0]))) < len(m[0])
    ]
    return [start for start, _ in found], [end for _, end in found]


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place in KINDS, end) of every span in text, ordered; offsets are code points."""
    spans = []
    lowered = text.lower()
    if "passw" in lowered or "secret" in lowered or "token" in lowered or "api" in lowered:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for candidate in CLASSES[1][1].finditer(text):
        string = candidate[0]
        if PLAIN.fullmatch(string) or ALLOWED.fullmatch(string):
            continue  # a long word, or allowed
        starts, ends = suspicious(string)
        for place, (_, runs, least) in enumerate(CLASSES):
            for run in runs.finditer(string):
                at = candidate.start() + run.start()
                for b, e in high_entropy(run[0], least):
                    first = bisect_right(ends, run.start() + b)
                    if first < len(starts) and starts[first] < run.start() + e:
                        spans.append((at + b, 3 + place, at + e))
    return sorted(spans)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            spans = find_secrets(text.as_py() or "")
            base = [s for s in spans if s[1] < 3]
            counts = [sum(s[1] == k for s in base) for k in range(3)]
            rows.append([*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)])
        columns = list(zip(*rows)) or [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of secrets in every row of docs (doc_id, text); see ``SCHEMA``.

    Spans are ``kind:start:end``, by start and then kind, comma-joined: all in
    ``spans``, those of the known forms in the digest. An assignment's span is
    the whole match; only its value must be long enough. A span of high entropy is
    left out only if all pieces between marks that it meets are words or made up, or its
    whole candidate is ``ALLOWED``. A null text is an empty
    one and has no spans; repeated rows are scanned each, other columns ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)
