"""Secret scans: known forms, and candidates whose characters are too evenly mixed to be words.

Known forms (``assign``, ``access``, ``hex``) are found by pattern. Beyond them, each maximal run of token
characters of at least ``WINDOW`` characters is a candidate, or, where spans of known forms overlap it, each part
of it outside them. A candidate and each stretch of letters and digits in it has a character class (hex digits,
letters of one case and digits, letters and digits, base-64), and a window of ``WINDOW`` characters slides over it. The window's Shannon entropy is kept
up to date by the counts of the one character that enters and the one that leaves, so a candidate costs time in
proportion to its length. The stretch covered by windows above the class's threshold is a span of the kind
``entropy``, unless the allow-list suppresses it; stretches that overlap are one span.

Positions are code points, ends exclusive. A null text counts as empty and an empty text has no spans. Repeated
rows give equal rows; a window with exactly the threshold's bits does not count. Texts of any length are scanned whole.
Other columns, whatever their names, are passed through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text, table

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits per character above which a window counts, by the class of its candidate.
HEX_BITS, ALNUM_BITS, BASE64_BITS = 3.0, 3.9, 4.0
#: The same for candidates of one case with digits, and for those with both cases and digits: about one window in a
#: hundred of evenly drawn characters (36 or 32, 62 or 64 of them) has fewer bits.
SINGLE_BITS, MIXED_BITS = 3.35, 3.64
#: Candidates that these match as a whole are no secrets: identifiers, paths, numbers, words with joints, samples.
ALLOWED = (
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"[0-9._=+/-]+",
    r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[_/+=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[_/+=-]*",
    r".*(?:EXAMPLE|example|sample|placeholder|xxxx|XXXX).*",
)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a shorter run is dropped; runs are maximal, so this finds the same ones
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
_HEX_ONLY = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)").fullmatch
_SINGLE_ONLY = re.compile(r"(?=.*[0-9])(?:[a-z0-9]+|[A-Z0-9]+)").fullmatch
_ALNUM_ONLY = re.compile(r"[A-Za-z0-9]+").fullmatch
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])").match
_PIECE = re.compile(rf"[A-Za-z0-9]{{{WINDOW},}}")
#: A pattern for ``assign`` can match only where one of these letters' groups and a sign stand.
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)

Span = tuple[str, int, int]


def known_spans(text: str) -> list[Span]:
    """Spans of the known forms, per kind leftmost and without overlap; matches that are too short are dropped."""
    found: list[Span] = []
    if _KEYWORD.search(text):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


#: c log2 c of every count a window can have, as whole numbers: sums depend on the window alone, not on what was before.
_SCALE = 1 << 32
_TERM = [0] + [round(c * math.log2(c) * _SCALE) for c in range(1, WINDOW + 1)]


def entropy_stretch(run: str, bits: float) -> tuple[int, int] | None:
    """Start and end of what the windows above ``bits`` cover, from the first to the last; None without any."""
    counts: dict[str, int] = {}
    limit = math.floor(WINDOW * (math.log2(WINDOW) - bits) * _SCALE)
    total = 0  # the sum of c log c over the window: the entropy is log WINDOW less a WINDOW-th of it
    first = last = -1
    for at, c in enumerate(run):
        if at >= WINDOW:
            gone = run[at - WINDOW]
            n = counts[gone]
            counts[gone] = n - 1
            total += _TERM[n - 1] - _TERM[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        if at >= WINDOW - 1 and total < limit:
            first = at - WINDOW + 1 if first < 0 else first
            last = at + 1
    return None if first < 0 else (first, last)


def class_bits(run: str) -> float:
    """The threshold of a candidate's class."""
    if _HEX_ONLY(run):
        return HEX_BITS
    if _SINGLE_ONLY(run):
        return SINGLE_BITS
    if _MIXED(run):
        return MIXED_BITS
    return ALNUM_BITS if _ALNUM_ONLY(run) else BASE64_BITS


def make_scanner(allowed: Iterable[str] = ALLOWED) -> Callable[[str], list[Span]]:
    """A function from a text to all its spans, ordered by start, then kind."""
    suppress = [re.compile(a).fullmatch for a in allowed]

    def stretches(run: str, start: int) -> list[tuple[int, int]]:
        """What is too evenly mixed in a candidate and in its pieces, without overlap."""
        if any(f(run) for f in suppress):
            return []
        pieces = [(m.group(), m.start()) for m in _PIECE.finditer(run) if m.group() != run]
        found = [(at + x[0], at + x[1]) for part, at in [(run, 0), *pieces] if (part == run or not any(f(part) for f in suppress)) and (x := entropy_stretch(part, class_bits(part)))]
        out: list[tuple[int, int]] = []
        for s, e in sorted(found):
            if out and s < out[-1][1]:
                out[-1] = out[-1][0], max(e, out[-1][1])
            else:
                out.append((s, e))
        return [(start + s, start + e) for s, e in out]

    def scan(text: str) -> list[Span]:
        spans = known_spans(text)
        taken, at = sorted((s, e) for _, s, e in spans), 0
        for m in _RUN.finditer(text):
            # what ends before this run is passed; what remains may overlap
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            here, k = m.start(), at
            while k < len(taken) and taken[k][0] < m.end():
                s, e = taken[k]
                if s - here >= WINDOW:
                    spans += [("entropy", *x) for x in stretches(text[here:s], here)]
                here, k = max(here, e), k + 1
            if m.end() - here >= WINDOW:
                spans += [("entropy", *x) for x in stretches(text[here : m.end()], here)]
        return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))

    return scan


def find_secrets(df: DataFrame, keep: list[str], text: str = "text", allowed: Iterable[str] = ALLOWED) -> DataFrame:
    """The columns ``keep`` and ``secrets``: an array of (kind, start, end) for every row."""
    allowed = tuple(allowed)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        scan = make_scanner(allowed)
        return lambda t: ([{"kind": k, "start": s, "end": e} for k, s, e in scan(t or "")],)

    return map_text(df, keep, text, [pa.field("secrets", kind)], make)


def secret_digests(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Counts of the known forms and digests of the spans that the scanner finds."""

    def make():
        scan = make_scanner()
        joined = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

        def one(t: str | None) -> tuple:
            spans = scan(t or "")
            base = [x for x in spans if x[0] != "entropy"]
            return *[sum(x[0] == k for x in base) for k in KINDS[:3]], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

        return one

    fields = [pa.field(f"n_{k}", pa.int64()) for k in KINDS[:3]] + [pa.field("base_sha256", pa.string()), pa.field("spans", pa.string())]
    return map_text(df, keep, text, fields, make)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
