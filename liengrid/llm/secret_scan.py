"""Secrets in whole texts: patterns, and sliding-window entropy over candidate strings.

A candidate is a long run of characters that keys are written in. A window moves over it; counts of
its characters are kept as it moves, and with them the sum of c * log2(c), which gives the Shannon
entropy. What counts as high depends on the class of the window's characters.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import partial
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from liengrid.llm import texts

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
# Least bits per character of a window of each class; a window of 20 can have 4.32.
THRESHOLDS = {"hex": 3.0, "alphanumeric": 3.7, "symbols": 3.9}
# Strings that look random and are not secret: web addresses, mail addresses, paths, file names, UUIDs.
ALLOWED = (
    r"https?:/*\S*|www\.\S*",
    r"(?:/[A-Za-z0-9_.-]+){3,}/?",
    r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]+\.(?:com|org|net|html?|php|png|jpe?g|gif|pdf|js|css)\b\S*",
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"(?i:example|sample|placeholder|changeme)\S*",
)

_KEYWORDS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % WINDOW)
_BLANK = re.compile(r"[ \n]")

_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True
_CANDIDATE_BYTES = np.zeros(256, bool)
_CANDIDATE_BYTES[[b for b in range(128) if re.match(r"[A-Za-z0-9+/_.=-]", chr(b))]] = True

Span = tuple[int, int, int]


def _may_assign(text: str) -> bool:
    lowered = text.lower()
    return any(word in lowered for word in _KEYWORDS)


def pattern_spans(text: str) -> list[Span]:
    """(start, kind number, end) of the patterned secrets, leftmost and not overlapping within a kind."""
    found: list[Span] = []
    if _may_assign(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    # A run of fewer characters would be dropped, so runs of 16 and more are looked for at once.
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def _class_of(letters: int, digits: int, others: int, hexes: int, size: int) -> str | None:
    """The class of a window; words without digits and numbers without letters are none."""
    if not letters or not digits:
        return None
    if hexes == size:
        return "hex"
    return "symbols" if others else "alphanumeric"


def entropy_windows(run: str, window: int, thresholds: dict[str, float]) -> list[tuple[int, int]]:
    """Stretches of a run that are covered by windows of high entropy."""
    counts: dict[str, int] = {}
    weights = [0.0, *[n * math.log2(n) for n in range(1, window + 2)]]
    weight = 0.0  # sum of c * log2(c)
    letters = digits = others = hexes = 0
    stretches: list[tuple[int, int]] = []
    for at, character in enumerate(run):
        for c, step in ((character, 1), (run[at - window] if at >= window else "", -1)):
            if not c:
                continue
            before = counts.get(c, 0)
            counts[c] = before + step
            weight += weights[before + step] - weights[before]
            letters += step * c.isalpha()
            digits += step * c.isdigit()
            others += step * (not c.isalnum())
            hexes += step * (c in "0123456789abcdefABCDEF")
        if at >= window - 1:
            kind = _class_of(letters, digits, others, hexes, window)
            if kind and math.log2(window) - weight / window >= thresholds[kind]:
                start, end = at - window + 1, at + 1
                if stretches and start <= stretches[-1][1]:
                    stretches[-1] = (stretches[-1][0], end)
                else:
                    stretches.append((start, end))
    return stretches


def entropy_spans(
    text: str, base: Sequence[Span], window: int, thresholds: dict[str, float], allowed: re.Pattern
) -> list[Span]:
    """High-entropy spans that no base span holds and no allowed string covers.

    Allowed strings hold no blank or line break, so they are looked for once in each word (of what is between
    those) with a high-entropy span, and a text is read in time in proportion to its length.
    """
    found: list[Span] = []
    base_starts = [start for start, _, _ in base]
    base_reach = list(accumulate((end for _, _, end in base), max))
    word_end = 0
    harmless: list[tuple[int, int]] = []
    for match in _CANDIDATE.finditer(text):
        run = match[0]
        if not any(c.isdigit() for c in run):
            continue
        stretches = entropy_windows(run, window, thresholds)
        if not stretches:
            continue
        if match.start() >= word_end:
            word_start = max(text.rfind(blank, word_end, match.start()) for blank in " \n") + 1
            blank = _BLANK.search(text, match.end())
            word_start, word_end = max(word_start, word_end), blank.start() if blank else len(text)
            harmless = [m.span() for m in allowed.finditer(text, word_start, word_end)]
        # At most one allowed string goes on into the run from before it; others are looked for in the run alone.
        before = bisect_left(harmless, (match.start(),))
        mine = harmless[max(before - 1, 0) : before]
        inside = max([match.start(), *[end for _, end in mine]])
        mine += [m.span() for m in allowed.finditer(text, inside, match.end())] if inside < match.end() else []
        for a, b in ((match.start() + a, match.start() + b) for a, b in stretches):
            before = bisect_right(base_starts, a)
            held = before and base_reach[before - 1] >= b
            last = bisect_left(mine, (b,))
            if not held and not (last and mine[last - 1][1] > a):
                found.append((a, 3, b))
    return found


def _join(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _suspects(data: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Texts that hold a run long enough for the hex pattern or for a window."""
    suspect = np.zeros(len(offsets) - 1, bool)
    for table, least in ((_HEX_BYTES, 16), (_CANDIDATE_BYTES, window)):
        runs = texts.words(data, offsets, table)
        long = np.flatnonzero(runs.ends - runs.starts >= least)
        suspect[np.searchsorted(offsets, runs.starts[long], "right") - 1] = True
    return suspect


def _scan_rows(
    batches: Iterator[pa.RecordBatch], window: int, thresholds: dict[str, float], allowed: Sequence[str]
) -> Iterator[pa.RecordBatch]:
    allow = re.compile("|".join(f"(?:{a})" for a in allowed) if allowed else r"(?!)")
    nothing = sha256(b"").hexdigest()
    for batch in batches:
        for first, last, data, offsets in texts.text_slices(batch.column("text")):
            suspect = _suspects(data, offsets, window)
            rows = []
            for text, looked_at in zip(batch.column("text").slice(first, last - first).to_pylist(), suspect.tolist()):
                text = text or ""
                if not looked_at and "AKIA" not in text and not _may_assign(text):
                    rows.append((0, 0, 0, nothing, ""))
                    continue
                base = pattern_spans(text)
                kinds = [kind for _, kind, _ in base]
                spans = [*base, *entropy_spans(text, base, window, thresholds, allow)]
                digest = sha256(_join(base).encode()).hexdigest()
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), digest, _join(spans)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, last - first),
                    *[pa.array(c, pa.int64()) for c in columns[:3]],
                    *[pa.array(c, pa.string()) for c in columns[3:]],
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def find_secrets(
    documents: DataFrame,
    window: int = WINDOW,
    thresholds: dict[str, float] | None = None,
    allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """Secrets of each row of (doc_id, text): counts and spans kind:start:end in code points, end exclusive.

    Base kinds are assign (a value of 12 or more characters given to a name like password; the span is
    the whole assignment), access (18 or more) and hex (16 or more). The kind entropy adds windows of
    high entropy, joined where they touch, unless a base span holds them or an allowed string meets them.
    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans, by start, joined by a comma)
    and spans (all of them). A null text counts as empty and has no spans. Rows are scanned each by
    itself, repeated ones and those with a null doc_id too; other columns are ignored.
    """
    source = documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return source.mapInArrow(
        partial(_scan_rows, window=window, thresholds=thresholds or THRESHOLDS, allowed=tuple(allowed)),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )
