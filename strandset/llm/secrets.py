"""Secret scans by token efficiency.

Random strings are costly in tokens: a byte-pair vocabulary learned on natural text has few long
merges for them, so few characters fall to each token. The scan takes runs of key-like characters,
leaves out known digests and identifiers, and reports those with a low ratio of characters to
tokens. Three fixed patterns (assignments, access keys, long hexadecimal runs) are always reported.
"""

from __future__ import annotations

import base64
import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.llm.common import one_byte, runs_of, texts

#: Order of the kinds where spans start together.
KINDS = ("assign", "access", "hex", "opaque")

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api")

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_KEY = np.zeros(256, bool)
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True

#: Digests are hexadecimal in one case and as long as a known hash; identifiers are UUIDs and numbers.
_DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
_ONE_CASE_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NUMBER = re.compile(r"[0-9+/_=-]+")
_DIGIT, _LETTER, _HUMPS = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]"), re.compile(r"[a-z][A-Z].*[a-z][A-Z]")

#: Whole e-mail addresses and the host names of URLs; before an address neither a password nor a token in a URL ends.
_ADDRESS = re.compile(r"(?<![:/A-Za-z0-9._%+=-])[A-Za-z0-9._%+=-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}|(?<=://)[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9@.:-])")
_PART = re.compile(r"[^/=_-]+")

SCHEMA = "spans array<struct<kind:string,start:long,end:long>>"


@functools.cache
def _vocabulary(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _mixed(s: str) -> bool:
    return bool(_DIGIT.search(s) and _LETTER.search(s) or _HUMPS.search(s))


def _known(s: str) -> bool:
    """Digests and identifiers, which are random-looking but no secrets."""
    return bool(
        len(s) in _DIGEST_LENGTHS and _ONE_CASE_HEX.fullmatch(s) or _UUID.fullmatch(s) or _NUMBER.fullmatch(s)
    )


def _opaque(run: str, vocabulary: tiktoken.Encoding, least: int, ratio: float) -> list[tuple[int, int]]:
    """The random stretches of a run: the whole run, or else what is left between its natural parts."""

    def costly(s: str) -> bool:
        return len(s) < ratio * len(vocabulary.encode_ordinary(s))

    def random(s: str) -> bool:
        return bool(len(s) >= least and _mixed(s) and not _known(s) and costly(s))

    if not _mixed(run) or _known(run):
        return []
    if costly(run):
        return [(0, len(run))]
    found, begin, end = [], None, 0
    for m in [*_PART.finditer(run), None]:
        if m and costly(m[0]):
            begin, end = m.start() if begin is None else begin, m.end()
        elif begin is not None:
            # Base64 holds separators itself, so neighbouring parts count together.
            if random(run[begin:end]) and max(map(len, _PART.findall(run[begin:end]))) >= 8:
                found.append((begin, end))
            begin = None
    return found


class _Intervals:
    """Intervals of a text, merged where they overlap, to be asked by bisection."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        at = bisect.bisect_right(self.ends, a)
        return at < len(self.starts) and self.starts[at] < b

    def holds(self, a: int, b: int) -> bool:
        at = bisect.bisect_right(self.starts, a) - 1
        return at >= 0 and b <= self.ends[at]


def _spans(strings: list[str], vocabulary: str, least: int, ratio: float) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, kind, end) in order."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in strings]
    for out, s in zip(found, strings, strict=True):
        low = s.encode("ascii", "replace").lower()
        if any(k in low for k in KEYWORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(s) if len(m[2]) >= LEAST_ASSIGN]
        if b"akia" in low:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(s) if len(m[0]) >= LEAST_ACCESS]
    known: dict[int, tuple[_Intervals, _Intervals]] = {}
    data, starts = one_byte(strings)
    for table, kind, shortest in ((_HEX, 2, LEAST_HEX), (_KEY, 3, least)):
        begin, end = runs_of(table[data])
        long = end - begin >= shortest
        begin, end = begin[long], end[long]
        row = np.searchsorted(starts, begin, "right") - 1
        begin, end = begin - starts[row], end - starts[row]
        for r, a, b in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True):
            s = strings[r]
            if kind == 3:
                if r not in known:
                    known[r] = _Intervals([(i, j) for i, _, j in found[r]]), _Intervals([m.span() for m in _ADDRESS.finditer(s)])
                taken, addresses = known[r]
                if addresses.holds(a, b):
                    continue
                for x, y in _opaque(s[a:b], _vocabulary(vocabulary), least, ratio):
                    if not taken.meets(a + x, a + y):
                        found[r].append((a + x, kind, a + y))
                continue
            found[r].append((a, kind, b))
    for out in found:
        out.sort()
    return found


def scan_secrets(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    least: int = 20,
    ratio: float = 2.0,
) -> DataFrame:
    """Spans of secrets in every whole text: (doc_id, spans).

    ``spans`` holds kind, start and end (code points, end exclusive) by start, then kind. ``opaque``
    spans are runs of ``least`` or more key-like characters with fewer than ``ratio`` characters to a
    token of ``vocabulary`` (a tiktoken rank file) that overlap no other span; in a run with more, stretches
    of such parts between ``/``, ``=``, ``_`` and ``-``. Whole e-mail addresses and host names of URLs hold none. A null or empty text has
    no spans; a null id, repeated rows and ties stay as they are, one result a row; other columns are
    not read; an empty table gives an empty result. One narrow pass: no shuffle.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found = _spans(texts(batch, "text"), path, least, ratio)
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in out] for out in found]
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(scan, "doc_id long, " + SCHEMA)


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
