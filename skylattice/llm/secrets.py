"""Secret scans with a recursive decoding worklist.

A text is a layer. Percent escapes and Unicode escapes of a layer give a new layer, and so does each base64 run that
decodes to text or to a compressed stream. Layers are scanned and unwrapped until no new one appears; a layer that is its
own ancestor is not scanned again, which ends cycles. Each decoded layer keeps a map to its parent, so that what is found
in it is reported as a span of the original text, at every place where the layer occurs.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.words import pieces

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of a run but the last end with the run; breaks may be escaped, lines indented or quoted. A run is tried from its start only.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[\x20\t]*+(?:\\r)?(?:\\n|\r?\n|\r)[\x20\t>]*+)+[A-Za-z0-9+/_-]++={0,2}")
_LINE = re.compile(r"(?:^|(?<=[\x20\t>\r\n])|(?<=\\n))[A-Za-z0-9+/_-]+")
_CUT = re.compile(r"[/_-]")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
#: What bytes have in which anything can be found.
_WORTH = re.compile(rb"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|%[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{16}")
#: Unpacked streams are read in parts of STEP bytes and scanned in windows with an overlap, so that memory has a bound.
STEP, WINDOW, OVERLAP = 1 << 16, 16 << 20, 1 << 20

Span = tuple[str, int, int]
Back = Callable[[int, int], tuple[int, int]]


def base_spans(text: str) -> set[Span]:
    found = {("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12}
    found |= {("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18}
    return found | {("hex", m.start(), m.end()) for m in HEX.finditer(text)}


def _replaced(text: str, pattern: re.Pattern, decode: Callable[[str], str | None]) -> tuple[str, Back] | None:
    """The text with the matches of `pattern` decoded, and the map of its spans to spans of `text`."""
    parts, starts, ends, sources, at, size = [], [], [], [], 0, 0
    for m in pattern.finditer(text):
        new = decode(m[0])
        if new is None or new == m[0]:
            continue
        parts += [text[at : m.start()], new]
        size += m.start() - at
        starts.append(size)
        size += len(new)
        ends.append(size)
        sources.append((m.start(), m.end()))
        at = m.end()
    if not starts:
        return None

    def place(p: int, end: bool) -> int:
        i = bisect_right(starts, p) - 1
        if i < 0:
            return p
        if p < ends[i]:
            return sources[i][1 if end else 0]
        return sources[i][1] + p - ends[i]

    return "".join([*parts, text[at:]]), lambda a, b: (place(a, False), place(b - 1, True) + (0 if _inside(b - 1, starts, ends) else 1))


def _inside(p: int, starts: list[int], ends: list[int]) -> bool:
    i = bisect_right(starts, p) - 1
    return i >= 0 and p < ends[i]


def _percent(run: str) -> str | None:
    try:
        return unquote_to_bytes(run).decode()
    except UnicodeDecodeError:
        return unquote_to_bytes(run).decode("latin-1")


def _escape(run: str) -> str | None:
    try:
        if run[0] == "&":
            return chr(int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1]))
        if run[1] == "u" and run[2] != "{":
            units = b"".join(int(x, 16).to_bytes(2, "big") for x in run.split("\\u")[1:])
            return units.decode("utf-16-be", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        return chr(int(run[3:-1] if run[2] == "{" else run[2:], 16))
    except (ValueError, OverflowError):
        return None


def _opener(head: bytes):
    """A decompressor for what starts like a gzip, zlib, bzip2 or xz stream."""
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] & 15 == 8 and head[0] >> 4 < 8 and (head[0] << 8 | head[1]) % 31 == 0):
        return zlib.decompressobj(47)
    return bz2.BZ2Decompressor() if head[:3] == b"BZh" else lzma.LZMADecompressor() if head[:6] == b"\xfd7zXZ\x00" else None


def _unpacked(opener, chunks: Iterator[bytes], ends: list[int] | None = None) -> Iterator[bytes]:
    """The content of a stream and of those that follow it at once, in parts of at most STEP bytes, as far as it can be read.

    `ends` gets the places where the streams of the first chunk end.
    """
    for chunk in chunks:
        for at in range(0, len(chunk), STEP):
            data = chunk[at : at + STEP]
            while len(data) or (opener and not getattr(opener, "needs_input", True)):
                opener = opener or _opener(bytes(data[:6]))
                if opener is None:
                    return
                try:
                    out = opener.decompress(data, STEP)
                except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                    return
                if out:
                    yield out
                if opener.eof:
                    data, opener = opener.unused_data, None
                    if ends is not None:
                        ends.append(min(at + STEP, len(chunk)) - len(data))
                else:
                    data = getattr(opener, "unconsumed_tail", b"")
    if hasattr(opener, "unconsumed_tail") and (out := opener.flush()):
        yield out


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes in windows of WINDOW; each starts with the last OVERLAP bytes of the one before."""
    held, fresh = bytearray(), False
    for chunk in chunks:
        held += chunk
        fresh = True
        while len(held) >= WINDOW:
            yield bytes(held[:WINDOW])
            fresh = len(held) > WINDOW
            del held[: WINDOW - OVERLAP]
    if fresh:
        yield bytes(held)


def _as_text(data: bytes) -> str | None:
    """The bytes as text: UTF-8, else a character for each byte, in which the ASCII parts are still read; None where nothing can be found."""
    if not _WORTH.search(data):
        return None
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _streams(data: bytes, heads: frozenset[bytes], places: Iterator[int] = ()) -> Iterator[tuple[int, str]]:
    """Texts within the compressed streams of `data`, and where the stream starts; weak marks count at `places` only."""
    after = 0
    for at in sorted({*places, *(m.start() for m in _MAGIC.finditer(data))}):
        # what stands within a stream that was read belongs to it
        opener = _opener(data[at : at + 6]) if at >= after else None
        if opener is not None:
            ends = []
            yield from ((at, t) for t in _contents(_unpacked(opener, iter((memoryview(data)[at:],)), ends), heads | {data[at : at + STEP]}))
            after = at + max(ends, default=0)


def _contents(chunks: Iterator[bytes], heads: frozenset[bytes]) -> Iterator[str]:
    """Texts of unpacked bytes, window by window; `heads` are the starts of the streams around it, which end cycles."""
    first = bytearray()
    for chunk in chunks:
        first += chunk
        if len(first) >= STEP:
            break
    head = bytes(first[:STEP])
    if not head or head in heads:
        return
    opener = _opener(head)
    if opener is not None:
        # a stream within the stream is read through; what may only look like one is also read as it is below
        inner = _unpacked(opener, chain((bytes(first),), chunks))
        start = next(inner, None)
        if start is not None:
            yield from _contents(chain((start,), inner), heads | {head})
            if len(head) == STEP or _MAGIC.match(head):
                return
    for window in _windows(chain((bytes(first),), chunks)):
        text = _as_text(window)
        if text is not None:
            yield text
        yield from (t for _, t in _streams(window, heads))


def _decoded(body: str) -> bytes:
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))


def _runs(text: str) -> Iterator[tuple[str, Back]]:
    """Layers from base64 runs, and from compressed streams within them.

    A run may go on over line breaks; its lines are also read one by one. Each run is read in all four alignments, so that
    characters that stand before the encoded part do not hide it.
    """
    for m in _RUN.finditer(text):
        yield from _layers(text, [m.start()], [m[0].rstrip("=")], m.end())
    for m in _WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), x[0]) for x in _LINE.finditer(m[0])]
        yield from _layers(text, [p for p, _ in lines], [x for _, x in lines], m.end())


def _layers(text: str, at: list[int], lines: list[str], end: int) -> Iterator[tuple[str, Back]]:
    """Layers from a run that stands in `lines` at the places `at` and ends at `end` with its padding."""
    run = "".join(lines)
    firsts = list(accumulate(map(len, lines[:-1]), initial=0))

    def spot(i: int) -> int:
        """The place in the text of character i of the run."""
        k = bisect_right(firsts, i) - 1
        return at[k] + i - firsts[k]

    # encoded parts may start at these, also after the letter of an escaped line break
    cuts = {0, *firsts, *(m.end() for m in _CUT.finditer(run)), *([1] if at[0] and text[at[0] - 1] == "\\" else [])}
    for o in range(4):
        data = _decoded(run[o:])
        new = _as_text(data)
        if new is not None:
            # the number of bytes before each character; a character of the other texts is a byte
            sizes = None if len(new) == len(data) else list(accumulate((len(c.encode()) for c in new), initial=0))

            def back(a: int, b: int, o: int = o, sizes: list[int] | None = sizes) -> tuple[int, int]:
                i, j = (sizes[a], sizes[b]) if sizes else (a, b)
                last = o + -(-j // 3) * 4
                return spot(o + i // 3 * 4), end if last > len(run) else spot(last - 1) + 1

            yield new, back
        for p, found in _streams(data, frozenset(), (c // 4 * 3 for c in cuts if c % 4 == o and c < len(run))):
            yield found, lambda a, b, s=spot(o + p // 3 * 4), e=end: (s, e)


def _children(layer: str) -> Iterator[tuple[str, Back]]:
    yield from (x for x in (_replaced(layer, _PERCENT, _percent), _replaced(layer, _ESCAPE, _escape)) if x)
    yield from _runs(layer)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def all_spans(text: str) -> set[Span]:
    """The base spans of the text and the mapped spans of all layers under it.

    The spans of a layer's text are worked out once and mapped through every place where the layer occurs. A layer that
    is its own ancestor ends a cycle; what was found under such an end is not kept for other places.
    """
    known: dict[bytes, set[Span]] = {}
    depth = {_digest(text): 0}
    # key, children still to come, spans so far, map to the parent, smallest depth of an ancestor met again
    stack: list[list] = [[_digest(text), _children(text), base_spans(text), None, 1]]
    while True:
        frame = stack[-1]
        child = next(frame[1], None)
        if child is not None:
            new, back = child
            key = _digest(new)
            if key in known:
                frame[2] |= {(kind, *back(a, b)) for kind, a, b in known[key]}
            elif key in depth:
                frame[4] = min(frame[4], depth[key])
            else:
                depth[key] = len(stack)
                stack.append([key, _children(new), base_spans(new), back, len(stack) + 1])
            continue
        key, _, spans, back, met = stack.pop()
        if not stack:
            return spans
        del depth[key]
        if met >= len(stack):
            known[key] = spans
        else:
            stack[-1][4] = min(stack[-1][4], met)
        stack[-1][2] |= {(kind, *back(a, b)) for kind, a, b in spans}


def ordered(spans: set[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


_ANY_BASE = r"(?i)password|passwd|secret|token|api_?key|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"
_ANY_LAYER = r"%[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{16}"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The counts and the digest are of the spans in the text itself; `spans` also has those of decoded layers, mapped to code
    points of the text. Null and empty texts have no spans and the digest of the empty string. Rows with equal or null ids
    are scanned one by one. Other columns are ignored.
    """
    empty = hashlib.sha256(b"").hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts = piece.column(1)
            counts, digest, spans = np.zeros((3, len(texts)), np.int64), [empty] * len(texts), [""] * len(texts)
            hit = [pc.fill_null(pc.match_substring_regex(texts, p), False).to_numpy(zero_copy_only=False) for p in (_ANY_BASE, _ANY_LAYER)]
            for i in np.flatnonzero(hit[0] | hit[1]).tolist():
                text = texts[i].as_py()
                base = base_spans(text) if hit[0][i] else set()
                for k, kind in enumerate(KINDS):
                    counts[k, i] = sum(s[0] == kind for s in base)
                digest[i] = hashlib.sha256(ordered(base).encode()).hexdigest()
                spans[i] = ordered(all_spans(text) if hit[1][i] else base)
            yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, counts), pa.array(digest), pa.array(spans)],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(read, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
