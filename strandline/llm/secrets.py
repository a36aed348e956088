"""Secret scans over a recursive decoding worklist.

Base patterns are searched in the whole text. Every stretch that could hold an encoded layer (percent escapes, Unicode
and hex escapes, character references, base64, and compressed bytes inside base64) is decoded into a new layer; the
worklist goes on with the layers until none is new. A layer seen before is not scanned again, which ends cycles. Each
character of a layer knows the stretch of the original text it came from, so a secret in any layer maps to a span there.
What compressed data unpacks to stands for the whole of it, so only the kinds that occur in it are asked for: it is read
in pieces, never held whole, and the layers inside it are read through the same pieces.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import map_arrow, release_memory, ship_package

KINDS = ("assign", "access", "hex")
#: Fixed patterns; letters of assign in either case, in ASCII alone.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Runs are maximal, so asking for the least length at once finds the same matches as dropping short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPES = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))|&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Runs, and their further lines where they are wrapped.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
SEPARATOR = re.compile(r"[/_-]+")
#: What a layer of bytes has to hold: base patterns and encoded stretches are ASCII, and the shortest has 14 characters.
READABLE = re.compile(rb"[\t\n\r -~]{14,}")
#: First bytes of gzip, bz2 and xz data, and of zlib data without a preset dictionary.
PACKED = re.compile(b"BZh[1-9]1AY&SY|" + b"|".join(re.escape(bytes(h)) for h in [(0x1F, 0x8B, 0x08), (0xFD, 0x37, 0x7A, 0x58, 0x5A, 0x00)] + [(c, f) for c in range(0x08, 0x80, 16) for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 32]), re.DOTALL)

Span = tuple[str, int, int]
#: A layer's text and the start and end of what each character stands for; or kinds found, and the start and end of it all.
Decoded = tuple[str, array, array] | tuple[set[str], int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, failing ones dropped: (kind, start, end) in code points."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


class Layer:
    """A decoded text and, for each of its characters, the span of the original text it stands for."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: array, ends: array):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        return min(self.starts[a:b]), max(self.ends[a:b])


# ---- unpacked data ----

#: Bytes of unpacked data that are held at once, and of the end of a piece that the next one repeats.
PIECE, LAP = 1 << 20, 1 << 14
_STEP = 1 << 16
#: Pieces that are looked at before their turn, at most.
MOST_AHEAD = 8
#: Of an xz stream's dictionary.
XZ_MEMORY = 1 << 26
_B_ASSIGN = re.compile(ASSIGN.pattern.encode())  # of lower-cased bytes
_B_ACCESS, _B_HEX = re.compile(ACCESS.pattern.encode()), re.compile(HEX.pattern.encode())
_B_PERCENT, _B_ESCAPES, _B_BASE64 = (re.compile(x.pattern.encode()) for x in (PERCENT, ESCAPES, BASE64))
#: How a run goes on from any place in it.
_B_MORE = re.compile(rb"[A-Za-z0-9+/_-]*(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
_SPACES = re.compile(rb" {65,}")
_STANDARD = bytes.maketrans(b"-_", b"+/")
#: A source gives its bytes anew, in pieces, each time it is called.
Source = Callable[[], Iterator[bytes]]


class _Zlib:
    """zlib's decompressor with the members that bz2's and lzma's have."""

    def __init__(self, bits: int):
        self.d, self.needs_input = zlib.decompressobj(bits), True

    def decompress(self, data: bytes, most: int) -> bytes:
        out = self.d.decompress(self.d.unconsumed_tail + data, most)
        self.needs_input = len(out) < most
        return out

    eof = property(lambda self: self.d.eof)
    unused_data = property(lambda self: self.d.unused_data)


def _decompressor(head: bytes, raw: bool):
    if raw:
        return _Zlib(-15)
    if head[:2] == b"BZ":
        return bz2.BZ2Decompressor()
    if head[:2] == b"\xfd7":
        return lzma.LZMADecompressor(memlimit=XZ_MEMORY)
    return _Zlib(47)


def _from(source: Source, at: int) -> Iterator[bytes]:
    """A source's bytes from a place on; what is needed of a long piece is copied by and by."""
    for piece in source():
        for first in range(at, len(piece), _STEP):
            yield piece[first : first + _STEP]
        at = max(0, at - len(piece))


class Ahead:
    """The pieces of a source in order, of which some may be looked at before their turn."""

    def __init__(self, source: Source):
        self.source, self.rest, self.seen = source, source(), deque()

    def peek(self, i: int) -> bytes | None:
        """The piece that comes after i others, None after the last."""
        while len(self.seen) <= i:
            piece = next(self.rest, None)
            if piece is None:
                return None
            self.seen.append(piece)
        return self.seen[i]

    def take(self) -> bytes | None:
        piece = self.peek(0)
        if piece is not None:
            self.seen.popleft()
        return piece

    def following(self, held: bytes, at: int) -> Source:
        """A source of held, which ends at the place `at` of the whole, and all after it: from the pieces that are near, so
        that short data needs no other pass over the whole, and then from the whole made anew."""

        def near() -> Iterator[bytes]:
            yield held
            place = at
            for i in range(MOST_AHEAD):
                piece = self.peek(i)
                if piece is None:
                    return
                yield piece
                place += len(piece)
            yield from _from(self.source, place)

        return near


class Unpacked:
    """Source of what the compressed data from place `at` of a source on unpacks to; gzip data may have more members.
    After a call is used up, `used` is the length of the whole members, 0 if not even one is whole."""

    def __init__(self, source: Source, at: int, raw: bool = False):
        self.source, self.at, self.raw, self.used = source, at, raw, 0

    def __call__(self) -> Iterator[bytes]:
        self.used, given = 0, 0
        one, gzip = None, False
        try:
            waiting = b""
            for data in _from(self.source, self.at):
                given += len(data)
                waiting += data
                while waiting or (one is not None and not one.needs_input):
                    if one is None:
                        if self.used and not (gzip and waiting[:2] == b"\x1f\x8b"):
                            if len(waiting) < 2 and gzip:
                                break
                            return
                        gzip = waiting[:2] == b"\x1f\x8b"
                        one = _decompressor(waiting[:2], self.raw)
                    out = one.decompress(waiting, PIECE)
                    waiting = b""
                    if out:
                        yield out
                    if one.eof:
                        waiting = one.unused_data
                        self.used = given - len(waiting)
                        one = None
                        if self.raw:
                            return
        except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
            return


class Decoded64:
    """Source of the base64 run between two places of a source, line breaks left out, from its character `shift` on."""

    def __init__(self, source: Source, a: int, b: int, shift: int):
        self.source, self.a, self.b, self.shift = source, a, b, shift

    def __call__(self) -> Iterator[bytes]:
        left, skip, held = self.b - self.a, self.shift, b""
        for piece in _from(self.source, self.a):
            piece, left = piece[:left], left - len(piece)
            held += piece.translate(_STANDARD, b" \t\r\n=")
            held, skip = held[skip:], max(0, skip - len(held))
            n = len(held) // 4 * 4
            yield base64.b64decode(held[:n])
            held = held[n:]
            if left <= 0:
                break
        if len(held) > 1:
            yield base64.b64decode(held + b"=" * (-len(held) % 4))


class Replaced:
    """Source with the matches of a pattern, of less than 64 bytes each, replaced."""

    def __init__(self, source: Source, pattern: re.Pattern, begins: bytes, value):
        self.source, self.pattern, self.begins, self.value = source, pattern, begins, value

    def __call__(self) -> Iterator[bytes]:
        held = b""
        for piece in self.source():
            held += piece
            cut = min((i for i in (held.find(c, max(0, len(held) - 64)) for c in self.begins) if i >= 0), default=len(held))
            yield self.pattern.sub(self.value, held[:cut])
            held = held[cut:]
        yield self.pattern.sub(self.value, held)


def _percent_value(m: re.Match) -> bytes:
    return bytes([int(m[0][1:], 16)])


def _escape_value(m: re.Match) -> bytes:
    return _escaped(m[0].decode(), *(x and x.decode() for x in m.groups())).encode("utf-8", "replace")


def _settled(source: Source, seen: set[bytes]) -> Source | None:
    """The source, or its bytes where they are few; None if they have been seen or are none."""
    digest, held, n = hashlib.blake2b(), [], 0
    for piece in source():
        digest.update(piece)
        n += len(piece)
        held = [*held, piece] if n <= PIECE else []
    if not n or digest.digest() in seen:
        return None
    seen.add(digest.digest())
    if n > PIECE:
        return source
    data = b"".join(held)
    return lambda: iter((data,))


def kinds_in(source: Source, seen: set[bytes]) -> set[str]:
    """Kinds of which unpacked data, or any layer inside it, has a match. Pieces are searched with the end of the one
    before; runs of spaces, which may have any length inside a match, count as 64. A layer that is longer than a piece is
    made anew from its source for each pass, so memory is some pieces for each level, whatever data unpacks to. Packed
    data inside it is read from the pieces of the same pass, so time grows with the layer, not with that times what is
    packed in it; only what is itself longer than MOST_AHEAD pieces is read again from the layer's start."""
    found: set[str] = set()
    work = [source]
    while work and len(found) < len(KINDS):
        layer = work.pop()
        inner: list[Source] = []
        percent = escapes = False
        carry, near, base, run, packed_to, last_end = b"", b"", 0, None, 0, False
        pieces = Ahead(layer)
        while (piece := pieces.take()) is not None:
            last_end = pieces.peek(0) is None
            buf = carry + piece
            near = _SPACES.sub(b" " * 64, near[-LAP:] + piece)
            found |= _byte_kinds(near, found)
            percent = percent or _B_PERCENT.search(buf) is not None
            escapes = escapes or _B_ESCAPES.search(buf) is not None
            first = 0
            if run is not None:
                first = _B_MORE.match(buf).end()
                if last_end or buf[first:].strip(b" \t\r\n"):
                    inner += [Decoded64(layer, run, base + first, shift) for shift in range(4)]
                    run = None
            for m in _B_BASE64.finditer(buf, first) if run is None else ():
                if last_end or buf[m.end() :].strip(b" \t\r\n"):
                    text = m[0]
                    inner += [Decoded64(lambda text=text: iter((text,)), 0, len(text), shift) for shift in range(4)]
                elif len(buf) - m.start() >= LAP:  # shorter ones stand whole in the next piece
                    run = base + m.start()
            at = max(0, packed_to - base)
            while m := PACKED.search(buf, at):
                at = m.start() + 1
                packed_to = base + at
                if _fails_at_once(buf[m.start() : m.start() + 512]):
                    continue
                unpacked = Unpacked(pieces.following(buf[m.start() :], base + len(buf)), 0)
                settled = _settled(unpacked, seen)
                if settled is unpacked:  # long: it is made again later, when these pieces have gone
                    settled = Unpacked(layer, base + m.start())
                if unpacked.used:
                    at = m.start() + unpacked.used
                    packed_to = base + at
                    if settled is not None:
                        work.append(settled)
            packed_to = max(packed_to, base + len(buf) - LAP)
            carry = buf[-LAP:]
            base += len(buf) - len(carry)
        if percent:
            inner.append(Replaced(layer, _B_PERCENT, b"%", _percent_value))
        if escapes:
            inner.append(Replaced(layer, _B_ESCAPES, b"\\&", _escape_value))
        work += [x for x in (_settled(i, seen) for i in inner) if x is not None]
    return found


def _byte_kinds(buf: bytes, known: set[str]) -> set[str]:
    """Kinds that have a match in bytes; those known are not looked for."""
    found = set()
    if "assign" not in known:
        low = buf.lower()
        if any(w in low for w in (b"passw", b"secret", b"token", b"api")) and any(len(m[2]) >= 8 for m in _B_ASSIGN.finditer(low)):
            found.add("assign")
    if "access" not in known and b"AKIA" in buf and _B_ACCESS.search(buf):
        found.add("access")
    if "hex" not in known and _B_HEX.search(buf):
        found.add("hex")
    return found


def _fails_at_once(head: bytes, raw: bool = False) -> bool:
    """Whether the first bytes show that it is no compressed data."""
    try:
        _decompressor(head[:2], raw).decompress(head, 64)
    except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
        return True
    return False


def _packed(data: bytes, raw: bool) -> Iterator[tuple[int, int, set[str]]]:
    """First and last place (exclusive) of compressed data in data, and the kinds in what it unpacks to. Data without a
    header of its own is looked for at the start, if `raw`."""
    whole: Source = lambda: iter((data,))
    tries = [Unpacked(whole, 0, True)] if raw else []
    at = 0
    while tries or (m := PACKED.search(data, at)):
        if not tries and _fails_at_once(data[m.start() : m.start() + 512]):
            at = m.start() + 1
            continue
        one = tries.pop() if tries else Unpacked(whole, m.start())
        seen: set[bytes] = {hashlib.blake2b(data).digest()}
        settled = _settled(one, seen)
        if not one.raw:
            at = one.at + max(1, one.used)
        if one.used and settled is not None:
            yield one.at, one.at + one.used, kinds_in(settled, seen)


def _percent(text: str) -> Iterator[Decoded]:
    """One layer of the whole text; an escaped byte that is no UTF-8 is a replacement character. Then what is compressed
    in a token with escapes, as the escapes and ASCII give its bytes."""
    runs = list(re.finditer(r"(?:%[0-9A-Fa-f]{2})+", text)) if "%" in text else []
    if not runs:
        return
    out, starts, ends, at = [], array("q"), array("q"), 0
    for m in runs:
        out.append(text[at : m.start()])
        starts.extend(range(at, m.start()))
        ends.extend(range(at + 1, m.start() + 1))
        at = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            bad = "\ud800" <= c <= "\udfff"  # one byte each
            step = 3 if bad else 3 * len(c.encode())
            out.append("\ufffd" if bad else c)
            starts.append(at)
            ends.append(at + step)
            at += step
    starts.extend(range(at, len(text)))
    ends.extend(range(at + 1, len(text) + 1))
    yield "".join(out) + text[at:], starts, ends
    for m in re.finditer(r"\S+", text):
        if not PERCENT.search(m[0]):
            continue
        plain = unquote_to_bytes(m[0].encode("utf-8", "surrogatepass"))
        for data in {plain, unquote_to_bytes(m[0].replace("+", " ").encode("utf-8", "surrogatepass"))}:  # forms write a space as +
            if not PACKED.search(data):
                continue
            bounds = array("q", [m.start()])
            for piece in re.finditer(r"%[0-9A-Fa-f]{2}|.", m[0], re.DOTALL):
                bounds.extend([m.start() + piece.end()] * (1 if len(piece[0]) == 3 else len(piece[0].encode("utf-8", "surrogatepass"))))
            for a, b, kinds in _packed(data, False):
                yield kinds, bounds[a], bounds[b]


def _escaped(whole: str, *codes: str | None) -> str:
    """What an escape means; itself if nothing."""
    code = next((c for c in codes if c), None)
    if code is None:
        return html.unescape(whole)
    n = int(code, 16)
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else whole


def _escapes(text: str) -> Iterator[Decoded]:
    """One layer of the whole text, if it has an escape that means a character."""
    out, starts, ends, at, changed = [], array("q"), array("q"), 0, False
    for m in ESCAPES.finditer(text):
        c = _escaped(m[0], *m.groups())
        if c == m[0]:
            continue
        changed = True
        out += [text[at : m.start()], c]
        starts.extend(range(at, m.start()))
        ends.extend(range(at + 1, m.start() + 1))
        starts.extend([m.start()] * len(c))
        ends.extend([m.end()] * len(c))
        at = m.end()
    if changed:
        starts.extend(range(at, len(text)))
        ends.extend(range(at + 1, len(text) + 1))
        yield "".join(out) + text[at:], starts, ends


def _base64(text: str) -> Iterator[Decoded]:
    """Layers of each run, its lines joined, at all four alignments: what precedes encoded data in a run, such as a path,
    can leave it at any. Readable stretches of the bytes are layers; compressed data anywhere in them is searched."""
    for m in BASE64.finditer(text):
        body, at = m[0].rstrip("="), range(m.start(), m.end())
        if "\n" in body:
            cuts = [*((x.start(), x.end()) for x in BREAK.finditer(body)), (len(body), len(body))]
            begins = [0, *(b for _, b in cuts)]
            at = array("q")
            for a, (b, _) in zip(begins, cuts):
                at.extend(range(m.start() + a, m.start() + b))
            body = "".join(body[a:b] for a, (b, _) in zip(begins, cuts))
        parts = [x.end() for x in SEPARATOR.finditer(body) if 4 <= x.end() < len(body) - 8]
        body = body.replace("-", "+").replace("_", "/")
        for first in parts:  # data without a header of its own is looked for where a part begins
            if _fails_at_once(base64.b64decode(body[first : first + 4 * min(128, (len(body) - first) // 4)]), True):
                continue
            n = len(body) - first - ((len(body) - first) % 4 == 1)
            data = base64.b64decode(body[first : first + n] + "=" * (-n % 4))
            for a, b, kinds in _packed(data, True):
                if a == 0:
                    yield kinds, at[first], at[min(first + n - 1, first + (4 * b - 1) // 3)] + 1
        for shift in range(4):
            n = len(body) - shift - (len(body) % 4 == (shift + 1) % 4)  # a last character alone holds no byte
            data = base64.b64decode(body[shift : shift + n] + "=" * (-n % 4))
            last = shift + n - 1
            for r in READABLE.finditer(data):  # byte i lies in the characters 4 i / 3 and on
                yield r[0].decode("ascii"), array("q", [at[shift + i * 4 // 3] for i in range(*r.span())]), array("q", [at[min(last, shift + (4 * i + 3) // 3)] + 1 for i in range(*r.span())])
            for a, b, kinds in _packed(data, True):
                yield kinds, at[shift + a * 4 // 3], m.end() if b == len(data) else at[min(last, shift + (4 * b - 1) // 3)] + 1


DECODERS = (_percent, _escapes, _base64)
_ANY = re.compile(r"%[0-9A-Fa-f]{2}|\\[uUx]|&[#A-Za-z]|[A-Za-z0-9+/_-]{16}")


def layers(text: str) -> Iterator[Layer | tuple[set[str], int, int]]:
    """All decoded layers, the text itself left out; and of compressed data the kinds found in what it unpacks to, however
    deep, with the span of the original text that it stands in."""
    if not _ANY.search(text):
        return
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass")).digest()}
    work: list[Layer | None] = [None]  # None: the text itself, whose places are its own
    while work:
        layer = work.pop()
        source = text if layer is None else layer.text
        for decode in DECODERS:
            for decoded, starts, ends in decode(source):
                if isinstance(decoded, set):
                    yield decoded, *((starts, ends) if layer is None else layer.span(starts, ends))
                    continue
                if not decoded:
                    continue
                if layer is not None:
                    spans = [layer.span(a, b) for a, b in zip(starts, ends)]
                    starts, ends = array("q", (a for a, _ in spans)), array("q", (b for _, b in spans))
                key = hashlib.blake2b(f"{starts[0]} {ends[-1]} ".encode() + decoded.encode("utf-8", "surrogatepass")).digest()
                if key not in seen:
                    seen.add(key)
                    new = Layer(decoded, starts, ends)
                    yield new
                    if _ANY.search(decoded):
                        work.append(new)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind, then end. Spans of decoded layers that cover a base span of the
    same kind and place count once."""
    text = text or ""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    every = set(base)
    for layer in layers(text):
        if isinstance(layer, Layer):
            every |= {(kind, *layer.span(a, b)) for kind, a, b in base_spans(layer.text)}
        else:
            every |= {(kind, *layer[1:]) for kind in layer[0]}
    return base, sorted(every, key=order)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base array<struct<kind:string,start:long,end:long>>, found array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text; others are not read): doc_id, base counts by kind, base and found spans in
    code points of the text, end exclusive. Null and empty texts have none; repeated rows and null ids stay; malformed UTF-8
    is read with replacement characters. Memory grows with the largest text, not with what it unpacks to. UTF-16 inside
    base64, and base32, are not decoded."""
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.secrets import KINDS, scan

        for b in batches:
            found = [scan(t.as_py()) for t in b.column(1)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            spans = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[i]] for f in found], _SPANS) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, *spans], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "found"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.col("text").cast("string")).alias("text")), work, SCHEMA)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """text with each maximal stretch of spans replaced."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mark]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with the secrets found in text replaced by mark, and n_chars, if there, counted anew. All rows and columns stay:
    null and empty texts as they are, repeated rows, null ids, further columns of any name. Very long texts are read whole,
    malformed UTF-8 becomes replacement characters, an empty table stays empty."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        from strandline.llm.secrets import redact, scan

        out = texts.map(lambda t: None if t is None else redact(t, scan(t)[1], mark))
        release_memory()
        return out

    out = docs.withColumn("text", clean(F.make_valid_utf8(F.col("text").cast("string"))))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
