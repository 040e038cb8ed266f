"""Secret scan with a recursive decoding worklist.

The plain text is scanned first. Lines that hold percent escapes, Unicode escapes or base64 (also of compressed data, and
over several lines of one width) are decoded into layers; a layer is scanned and decoded again until nothing new
appears. What is no text inside a layer stands between its readable stretches. Every character of a layer knows
the span of the original text it came from, so findings of any depth are reported in the original.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import string
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.batches import importable, pieces

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\})+")
_ONE_UNICODE = re.compile(r"\\(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2})+")
# Decoded bytes that are worth a look: a stretch of text as long as the shortest finding, or a compressed stream.
_STRETCH = re.compile(rb"[\x20-\x7e\t\r\n]{12}")
_PACKED = (b"\x1f\x8b\x08", b"BZh", b"\xfd7zXZ", b"x\x01", b"x\x9c", b"x\xda")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_TEXT_CONTROLS = dict.fromkeys(map(ord, "\t\r\n"))

#: Bytes that are inflated at a time. Larger layers are scanned piece by piece, cut where nothing can reach across.
PIECE = 1 << 20
#: Inside a compressed layer, a run without any place to cut is cut after so many characters, and so many are repeated.
LONGEST, OVERLAP = 64 << 20, 1 << 16
_SLICE = 1 << 16
_CODED = string.ascii_letters + string.digits + "+/_-"


def _names_secret(text: str) -> bool:
    # By parts: lower case of a text with other letters than ASCII takes twelve bytes a character on the way.
    parts = (text[i : i + PIECE + 8].lower() for i in range(0, len(text), PIECE))
    return any(word in part for part in parts for word in _WORDS)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain findings, in order."""
    found = []
    if _names_secret(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


@dataclass(slots=True)
class _Layer:
    """A text, and where its characters come from.

    It is made of stretches, each copied from the layer above or decoded there. Only their beginnings are held, with the
    place of a copy or the decoded stretch's own places, so a long line takes no more than its text. Places are looked
    up through the layers above when something is found. They never fall, so the last character of a span has its largest
    end. Where all characters come from one ``span`` of the original, that is all there is.
    """

    text: str
    depth: int = 0
    above: _Layer | None = None
    begins: array = field(default_factory=lambda: array("q"))
    places: list[int | _Places] = field(default_factory=list)
    decoded: list[tuple[int, int]] = field(default_factory=list)
    span: tuple[int, int] | None = None
    first: int | None = None

    def add(self, length: int, place: int | _Places) -> None:
        """A further stretch: copied from ``place`` on, or decoded."""
        if not length:
            return
        begin = self.size()
        self.begins[-1:] = array("q", [begin, begin + length])
        self.places.append(place)
        stretches = [(0, length)] if not isinstance(place, int) else self.above.decoded_in(place, place + length)
        for b, e in stretches:
            if self.decoded and self.decoded[-1][1] == begin + b:
                b, _ = self.decoded.pop()
                b -= begin
            self.decoded.append((begin + b, begin + e))

    def size(self) -> int:
        return self.begins[-1] if self.begins else 0

    def decoded_in(self, begin: int, end: int) -> list[tuple[int, int]]:
        """Decoded stretches between two places, counted from the first one."""
        if self.span:
            return [(0, end - begin)]
        found = []
        for i in range(bisect_right(self.decoded, begin, key=lambda stretch: stretch[1]), len(self.decoded)):
            b, e = self.decoded[i]
            if b >= end:
                break
            found.append((max(b, begin) - begin, min(e, end) - begin))
        return found

    def start(self, at: int) -> int:
        """Where the character begins in the original."""
        layer = self
        while layer.above is not None or layer.span:
            if at == 0 and layer.first is not None:
                return layer.first
            if layer.span:
                return layer.span[0]
            k = bisect_right(layer.begins, at) - 1
            place, within = layer.places[k], at - layer.begins[k]
            at = place + within if isinstance(place, int) else place.start(within)
            layer = layer.above
        return at

    def end(self, at: int) -> int:
        """Where the character ends in the original."""
        layer = self
        while layer.above is not None or layer.span:
            if layer.span:
                return layer.span[1]
            k = bisect_right(layer.begins, at) - 1
            place, within = layer.places[k], at - layer.begins[k]
            at = place + within if isinstance(place, int) else place.last(within)
            layer = layer.above
        return at + 1


def _opener(data: bytes) -> Callable | None:
    """What opens the gzip, zlib, bzip2 or xz stream that ``data`` begins with; ``None`` when it is none of these."""
    if data[:3] == b"\x1f\x8b\x08" or (data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0):
        return lambda: zlib.decompressobj(47)
    if data[:3] == b"BZh" and data[4:10] in (b"1AY&SY", b"\x17\x72\x45\x38\x50\x90"):
        return bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    return None


class _Streams:
    """Beginnings of the compressed streams of a text that were opened, and of those found damaged."""

    def __init__(self):
        self.good: set[bytes] = set()
        self.bad: set[bytes] = set()

    def closed(self) -> int:
        """Damaged streams. One that begins another stream is the same one, cut off where a line ends."""
        return sum(not any(x != b and x.startswith(b) for x in self.good | self.bad) for b in self.bad - self.good)


def _members(chunks: Iterator[bytes], streams: _Streams) -> Iterator[bytes]:
    """Contents of all streams that stand one after another, in pieces; what follows them is passed on as it is.

    Of a damaged stream the part before the damage is given. Bytes that only look like a stream are given themselves.
    """
    opened, data, whole, some, taken = None, b"", b"", False, False

    def damaged() -> Iterator[bytes]:
        if some or whole[:1] != b"\x78":
            streams.bad.add(whole[:48])
        if not some or whole[:1] == b"\x78":
            yield whole
            yield from chunks

    chunks = iter(chunks)
    for chunk in chain(chunks, [b""]):
        data += chunk
        if opened is not None and len(whole) < PIECE:
            whole += chunk
        while data:
            if opened is None:
                data = data.lstrip(b"\0") if taken else data  # padding
                if len(data) < 16 and chunk:
                    break
                make = _opener(data)
                if make is None:
                    yield data
                    yield from chunks
                    return
                opened, whole, some = make(), data, False
            try:
                while not opened.eof:
                    out = opened.decompress(data, PIECE)
                    data = getattr(opened, "unconsumed_tail", b"")
                    if out:
                        some = True
                        yield out
                    elif not data:
                        break
            except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                yield from damaged()
                return
            if not opened.eof:
                break
            streams.good.add(whole[:48])
            data, opened, taken = opened.unused_data, None, True
    if opened is not None:
        yield from damaged()


def _peeled(data: bytes, streams: _Streams) -> tuple[Iterator[bytes], bool]:
    """Contents of bytes in however many compressed layers, in pieces, and whether there was any such layer."""
    known: set[bytes] = set()
    while _opener(data) and data not in known:
        known.add(data)
        stream = _members((data[i : i + _SLICE] for i in range(0, len(data), _SLICE)), streams)
        head, size = [], 0
        for part in stream:
            head.append(part)
            size += len(part)
            if size > 2 * PIECE:
                return _unwrapped(chain(head, stream), streams), True
        inner = b"".join(head)
        if inner == data:
            return iter([data]), len(known) > 1
        data = inner
    return iter([data]), bool(known)


def _unwrapped(chunks: Iterator[bytes], streams: _Streams) -> Iterator[bytes]:
    """As ``_peeled``, for layers that are too large to be held."""
    head = b""
    for chunk in chunks:
        head += chunk
        if len(head) >= 16:
            break
    stream = chain([head], chunks)
    return _unwrapped(_members(stream, streams), streams) if _opener(head) else stream


_FREE = re.compile(r"""[^%\\{}"'\x20:=A-Za-z0-9+/_.\-\r\n\t]|\n|\x20([A-Za-z0-9]{1,15})\x20(?=[A-Za-z0-9])""")
_CODED_LINE = re.compile(r"[A-Za-z0-9+/_-]{16,}=*\r?\n\Z|[\n][ \t]*[A-Za-z0-9+/_-]+=*\r?\n\Z")


def _last_cut(text: str, since: int) -> int:
    """The end of the last place behind ``since`` that no finding and no coded run reaches across; 0 when there is none."""
    high = len(text)
    while high > since:
        low = max(since, high - (1 << 16))
        for m in reversed(list(_FREE.finditer(text, low, min(len(text), high + 32)))):
            if m[0] == "\n":
                if _CODED_LINE.search(text[max(0, m.end() - 200) : m.end()]):
                    continue
            elif m[1] and m[1].lower().endswith(_WORDS):
                continue
            return m.end()
        high = low
    return 0


def _texts(chunks: Iterator[bytes]) -> Iterator[str]:
    """Text of the pieces, cut anew where nothing can reach across. Bytes that are no UTF-8 become lone surrogates."""
    read = codecs.getincrementaldecoder("utf-8")("surrogateescape")
    text, seen = "", 0
    for chunk in chunks:
        text += read.decode(chunk)
        if len(text) < PIECE:
            continue
        # A run that began before may only be seen as a word when its beginning is seen: look back a little.
        cut = _last_cut(text, max(0, seen - 256))
        if cut:
            yield text[:cut]
            text = text[cut:]
        elif len(text) >= LONGEST:
            # Cut where a group of four base64 characters, or a line of them, begins.
            line, run = text.rfind("\n", 0, len(text) - OVERLAP) + 1, len(text.rstrip(_CODED))
            again = len(text) - OVERLAP
            again = line if line > again - OVERLAP else again - (again - run) % 4 if run < again else again
            yield text
            text = text[again:]
        seen = len(text)
    yield text + read.decode(b"", True)


def _readable(text: str) -> bool:
    return text.translate(_TEXT_CONTROLS).isprintable()


class _Places:
    """Where the characters of a decoded stretch were written, if it is one span that cannot be told apart."""

    __slots__ = ("begin", "until")

    def __init__(self, begin: int, until: int):
        self.begin, self.until = begin, until

    def start(self, at: int) -> int:
        return self.begin

    def last(self, at: int) -> int:
        return self.until - 1


class _Written(_Places):
    """Places in a text of bytes that were written with ``many`` characters for ``few`` bytes, those at ``at``."""

    __slots__ = ("text", "at", "many", "few", "_before")

    _STEP = 1 << 12

    def __init__(self, text: str, at: Sequence[int], many: int, few: int):
        self.text, self.at, self.many, self.few, self._before = text, at, many, few, None

    def _bytes(self, count: int) -> int:
        """How many bytes the first ``count`` characters are."""
        if self.text.isascii():
            return count
        if self._before is None:
            parts = (self.text[i : i + self._STEP] for i in range(0, len(self.text), self._STEP))
            self._before = array("q", accumulate((_size(part) for part in parts), initial=0))
        k = count // self._STEP
        return self._before[k] + _size(self.text[k * self._STEP : count])

    def start(self, at: int) -> int:
        return self.at[self._bytes(at) * self.many // self.few]

    def last(self, at: int) -> int:
        return self.at[-(-self._bytes(at + 1) * self.many // self.few) - 1]


class _Units(_Places):
    """Places of characters each written by an escape of its own."""

    __slots__ = ("begins", "ends")

    def __init__(self, begins: array, ends: array):
        self.begins, self.ends = begins, ends

    def start(self, at: int) -> int:
        return self.begins[at]

    def last(self, at: int) -> int:
        return self.ends[at] - 1


class _Joined:
    """The places of several spans, one after another."""

    def __init__(self, spans: Sequence[tuple[int, int]]):
        self.spans = spans
        self.before = array("q", accumulate((e - b for b, e in spans), initial=0))

    def __getitem__(self, at: int) -> int:
        k = bisect_right(self.before, at) - 1
        return self.spans[k][0] + at - self.before[k]


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogateescape"))


@dataclass(slots=True)
class _Hit:
    """A decoded stretch: its text and the places its characters came from. ``more`` are further pieces of it."""

    begin: int
    end: int
    text: str
    places: _Places
    more: Iterator[str] = ()


def _hit(data: bytes, at: Sequence[int], end: int, per_byte: tuple[int, int], streams: _Streams) -> _Hit:
    """Bytes that were written with the characters at the positions ``at``, as many as the ratio ``per_byte`` says."""
    chunks, whole = _peeled(data, streams)
    if whole:
        texts = _texts(chunks)
        return _Hit(at[0], end, next(texts), _Places(at[0], end), texts)
    text = data.decode("utf-8", "surrogateescape")
    return _Hit(at[0], end, text, _Written(text, at, *per_byte))


def _percent(m: re.Match, streams: _Streams) -> _Hit:
    return _hit(bytes.fromhex(m[0].replace("%", "")), range(m.start(), m.end()), m.end(), (3, 1), streams)


def _unicode(m: re.Match, streams: _Streams) -> _Hit:
    codes, begins, ends = array("q"), array("q"), array("q")
    for one in _ONE_UNICODE.finditer(m[0]):
        code = int(next(g for g in one.groups() if g), 16)
        if codes and 0xDC00 <= code < 0xE000 and 0xD800 <= codes[-1] < 0xDC00:
            codes[-1] = 0x10000 + ((codes[-1] - 0xD800) << 10) + code - 0xDC00
            ends[-1] = m.start() + one.end()
            continue
        codes.append(code)
        begins.append(m.start() + one.start())
        ends.append(m.start() + one.end())
    text = "".join(chr(code) if code <= 0x10FFFF else "\ufffd" for code in codes)
    return _Hit(m.start(), m.end(), text, _Units(begins, ends))


def _base64_at(text: str, spans: Sequence[tuple[int, int]], streams: _Streams) -> _Hit | None:
    """The base64 that the spans of ``text`` make up together."""
    token = "".join(text[b:e] for b, e in spans).rstrip("=").replace("-", "+").replace("_", "/")
    if len(token) % 4 == 1:
        # One character carries no byte: it belongs to what follows.
        token = token[:-1]
    try:
        data = base64.b64decode(token + "=" * (-len(token) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    at = range(*spans[0]) if len(spans) == 1 else _Joined(spans)
    return _hit(data, at, spans[-1][1], (4, 3), streams)


def _single(pattern: re.Pattern, decode: Callable) -> Callable:
    """Both passes over the runs of a pattern: those that are text throughout, and those that are text in part.

    They are kept apart, so a run that only looks coded does not hide the plain text beside another run.
    """

    def passes(text: str, streams: _Streams) -> Iterator[list[_Hit]]:
        whole, part = [], []
        for m in pattern.finditer(text):
            made = decode(m, streams)
            if made and made.text:
                (whole if _readable(made.text) else part).append(made)
        yield whole
        yield part

    return passes


def _shifted(text: str, streams: _Streams) -> Iterator[list[_Hit]]:
    """Base64 that begins inside a run: the alphabet holds letters and / - _ as well, so names and paths run into it.

    Three more alignments find every text, behind what its beginning decodes to; only those that show a stretch of text
    are followed. A compressed stream must be met at its first byte, so it is looked for behind every / - _ and at the
    alignments.
    """
    runs = [m.span() for m in _BASE64.finditer(text)]
    passes: list[list[_Hit]] = [[], [], []]
    for begin, end in runs:
        whole = _plain_bytes(text, begin, min(begin + 64, end))
        if whole.startswith(_PACKED) or _STRETCH.match(whole):
            # It begins where the run does, and was decoded there.
            continue
        starts = [begin + k for k in (1, 2, 3)]
        packed = [*starts, *(i + 1 for i in range(begin + 3, end - 16) if text[i] in "/-_")]
        packed = [i for i in packed if _plain_bytes(text, i, min(i + 16, end)).startswith(_PACKED)]
        # The letters of a compressed stream show text at other alignments only by chance.
        for start in packed or [i for i in starts if _STRETCH.search(_plain_bytes(text, i, end))]:
            made = _base64_at(text, [(start, end)], streams)
            if made and made.text:
                free = next((found for found in passes if not found or found[-1].end <= made.begin), None)
                if free is None:
                    passes.append(free := [])
                free.append(made)
    yield from (found for found in passes if found)


def _plain_bytes(text: str, start: int, end: int) -> bytes:
    token = text[start:end].rstrip("=").replace("-", "+").replace("_", "/")
    return base64.b64decode(token[: len(token) // 4 * 4])


def _wrapped(text: str, streams: _Streams) -> Iterator[list[_Hit]]:
    """Base64 over several lines of one width: with the shorter line after them, and without it.

    The line after the last full one may as well be other text.
    """
    blocks = []
    for m in _WRAPPED.finditer(text):
        lines: list = []
        for t in [*_TOKEN.finditer(text, m.start(), m.end()), None]:
            width = lines[0][1] - lines[0][0] if lines else 0
            full = t and not t[0].endswith("=") and t.end() - t.start()
            if t and lines and full == width:
                lines.append(t.span())
                continue
            tail = t and lines and t.end() - t.start() <= width
            if tail:
                blocks.append([*lines, t.span()])
            if len(lines) > 1:
                blocks.append(lines)
            lines = [t.span()] if full and full >= 16 else []
    passes: list[list[_Hit]] = []
    for spans in blocks:
        made = _base64_at(text, spans, streams)
        if made and made.text:
            free = next((found for found in passes if found[-1].end <= made.begin), None)
            if free is None:
                passes.append(free := [])
            free.append(made)
    yield from passes


_DECODERS = (
    ("%", _single(_PERCENT, _percent)),
    ("\\", _single(_UNICODE, _unicode)),
    ("", _single(_BASE64, lambda m, streams: _base64_at(m.string, [m.span()], streams))),
    ("", _shifted),
    ("\n", _wrapped),
)


def _decode_lines(layer: _Layer, found: list[_Hit]) -> Iterator[_Layer]:
    """A new layer for each line, or lines that one hit joins, in which something was decoded."""
    text, at, line_end = layer.text, 0, -1
    hits: list[_Hit] = []

    def built(first: int, last: int) -> _Layer:
        chars, here = [], first
        # Where all of it came from one span, so did what stands beside the hits.
        new = _Layer("", layer.depth + 1, layer) if not layer.span else _Layer("", layer.depth + 1, span=layer.span)
        for hit in hits:
            chars += [text[here : hit.begin], hit.text]
            if not new.span:
                new.add(hit.begin - here, here)
                new.add(len(hit.text), hit.places)
            here = hit.end
        chars.append(text[here:last])
        if not new.span:
            new.add(last - here, here)
        new.text = "".join(chars)
        new.first = new.start(0) if new.text else 0
        return new

    for hit in found:
        if hit.begin > line_end:
            if hits:
                yield built(at, line_end)
            hits = []
            at = text.rfind("\n", 0, hit.begin) + 1
        if hit.end > line_end:
            line_end = text.find("\n", hit.end)
            line_end = len(text) if line_end < 0 else line_end
        hits.append(hit)
        last = None
        for piece in hit.more:
            # The first piece stands with what is before it, the last one with what follows, the others alone.
            if last is None:
                yield built(at, hit.end)
            else:
                begin, end = layer.start(hit.begin), layer.end(hit.end - 1)
                yield _Layer(last, layer.depth + 1, span=(begin, end), first=begin)
            last = piece
        if last is not None:
            at = hit.begin
            hits = [_Hit(hit.begin, hit.end, last, hit.places)]
    if hits:
        yield built(at, line_end)


def scan_layers(text: str) -> tuple[list[tuple[int, int, int, int]], int]:
    """(start, kind number, end, depth) of all findings, plain ones at depth 0, and the number of damaged compressed streams.

    Of those everything before the damage is scanned.

    A finding that a layer repeats at the same place is reported once, at its smallest depth.
    """
    depths = {span: 0 for span in scan(text)}
    seen, streams = {_digest(text)}, _Streams()
    work = [_decoded(_Layer(text), streams)]
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        origin = (_digest(new.text), new.first)
        if origin in seen:
            continue
        seen.add(origin)
        work.append(_decoded(new, streams))
        for start, kind, end in scan(new.text):
            if new.decoded_in(start, end):
                span = (new.start(start), kind, new.end(end - 1))
                depths[span] = min(depths.get(span, new.depth), new.depth)
    return sorted((s, k, e, d) for (s, k, e), d in depths.items()), streams.closed()


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _decoded(layer: _Layer, streams: _Streams) -> Iterator[_Layer]:
    for mark, passes in _DECODERS:
        if mark in layer.text:
            for found in passes(layer.text, streams):
                yield from _decode_lines(layer, found)


def find_secrets(documents: DataFrame) -> DataFrame:
    """(doc_id, findings, n_closed) for each row of ``documents`` (doc_id, text).

    ``findings`` holds (kind, start, end, depth) by start, then kind as listed, then end; places count code points, the
    end is exclusive. Null and empty texts have no findings. Repeated rows give repeated results; other columns are
    ignored.
    """
    importable(documents.sparkSession)
    finding = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found, closed = [], []
            for text in batch.column("text").to_pylist():
                spans, left = scan_layers(text) if text else ([], 0)
                found.append([{"kind": KINDS[k], "start": s, "end": e, "depth": d} for s, k, e, d in spans])
                closed.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(finding)), pa.array(closed, pa.int32())],
                ["doc_id", "findings", "n_closed"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        run, "doc_id long, findings array<struct<kind string, start int, end int, depth int>>, n_closed int"
    )
