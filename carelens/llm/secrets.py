"""Secret scan with a worklist of decoded layers.

A text is the first layer. Each layer is scanned for the secret patterns, then
unwrapped: URL escapes and Unicode escapes give the layer's text again with the
escapes replaced; runs of base64 (also wrapped in lines, or glued to other
characters) give the decoded bytes, and compressed bytes (gzip, zlib, bzip2, xz,
zstandard; in base64 or written as URL or Unicode escapes) what they hold. New layers join the worklist
until it is empty. A digest of every layer seen (its text and the part of the
original it came from) keeps a layer from being worked on twice, so the loop ends
also on texts that decode to themselves, and repeated blocks are all worked on.
Every layer is worked on, readable or not: bytes that are not UTF-8 are read as
Latin-1. ``n_layers`` counts the text, and the layers that are readable or hold
a secret.

A layer knows which part of its parent each of its characters came from, so a
secret found three layers deep has a span in the original text: exact characters
for escapes, the four-character groups for base64, the whole run for compressed
data. Secrets of a layer that touch nothing decoded there were found in its
parent already and are not listed again.

Spans are ``kind:start:end`` (code points, end exclusive). The kind of a decoded
one carries its way down, e.g. ``assign/base64/url``. Of decoded spans of one kind
and way, those inside a longer one are not listed.

Defined cases: a null or empty text has no secrets. Repeated rows give repeated
results. Compressed data is unpacked to its end, all members of it, but never more
than ``max_unpacked`` bytes of it are held at once (a bomb may hold more than any
memory): it is worked on in pieces, each beginning with the last quarter of the one
before. What is longer than that quarter (16 MB) inside compressed data is seen in
parts: a longer secret as parts of it; of compressed data within longer base64
there, what one piece has of it. Damaged data gives what comes before the damage.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, partial
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
          "n_decoded long, n_layers long")
#: The patterns; the length a match (assign: its second group) must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16
KINDS = ("assign", "access", "hex")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\})+")
_UNICODE_ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}")
#: The same, each byte for itself: escapes of compressed data (some byte is not ASCII text); short ones of Python, C and JSON.
_URL_BINARY = re.compile(r"%[0189A-Fa-f][0-9A-Fa-f]")
_UNICODE_BINARY = re.compile(r"\\x[0189A-Fa-f]|\\u00[0189A-Fa-f]|\\u\{")
_FORM = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\+")
_SHORT = {"\\" + k: v for k, v in zip("abfnrtv0\\'\"/", "\a\b\f\n\r\t\v\0\\'\"/", strict=True)}
_ESCAPE = re.compile(rf"\\[abfnrtv0\\'\"/]|{_UNICODE.pattern}")
_BYTES = re.compile("[\0-\xff]+")
_CHAR, _END = "[A-Za-z0-9+/_-]", r"[ \t]*+(?:\r\n?|\n)[ \t]*+"
#: Base64, wrapped or not: lines of 16 and more characters; the first and the last may be shorter.
_BASE64 = re.compile(rf"(?<!{_CHAR})(?:{_CHAR}{{1,15}}+{_END})?{_CHAR}{{16,}}+(?:{_END}{_CHAR}{{16,}}+)*+(?:{_END}{_CHAR}{{1,15}}+)?={{0,2}}")
_LINE = re.compile(rf"{_CHAR}+={{0,2}}")
#: How compressed data begins: gzip, zlib, bzip2, xz, zstandard.
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01^\x9c\xda]|BZh[1-9](?:1AY&SY|\x17\x72\x45\x38\x50\x90)|\xfd7zXZ\x00"
                    rb"|\x28\xb5\x2f\xfd|[\x50-\x5f]\x2a\x4d\x18")
#: What "surrogateescape" makes of bytes that are not UTF-8, and their Latin-1 characters.
_LATIN = {0xDC00 + b: b for b in range(0x80, 0x100)}
MAX_UNPACKED = 1 << 26
#: Bytes of compressed data taken at a time, and of its output.
STEP, PART, ZSTD_STEP = 1 << 12, 1 << 20, 1 << 8


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain secrets of a text, sorted."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text and where it came from. This class is the original, or data that maps
    to one range ``at`` of its parent as a whole. ``data`` are the bytes of a text
    that was decoded from bytes."""

    def __init__(self, text: str, how: str = "", parent: Layer | None = None, at: tuple[int, int] = (0, 0), data: bytes | None = None):
        self.text, self.how, self.parent, self.at, self.data = text, how, parent, at, data

    def decoded(self, start: int, end: int) -> bool:
        return True

    def up(self, start: int, end: int) -> tuple[int, int]:
        """The range of the parent that a range of this text came from."""
        return self.at

    def to_root(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            start, end = layer.up(start, end)
            layer = layer.parent
        return start, end

    def way(self) -> str:
        layer, names = self, []
        while layer.parent is not None:
            names.append(layer.how)
            layer = layer.parent
        return "/".join(filter(None, names))      # data packed twice is one step


class Replaced(Layer):
    """A layer's text with its escapes decoded. ``pieces`` are (start here, start in
    the parent, length here, length there, decoded), in order and without gaps."""

    def __init__(self, text: str, how: str, parent: Layer, pieces: list[tuple[int, int, int, int, bool]]):
        super().__init__(text, how, parent)
        self.pieces, self.begins = pieces, [p[0] for p in pieces]

    def decoded(self, start: int, end: int) -> bool:
        k = max(0, bisect_right(self.begins, start) - 1)
        while k < len(self.pieces) and self.pieces[k][0] < end:
            if self.pieces[k][4]:
                return True
            k += 1
        return False

    def up(self, start: int, end: int) -> tuple[int, int]:
        a = self.pieces[bisect_right(self.begins, start) - 1]
        b = self.pieces[bisect_right(self.begins, end - 1) - 1]
        return a[1] if a[4] else a[1] + start - a[0], b[1] + b[3] if b[4] else b[1] + end - b[0]


class Run:
    """A run of base64, joined over line ends: its characters from ``first`` on are
    decoded. ``lines`` are the (start, end) of its lines in the text."""

    def __init__(self, text: str, lines: list[tuple[int, int]], first: int):
        self.starts, self.first = [a for a, _ in lines], first
        self.joined = [0, *accumulate(b - a for a, b in lines)]
        chars = "".join(text[a:b] for a, b in lines).rstrip("=")[first:].replace("-", "+").replace("_", "/")
        chars = chars[:len(chars) - (len(chars) % 4 == 1)]
        self.data = binascii.a2b_base64(chars + "=" * (-len(chars) % 4))

    def _place(self, k: int) -> int:
        line = min(bisect_right(self.joined, k), len(self.starts)) - 1
        return self.starts[line] + k - self.joined[line]

    def range(self, start: int, end: int) -> tuple[int, int]:
        """The range of the text that a range of the bytes came from: whole groups."""
        last = min(self.joined[-1], self.first + 4 * ((end - 1) // 3) + 4)
        return self._place(self.first + 4 * (start // 3)), self._place(last - 1) + 1


class Based(Layer):
    """The text of a base64 run."""

    def __init__(self, parent: Layer, run: Run):
        super().__init__(_text(run.data), "base64", parent, data=run.data)
        self.run = run

    @cached_property
    def offsets(self) -> Sequence[int]:
        """The byte that each character begins at, and the end."""
        if len(self.text) == len(self.data):
            return range(len(self.text) + 1)
        raw = self.data.decode("utf-8", "surrogateescape")
        return array("I", accumulate((len(c.encode("utf-8", "surrogateescape")) for c in raw), initial=0))

    def up(self, start: int, end: int) -> tuple[int, int]:
        return self.run.range(self.offsets[start], self.offsets[end])


def _replaced(layer: Layer, pattern: re.Pattern, decode, how: str) -> Layer | None:
    """The layer's text with each run of the pattern decoded, or None."""
    parts, pieces, at, done = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        chars = decode(m.group())
        if m.start() > done:
            pieces.append((at, done, m.start() - done, m.start() - done, False))
            parts.append(layer.text[done:m.start()])
            at += m.start() - done
        old = m.start()
        for char, width, decoded in chars:
            pieces.append((at, old, 1, width, decoded))
            parts.append(char)
            at, old = at + 1, old + width
        done = m.end()
    if not done:
        return None
    if done < len(layer.text):
        pieces.append((at, done, len(layer.text) - done, len(layer.text) - done, False))
        parts.append(layer.text[done:])
    return Replaced("".join(parts), how, layer, pieces)


Chars = list[tuple[str, int, bool]]


def _url_chars(run: str) -> Chars:
    """(character, its width in the run, whether it is decoded); bytes that are not
    UTF-8 are Latin-1."""
    text = bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")
    return [(c.translate(_LATIN), 3 * len(c.encode("utf-8", "surrogateescape")), True) for c in text]


def _url_bytes(run: str) -> Chars:
    """Each byte as its Latin-1 character; a plus (of a form) as a space."""
    return [(" ", 1, True)] if run == "+" else [(chr(b), 3, True) for b in bytes.fromhex(run.replace("%", ""))]


def _unicode_chars(run: str) -> Chars:
    """As ``_url_chars``; escapes that are no character stay."""
    out: list[tuple[int, str]] = []
    for m in _UNICODE_ONE.finditer(run):
        code, escape = int(m[1] or m[2] or m[3], 16), m[0]
        if 0xDC00 <= code < 0xE000 and out and 0xD800 <= out[-1][0] < 0xDC00:
            high, before = out.pop()
            code, escape = 0x10000 + ((high - 0xD800) << 10) + code - 0xDC00, before + escape
        out.append((code, escape))
    chars: Chars = []
    for code, escape in out:
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            chars += [(c, 1, False) for c in escape]
        else:
            chars.append((chr(code), len(escape), True))
    return chars


def _escaped_bytes(run: str) -> Chars:
    if (plain := _SHORT.get(run)) is not None:
        return [(plain, 2, True)]
    return _unicode_chars(run)


def _inflated(d, data: bytes, at: int) -> Iterator[bytes]:
    """zlib and gzip: one member, and (as the result) where it ends."""
    rest = b""
    while not d.eof and (rest or at < len(data)):
        if not rest:
            rest = data[at:at + STEP]
            at += len(rest)
        yield d.decompress(rest, PART)
        rest = d.unconsumed_tail
    if not d.eof:
        yield d.flush()
    return at - len(d.unused_data)


def _expanded(d, data: bytes, at: int) -> Iterator[bytes]:
    """bzip2 and xz."""
    while not d.eof and (not d.needs_input or at < len(data)):
        step = data[at:at + STEP] if d.needs_input else b""
        at += len(step)
        yield d.decompress(step, PART)
    return at - len(d.unused_data)


def _unframed(d, data: bytes, at: int) -> Iterator[bytes]:
    """zstandard, which has no bound for the output: a small input at a time."""
    while not d.eof and at < len(data):
        step = data[at:at + ZSTD_STEP]
        at += len(step)
        yield d.decompress(step)
    return at - len(d.unused_data)


def _unpacked(data: bytes, at: int) -> Iterator[bytes]:
    """What the compressed members (or frames) from ``at`` on hold, in parts of
    bounded size, and (as the result) where the last ends, or None if it is damaged."""
    while m := _MAGIC.match(data, at):
        kind = m[0][:2]
        try:
            if m[0][1:] == b"\x2a\x4d\x18":       # a zstandard frame to be skipped
                at = min(len(data), at + 8 + int.from_bytes(data[at + 4:at + 8], "little"))
            elif kind == b"\x1f\x8b":
                at = yield from _inflated(zlib.decompressobj(31), data, at)
            elif kind[:1] == b"x":
                at = yield from _inflated(zlib.decompressobj(), data, at)
            elif kind == b"BZ":
                at = yield from _expanded(bz2.BZ2Decompressor(), data, at)
            elif kind == b"\xfd7":
                at = yield from _expanded(lzma.LZMADecompressor(), data, at)
            else:
                at = yield from _unframed(zstandard.ZstdDecompressor().decompressobj(), data, at)
        except (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, ValueError):
            return None
        while data[at:at + 1] == b"\0":            # padding between members
            at += 1
    return at


def _measured(parts: Iterator[bytes]) -> tuple[int, int | None]:
    """(bytes, result) of parts."""
    size = 0
    while True:
        try:
            size += len(next(parts))
        except StopIteration as end:
            return size, end.value


def _pieces(parts: Iterator[bytes], most: int) -> Iterator[bytes]:
    """The parts as pieces of up to ``most`` bytes. Each begins with the last quarter of the one before."""
    held, new = bytearray(), 0
    for part in parts:
        held += part
        new += len(part)
        while len(held) >= most:
            yield bytes(held[:most])
            del held[:most - most // 4]
            new = len(held) - most // 4
    if new > 0:
        yield bytes(held)


def _text(data: bytes) -> str:
    """Bytes as text: UTF-8, and each byte that is not UTF-8 as its Latin-1 character."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("utf-8", "surrogateescape").translate(_LATIN)


def _readable(data: bytes) -> bool:
    """Whether bytes are plain text; layers that are not and hold no secret are not counted."""
    try:
        return data.translate(None, b"\t\n\r").decode("utf-8").isprintable()
    except UnicodeDecodeError:
        return False


def _packed(parent: Layer, data: bytes, place: Callable[[int, int], tuple[int, int]], most: int, how: str = "packed") -> Iterator[Layer]:
    """What the compressed data among the bytes holds; ``place`` gives the parent's range of a range of bytes."""
    at = 0
    while m := _MAGIC.search(data, at):
        start = at = m.start()
        size, end = _measured(_unpacked(data, start))
        for piece in _pieces(_unpacked(data, start), most) if size else ():
            yield Layer(_text(piece), how, parent, place(start, end or len(data)), piece)
        at = end or start + 1


def _runs(text: str) -> Iterator[Run]:
    """Every line of base64 from its start, and every block of lines from each of the
    four places where a group may begin: glued characters may stand before the data."""
    for m in _BASE64.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m.group())]
        if len(lines) > 1:
            yield from (Run(text, [(a, b)], 0) for a, b in lines if b - a >= 16)
        yield from (Run(text, lines, first) for first in range(4))


def _base64_layers(layer: Layer, most: int) -> Iterator[Layer]:
    for run in _runs(layer.text):
        yield Based(layer, run)
        yield from _packed(layer, run.data, run.range, most)


def _packed_views(layer: Layer, most: int) -> Iterator[Layer]:
    """What compressed data holds whose bytes are written as URL or Unicode escapes.
    Bytes that are letters stand in it as they are, so the whole text is read."""
    views = []
    if _URL_BINARY.search(layer.text):
        views.append(_replaced(layer, _URL, _url_bytes, "url"))
        if "+" in layer.text:
            views.append(_replaced(layer, _FORM, _url_bytes, "url"))
    if _UNICODE_BINARY.search(layer.text):
        views.append(_replaced(layer, _ESCAPE, _escaped_bytes, "unicode"))
    for view in filter(None, views):
        for m in _BYTES.finditer(view.text):
            yield from _packed(view, m[0].encode("latin-1"), lambda start, end, at=m.start(): (at + start, at + end), most)


def _children(layer: Layer, most: int) -> Iterator[Layer]:
    if layer.data is not None and layer.how in ("packed", ""):
        yield from _packed(layer, layer.data, lambda start, end: (0, len(layer.text)), most, "")
    for sign, pattern, decode, how in (("%", _URL, _url_chars, "url"), ("\\", _UNICODE, _unicode_chars, "unicode")):
        if sign in layer.text and (new := _replaced(layer, pattern, decode, how)):
            yield new
    yield from _packed_views(layer, most)
    yield from _base64_layers(layer, most)


def _outermost(spans: set[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Without the spans that lie inside a longer one of the same kind and way: a line of
    a block that is also decoded alone shows parts of the block's secrets."""
    out, reach = [], {}
    for start, kind, stop, how in sorted(spans, key=lambda x: (x[0], -x[2])):
        if stop > reach.get(how, -1):
            out.append((start, kind, stop, how))
            reach[how] = stop
    return sorted(out)


def scan(text: str | None, max_unpacked: int = MAX_UNPACKED):
    """(base matches, decoded spans, layers): all secrets of one text. Decoded
    spans are (start, kind number, end, kind with its way)."""
    root = Layer(text or "")
    base = base_matches(root.text)
    seen, extra, layers = set(), set(), 0
    work = [iter([root])]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        at = layer.to_root(0, len(layer.text)) if layer.text else ()
        content = layer.text.encode("utf-8", "surrogatepass") if layer.data is None else layer.data
        key = hashlib.blake2b(f"{at}".encode() + content).digest()
        if key in seen:
            continue
        seen.add(key)
        hits = base_matches(layer.text) if layer.parent is not None else []
        for start, kind, end in hits:
            if layer.decoded(start, end):
                a, b = layer.to_root(start, end)
                extra.add((a, kind, b, f"{KINDS[kind]}/{layer.way()}"))
        layers += layer.data is None or bool(hits) or _readable(layer.data)
        work.append(_children(layer, max_unpacked))
    return base, _outermost(extra), layers


def _scanned(batches: Iterator[pa.RecordBatch], max_unpacked: int) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base, extra, layers = scan(text, max_unpacked)
            plain = [(s, k, e, KINDS[k]) for s, k, e in base]
            digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in plain).encode()).hexdigest()
            spans = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(plain + extra, key=lambda x: (x[0], x[1], x[2], x[3])))
            rows.append((*(sum(k == i for _, k, _ in base) for i in range(3)), digest, spans, len(extra), layers))
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c)) for c in zip(*rows, strict=True))], names=names)


def scan_secrets(docs: DataFrame, max_unpacked: int = MAX_UNPACKED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of SCHEMA per row of docs."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        partial(_scanned, max_unpacked=max_unpacked), SCHEMA)
