"""Secret scans with a worklist of decoded layers.

A text is scanned for secrets; each encoded stretch in it (percent escapes, Unicode escapes, base64, and compressed
bytes below base64 or escapes) is unwrapped into a further layer, which is scanned and unwrapped in turn until no layer is new.
Layers are told apart by their place and a digest of their text, so that layers which unwrap into each other end. A match in a layer is
mapped to the stretch of the original text that it comes from: to the character for escapes, to the whole stretch for
base64 and compression.

Compressed bytes are opened whole up to ``EXPANDED`` bytes. Beyond, their stream is read in windows that overlap, so that
memory stays bounded and nothing is left closed: a match maps to the whole compressed stretch, so it is enough that one
window holds as much of it as the rules ask for, which ``OVERLAP`` is far above. Only an encoded stretch within such a
stream that is longer than a window is read in parts.

Base64 that follows a path or another word without a space is read from each of the four places where it can begin.
Escapes of escapes of a depth beyond ``CHAIN`` are taken off at once, so that nesting costs its length and not its square.

Defined results: null and empty texts have no spans; an empty table gives none; spans are code points, end exclusive;
equal spans found in several layers count once; repeated rows repeat their spans; texts of any length are scanned whole;
columns of the table besides the text come back inside ``doc``, whatever their names. Base64 is tried on stretches of 16
characters or more: the shortest secret takes 19.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+")
UNICODE_ONE = re.compile(r"\\u\{?([0-9A-Fa-f]+)\}?|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, as MIME and PEM wrap it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Stretches in which escapes stand for bytes, with characters that escaping leaves as they are.
PERCENT_BYTES = re.compile(r"[!-~]+")
UNICODE_BYTES = re.compile(r"[ -~]+")
BYTE_ONE = re.compile(r"\\u00([0-9A-Fa-f]{2})|\\u\{0{0,4}([0-9A-Fa-f]{1,2})\}|\\x([0-9A-Fa-f]{2})|\\([nrt0\\'\"])")
NAMED = {"n": 10, "r": 13, "t": 9, "0": 0, "\\": 92, "'": 39, '"': 34}
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
EXPANDED = 64 << 20
#: Bytes of a longer stream that are scanned together, and how many of them are scanned again with the next ones.
WINDOW = 16 << 20
OVERLAP = 1 << 20
#: Escapes of an escape character, one within the other.
CHAIN = 8
PERCENT_CHAIN = re.compile(r"%%(?:25){%d,}(?=[0-9A-Fa-f]{2})" % CHAIN)
UNICODE_CHAIN = re.compile(r"\\(?:u005[cC]|x5[cC]){%d,}(?=u[0-9A-Fa-f]{4}|u\{|x[0-9A-Fa-f]{2})" % CHAIN)
JOINTS = re.compile(r"[/_+-]")

Span = tuple[str, int, int]
Mapping = Callable[[int, int], tuple[int, int]]


def scan(text: str) -> list[Span]:
    """Base spans, leftmost and non-overlapping for each kind, by start and kind."""
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _pieced(text: str, pattern: re.Pattern, decode: Callable[[str], list[tuple[str, int]]]) -> tuple[str, Mapping] | None:
    """The text with each match decoded, and the way back. ``decode`` gives (characters, length of source) pairs."""
    out: list[str] = []
    new_at, old_at = [0], [0]  # where pieces begin, in the new and in the old text; within verbatim pieces both advance alike
    verbatim = [True]
    at = new = 0
    changed = False
    for m in pattern.finditer(text):
        parts = decode(m.group())
        if not parts:
            continue
        changed = True
        out.append(text[at : m.start()])
        new += m.start() - at
        old = m.start()
        for chars, length in parts:
            new_at.append(new), old_at.append(old), verbatim.append(False)
            out.append(chars)
            new, old = new + len(chars), old + length
        at = m.end()
        new_at.append(new), old_at.append(old), verbatim.append(True)
    if not changed:
        return None
    out.append(text[at:])
    old_at.append(len(text))

    def back(start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(new_at, start) - 1, bisect_right(new_at, end - 1) - 1
        return (old_at[i] + (start - new_at[i] if verbatim[i] else 0), old_at[j] + (end - new_at[j]) if verbatim[j] else old_at[j + 1])

    return "".join(out), back


def _percent(run: str) -> list[tuple[str, int]]:
    data = bytes.fromhex(run.replace("%", ""))
    try:
        return [(c, 3 * len(c.encode())) for c in data.decode()]
    except UnicodeDecodeError:
        return [(chr(b), 3) for b in data]


def _unicode(run: str) -> list[tuple[str, int]]:
    units = [(int(m[1] or m[2], 16), m.end() - m.start()) for m in UNICODE_ONE.finditer(run)]
    out: list[tuple[str, int]] = []
    k = 0
    while k < len(units):
        code, length = units[k]
        if 0xD800 <= code < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
            code, length, k = 0x10000 + ((code - 0xD800) << 10) + units[k + 1][0] - 0xDC00, length + units[k + 1][1], k + 1
        out.append((chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd", length))
        k += 1
    return out


def _opener(data: bytes):
    """A decompressor for the format that the bytes begin with, or None."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and int.from_bytes(data[:2]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _grown(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What all members or frames of a stream open to, one after the other, and what follows them; nothing if it begins with no known format. Of a broken member, what can be read."""
    rest, members = memoryview(b""), 0
    while True:
        while len(rest) < 8 and (more := next(chunks, b"")):
            rest = memoryview(bytes(rest) + more)
        opened = _opener(bytes(rest[:8]))
        if opened is None and members and (padded := bytes(rest[:1]) == b"\0" and bytes(rest).lstrip(b"\0")):  # members may be padded
            opened = _opener(padded)
            rest = memoryview(padded) if opened else rest
        if opened is None:
            if members:
                yield bytes(rest)
                yield from chunks
            return
        members += 1
        try:
            while not opened.eof:
                if not len(rest) and not len(rest := memoryview(next(chunks, b""))):
                    return
                piece, rest = rest[:1024], rest[1024:]  # few at a time: what came before an error stays, and what comes at once is bounded
                if made := opened.decompress(piece):
                    yield made
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError, zstandard.ZstdError):
            return
        rest = memoryview(opened.unused_data + bytes(rest)) if opened.unused_data else rest


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    held = bytearray()
    for c in chunks:
        held += c
        while len(held) >= WINDOW + OVERLAP:
            yield bytes(held[: WINDOW + OVERLAP])
            del held[:WINDOW]  # an even number, so that UTF-16 stays in step
    yield bytes(held)


def _texts(data: bytes) -> Iterator[str]:
    """The bytes as text: as UTF-8 or else byte by byte, for patterns of secrets are ASCII; with null bytes in them as UTF-16 too."""
    try:
        yield data.decode("utf-8-sig")
    except UnicodeDecodeError:
        yield data.decode("latin-1")
    if b"\0" in data:
        yield data.decode("utf-16-le", "replace")
        yield data.decode("utf-16-be", "replace")


def _opened(data: bytes) -> Iterator[bytes]:
    """Layers of compression directly within each other; a layer beyond ``EXPANDED`` bytes comes in windows."""
    seen: set[bytes] = set()
    layer, head = (lambda: iter((data,))), data[:8]
    while _opener(head) is not None:
        layer = lambda below=layer: _grown(below())
        whole, size, head, digest = [], 0, b"", hashlib.sha256()
        for piece in layer():
            digest.update(piece)
            size += len(piece)
            head = head if len(head) >= 8 else head + piece[:8]
            if size <= EXPANDED:
                whole.append(piece)
            else:
                whole.clear()
        if not size or digest.digest() in seen:
            return
        seen.add(digest.digest())
        if size <= EXPANDED:
            held = b"".join(whole)
            layer = lambda held=held: iter((held,))
            yield held
        else:
            yield from _windows(layer())


def _decoded(body: str) -> bytes:
    if len(body) % 4 == 1:
        body = body[:-1]  # one character holds no byte
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return b""


def _base64(stretch: str) -> Iterator[tuple[str, Callable[[int], int]]]:
    """(text, the way from a place in it to where its base64 begins in the stretch) of what a stretch holds, from its beginning or from a joint on."""
    plain = stretch.rstrip("=")
    body = plain.replace("-", "+").replace("_", "/")
    data = _decoded(body)
    for found in (data, *_opened(data)):
        for text in _texts(found):
            yield text, lambda _: 0
    joints = [m.end() for m in JOINTS.finditer(plain) if len(plain) - m.end() >= 16]
    for turn in range(4):
        places = [q for q in joints if q % 4 == turn]
        if not places:
            continue
        first = places[0]
        data = _decoded(body[first:])
        if turn:
            yield data.decode("latin-1"), lambda k, places=places, first=first: places[max(0, bisect_right(places, first + k * 4 // 3) - 1)]
        for q in places:
            at = (q - first) // 4 * 3
            if _opener(data[at : at + 8]) is not None:
                for inner in _opened(data[at:]):
                    for text in _texts(inner):
                        yield text, lambda _, q=q: q


def _byte_of(m: re.Match) -> str:
    return chr(NAMED[m[4]] if m[4] else int(m[1] or m[2] or m[3], 16))


def _escaped_bytes(text: str) -> Iterator[tuple[tuple[int, int], bytes]]:
    """(stretch, bytes) of escapes that stand for bytes of which some open a compressed stream, from there on."""
    held = []
    if "%" in text:
        held += [(m.span(), unquote_to_bytes(m.group())) for m in PERCENT_BYTES.finditer(text) if "%" in m.group()]
    if "\\u" in text or "\\x" in text:
        held += [(m.span(), BYTE_ONE.sub(_byte_of, m.group()).encode("latin-1")) for m in UNICODE_BYTES.finditer(text) if "\\u" in m.group() or "\\x" in m.group()]
    for at, data in held:
        for m in MAGIC.finditer(data):
            yield at, data[m.start() :]


def wrapped(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of base64 over several lines: each run of such lines, and in it lines of one length with the shorter one after them, for words may stand on the lines around."""
    for run in WRAPPED.finditer(text) if "\n" in text else ():
        lines = [m.span() for m in LINE.finditer(text, *run.span())]
        told = {run.span()}
        first = 0
        for k in range(1, len(lines) + 1):
            size = lines[first][1] - lines[first][0]
            now = lines[k][1] - lines[k][0] if k < len(lines) else 0
            if now == size:
                continue
            last = k if 0 < now < size else k - 1
            if last > first and size >= 16:
                told.add((lines[first][0], lines[last][1]))
            first = k
        yield from sorted(told)


def unwrap(text: str) -> Iterator[tuple[str, Mapping]]:
    """The layers directly below a text, each with the way from its spans to spans of the text."""
    if "%" in text and (layer := _pieced(text, PERCENT_CHAIN, lambda run: [("%", len(run))]) or _pieced(text, PERCENT, _percent)):
        yield layer
    if ("\\u" in text or "\\x" in text) and (layer := _pieced(text, UNICODE_CHAIN, lambda run: [("\\", len(run))]) or _pieced(text, UNICODE, _unicode)):
        yield layer
    for at, data in _escaped_bytes(text):
        for opened in _opened(data):
            for inner in _texts(opened):
                yield inner, lambda _, __, at=at: at
    for at in wrapped(text):
        for inner, _ in _base64("".join(LINE.findall(text, *at))):
            yield inner, lambda _, __, at=at: at
    for m in BASE64.finditer(text):
        for inner, begins in _base64(m.group()):
            yield inner, lambda start, _, at=m.span(), begins=begins: (at[0] + begins(start), at[1])


def to_source(ways: tuple[Mapping, ...], start: int, end: int) -> tuple[int, int]:
    for way in ways:
        start, end = way(start, end)
    return start, end


def deep_scan(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    base = scan(text)
    spans = set(base)
    seen = {((0, len(text)), hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())}
    work: list[tuple[Iterator[tuple[str, Mapping]], tuple[Mapping, ...]]] = [(unwrap(text), ())]
    while work:  # layers are made when their turn comes, so that one of each depth is held
        layers, ways = work[-1]
        if (found := next(layers, None)) is None:
            work.pop()
            continue
        inner, way = found
        back = (way, *ways)
        where = to_source(back, 0, len(inner))
        state = (where, hashlib.sha256(inner.encode("utf-8", "surrogatepass")).digest())
        if state in seen:
            continue
        seen.add(state)
        for kind, start, end in scan(inner):
            spans.add((kind, *to_source(back, start, end)))
        work.append((unwrap(inner), back))
    return base, in_order(spans)


def redact(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """The text with each stretch under spans replaced; overlapping spans are one stretch."""
    out, at = [], 0
    last = -1
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start < last:
            at = last = max(last, end)
            continue
        out += [text[at:start], mark]
        at = last = end
    return "".join([*out, text[at:]])


def _told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FIELDS = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())]


def scan_secrets(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """For each row: ``doc`` (a struct of the columns ``keep``, all by default), counts and digest of base spans, all ``spans`` and, with ``with_text``, ``redacted`` (null for a null text)."""
    rows = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("doc"), F.col(text_col).alias("text"))
    fields = FIELDS if with_text else FIELDS[:-1]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for value in batch.column("text"):
                text = value.as_py()
                base, spans = deep_scan(text or "")
                row = (*(sum(1 for s in base if s[0] == k) for k in KINDS), hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans))
                out.append((*row, text if text is None or not spans else redact(text, spans)) if with_text else row)
            columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True))], ["doc", *(n for n, _ in fields)])

    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType()}
    return rows.mapInArrow(batches, T.StructType([rows.schema["doc"], *(T.StructField(n, kinds[k]) for n, k in fields)]))
