"""Secret scans that look into nested encodings.

A worklist holds layers: the text itself, then whatever URL escapes, Unicode escapes, base64 and
compression unwrap to. Each layer is scanned and searched for further wrapped runs until none is
new; every layer keeps, for each of its characters, the span of the original text it stems from.
Bytes are inflated until no compressed stream is left, over all members, and are latin-1 if no UTF-8.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import urllib.parse
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sigloom.llm.common import with_arrow

# The base patterns, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

_UNICODE_ONE = re.compile(r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{2,7});|&#[xX]([0-9A-Fa-f]{2,6});")
_URL_ONE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t>]*[A-Za-z0-9+/_-]+)+={0,2}")
#: What ends a run with URL escapes: blanks, quotes, angle brackets, and a percent sign that starts none.
_URL_END = re.compile(r"[\s\"<>]|%(?![0-9A-Fa-f]{2})")
_BYTE_RUN = re.compile(r"(?:\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|x[\x01\x9c\xda])[\x00-\xff]+")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|x[\x01\x5e\x9c\xda]")
_PIECE, _OVERLAP = 1 << 16, 1 << 16
_DAMAGE = (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError, ValueError)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost non-overlapping within each kind, by start and kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], x[2]))
    return [(s, e, KINDS[k]) for s, e, k in found]


class _Source:
    """A readable over pieces of bytes; what is pushed is read first."""

    def __init__(self, pieces):
        self.pieces, self.held, self.broken = iter(pieces), b"", False

    def read(self, size: int = -1) -> bytes:
        while not self.held:
            got = next(self.pieces, None)
            if got is None:
                return b""
            self.held = got
        size = len(self.held) if size < 0 else size
        out, self.held = self.held[:size], self.held[size:]
        return out

    def push(self, data: bytes) -> None:
        self.held = data + self.held

    def kind(self) -> str | None:
        head = b""
        while len(head) < 6 and (more := self.read(_PIECE)):
            head += more
        self.push(head)
        return _kind(head)


def _kind(data: bytes) -> str | None:
    if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        return "zlib"
    heads = {b"BZh": "bz2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
    return next((k for h, k in heads.items() if data.startswith(h)), None)


def inflated(source: _Source) -> Iterator[bytes]:
    """What all members of a gzip, zlib, bzip2, xz or Zstandard stream hold, in pieces; a cut or damaged one as far as it goes.

    What follows the last member is left in ``source``, and so is what only looks like a member.
    """
    used = b""  # of a member that has given nothing yet

    def read() -> bytes:
        nonlocal used
        data = source.read(512)
        used = used + data if used is not None else None
        return data

    try:
        while kind := source.kind():
            used = b""
            if kind == "zstd":
                step = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
                while not step.eof and (data := read()):
                    if out := step.decompress(data):
                        used = None
                        yield out
                if not step.eof:
                    break
                source.push(step.unused_data)
                continue
            step, data = zlib.decompressobj(47) if kind == "zlib" else bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor(), b""
            while not step.eof:
                if not data and (kind == "zlib" or step.needs_input):
                    data = read()
                    if not data:
                        if kind == "zlib" and (out := step.flush()):
                            used = None
                            yield out
                        break
                if out := step.decompress(data, _PIECE):
                    used = None
                    yield out
                data = step.unconsumed_tail if kind == "zlib" else b""
            if not step.eof:
                break
            source.push(step.unused_data)
        else:
            return
    except _DAMAGE:
        pass
    source.broken = True
    source.push(used or b"")


def contents(data: bytes, most: int, took: list[int] | None = None) -> Iterator[bytes]:
    """What ``data`` holds once no compressed stream is left, and what stands behind inner streams.

    More than ``most`` bytes come in chunks that overlap, so memory stays bounded; a run without
    blanks and quotes is cut only if it is longer than half a chunk. ``took`` gets the bytes of ``data``
    that its own stream has, if they are known before the first chunk.
    """
    source, raw, tails = _Source([data]), data, []
    while source.kind():
        before, held, size = source, [], 0
        pieces = inflated(before)
        for piece in pieces:
            held.append(piece)
            size += len(piece)
            if size > most:
                break
        if not size and before.broken:  # only looks like a stream
            break
        if size <= most:
            if before.broken and raw is not None and raw is not data:
                yield raw
            rest = b"".join(iter(before.read, b""))
            if raw is data:
                if took is not None:
                    took.append(len(data) - len(rest))
            elif rest:
                yield from _chunks(_Source([rest]), most)
        elif raw is not data:
            tails.append(before)
        raw = b"".join(held) if size <= most else None
        source = _Source([raw] if raw is not None else chain(held, pieces))
    for x in (source, *reversed(tails)):
        yield from _chunks(x, most)


def _chunks(source: _Source, most: int) -> Iterator[bytes]:
    chunk = b""
    while piece := source.read():
        chunk += piece
        while len(chunk) > most:
            out = chunk[:most]
            edge = max(out.rfind(c, most // 2, most - min(_OVERLAP, most // 2)) for c in (b" ", b"\n", b'"', b"'", b">"))
            yield out
            chunk = chunk[edge + 1 if edge >= 0 else most - min(_OVERLAP, most // 2) :]
    if chunk:
        yield chunk


def _text(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _escapes(layer: str, one: re.Pattern, decode) -> tuple[str, np.ndarray, np.ndarray] | None:
    """``layer`` with all escapes decoded in place, and for each character the part of ``layer`` it stems from."""
    text, starts, ends, at = [], [], [], 0
    for m in one.finditer(layer):
        got = decode(m)
        if got is None:
            continue
        text.append(layer[at : m.start()])
        starts.extend(range(at, m.start()))
        ends.extend(range(at + 1, m.start() + 1))
        for ch, s, e in got:
            text.append(ch)
            starts.append(s)
            ends.append(e)
        at = m.end()
    text.append(layer[at:])
    starts.extend(range(at, len(layer)))
    ends.extend(range(at + 1, len(layer) + 1))
    out = "".join(text)
    return (out, np.array(starts, np.int64), np.array(ends, np.int64)) if out != layer else None


def _url(m: re.Match):
    """Characters of a run of escapes; bytes that are no UTF-8 are taken as latin-1."""
    out, at = [], m.start()
    for ch in urllib.parse.unquote_to_bytes(m[0]).decode("utf-8", "surrogateescape"):
        odd = 0xDC80 <= ord(ch) <= 0xDCFF
        n = 3 if odd else 3 * len(ch.encode())
        out.append((chr(ord(ch) - 0xDC00) if odd else ch, at, at + n))
        at += n
    return out


def _unicode(m: re.Match):
    if m.lastindex == 2:
        point = 0x10000 + ((int(m[1], 16) & 0x3FF) << 10 | int(m[2], 16) & 0x3FF)
        return [(chr(point), m.start(), m.end())]
    if m.lastindex > 5:
        got = html.unescape(m[0])
        return [(ch, m.start(), m.end()) for ch in got]
    point = int(m[m.lastindex], 16)
    return [(chr(point), m.start(), m.end())] if point <= 0x10FFFF and not 0xD800 <= point < 0xE000 else None


def _url_runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs that hold URL escapes, each looked at once."""
    at = 0
    for m in chain(_URL_END.finditer(text), [None]):
        end = m.start() if m else len(text)
        if text.find("%", at, end) >= 0:
            yield at, end
        at = m.end() if m else end


def unwrap(text: str, most: int):
    """(decoded, starts, ends) of what a layer unwraps to; starts and ends tell for each character its part of the layer.

    Escapes are decoded all over the layer, so that a keyword and its escaped value stay together.
    """
    if "%" in text and (got := _escapes(text, _URL_ONE, _url)):
        yield got
    if ("\\" in text or "&#" in text) and (got := _escapes(text, _UNICODE_ONE, _unicode)):
        yield got
    for m in chain(_BASE64.finditer(text), _WRAPPED.finditer(text)):
        run = np.array([m.start() + i for i, ch in enumerate(m[0]) if ch not in " \t\r\n>="], np.int64)
        run = run[: len(run) - (len(run) % 4 == 1)]
        letters = "".join(ch for ch in m[0] if ch not in " \t\r\n>=")[: len(run)]
        try:
            data = base64.b64decode(letters.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        out = _text(data)
        edge = np.cumsum([0, *(len(ch.encode()) for ch in out)]) if len(out) < len(data) else np.arange(len(data) + 1)
        yield out, run[edge[:-1] * 4 // 3], run[np.minimum(len(run), -(-edge[1:] * 4 // 3)) - 1] + 1
        if _kind(data):
            for part in contents(data, most):
                if part != data:
                    yield _whole(part, m.start(), m.end())
    if "%" in text:
        for start, end in _url_runs(text):
            data = urllib.parse.unquote_to_bytes(text[start:end])
            for at in _MAGIC.finditer(data):
                for part in contents(data[at.start() :], most):
                    if part != data[at.start() :]:
                        yield _whole(part, start, end)
    for m in _BYTE_RUN.finditer(text):
        data = m[0].encode("latin-1")
        for at in _MAGIC.finditer(data):
            took: list[int] = []
            for part in contents(data[at.start() :], most, took):
                if part != data[at.start() :]:
                    yield _whole(part, m.start() + at.start(), m.start() + at.start() + took[0] if took else m.end())


def _whole(data: bytes, start: int, end: int):
    """A layer of which all that is known is the run that it stems from."""
    out = _text(data)
    return out, np.broadcast_to(start, len(out)), np.broadcast_to(end, len(out))


def _placed(layers, starts, ends):
    """``layers`` of a layer with their spans in the original text."""
    for inner, a, b in layers:
        yield (inner, a, b) if starts is None or not inner else (inner, starts[a], ends[b - 1])


def scan(text: str, most: int = 16 << 20) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans of ``text``, and all spans with those of its unwrapped layers, in code points of ``text``.

    A layer that was met before (as an equal text at an equal place) is not queued again, so the
    worklist ends; one that inflates to more than ``most`` bytes is read in chunks, one at a time.
    """
    base = base_spans(text)
    spans, seen, work = set(base), set(), [iter([(text, None, None)])]
    while work:
        layer, starts, ends = next(work[-1], (None, None, None))
        if layer is None:
            work.pop()
            continue
        if starts is not None:
            if not layer:
                continue
            key = (hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(starts[0]), int(ends[-1]))
            if key in seen:
                continue
            seen.add(key)
            for s, e, kind in base_spans(layer):
                spans.add((int(starts[s]), int(ends[e - 1]), kind))
        work.append(_placed(unwrap(layer, most), starts, ends))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(spans, key=lambda x: (x[0], order[x[2]], x[1]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, text: str = "text", max_layer_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with ``base_spans`` and ``secret_spans``, arrays of (start, end, kind) over the whole text.

    A null or empty text has no spans; equal rows have equal spans each; an empty table stays empty.
    Spans are code points, end exclusive, by start and then kind;
    equal spans of several layers are one. Other columns pass through.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))

    def fn(texts):
        both = [scan(t or "", max_layer_bytes) for t in texts]
        return tuple([[{"start": s, "end": e, "kind": k} for s, e, k in x[i]] for x in both] for i in (0, 1))

    return with_arrow(docs, [text], [T.StructField("base_spans", span), T.StructField("secret_spans", span)], fn)


def base_digest(spans) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
