"""Media columns: payloads kept as baseline JPEG, read back as DC-only luminance thumbnails.

One payload byte is one 8 x 8 block of constant luminance: with a DC quantiser of 8 the quantised
DC coefficient is the byte less 128, so the thumbnail of DC values *is* the payload. A row of
64 blocks is one restart interval; a payload that needs more than 8191 rows goes on in a further
image right behind the first.

The reader takes any baseline image (Huffman, 8 bit, one interleaved scan): it parses the markers,
then decodes all restart intervals of a whole batch of images at once, one numpy lane for each
interval. AC coefficients are skipped, as DC alone makes the thumbnail.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sigloom.llm.common import utf8, with_arrow

UNIT = 64  # blocks in a row, and bytes that a payload is padded to a multiple of
MOST_ROWS = 65535 // 8
CHUNK_ROWS = 1 << 14

# The luminance DC code lengths of the JPEG standard, table K.3.
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
# One AC code: end of block, the single bit 0.
AC_BITS = (1, *[0] * 15)
AC_SYMBOLS = (0,)


def canonical(bits, symbols) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a Huffman table given by code counts for each length."""
    out, code, at = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((code, length, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _coded() -> tuple[np.ndarray, np.ndarray]:
    """By DC difference (from -255): the bits of its code, extra bits and end of block, and how many they are."""
    dc = {s: (code, length) for code, length, s in canonical(DC_BITS, DC_SYMBOLS)}
    bits, lengths = [], []
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, length = dc[size]
        low = diff if diff >= 0 else diff + (1 << size) - 1
        bits.append(((code << size) | low) << 1)
        lengths.append(length + size + 1)
    return np.array(bits, np.uint64), np.array(lengths, np.uint64)


_BITS, _LENGTHS = _coded()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int) -> bytes:
    """All markers ahead of the entropy-coded data of an image of ``rows`` rows of 64 blocks."""
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + bytes([8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, UNIT * 8, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + bytes(DC_BITS) + bytes(DC_SYMBOLS)),
        _segment(0xC4, b"\x10" + bytes(AC_BITS) + bytes(AC_SYMBOLS)),
        _segment(0xDD, struct.pack(">H", UNIT)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def _entropy(rows: np.ndarray, marker: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Coded bytes of rows of samples, each followed by its restart marker (-1: none), and where each row ends."""
    v = rows.astype(np.int16)
    diff = np.empty(v.shape, np.intp)
    diff[:, 0] = v[:, 0] + 127  # the difference to 0 after the level shift, from -255
    np.subtract(v[:, 1:], v[:, :-1], out=diff[:, 1:], casting="unsafe")
    diff[:, 1:] += 255
    word, length = _BITS.take(diff), _LENGTHS.take(diff)
    for _ in range(2):  # four codes of at most 15 bits make one of at most 60
        word = (word[:, ::2] << length[:, 1::2]) | word[:, 1::2]
        length = length[:, ::2] + length[:, 1::2]
    end = np.cumsum(length, axis=1)
    cells = np.zeros((len(rows), 17), np.uint64)
    every = np.arange(len(rows))
    for k in range(word.shape[1]):
        at = end[:, k] - length[:, k]
        inside, cell = at & np.uint64(63), (at >> np.uint64(6)).astype(np.intp)
        top = word[:, k] << (np.uint64(64) - length[:, k])
        cells[every, cell] |= top >> inside
        cells[every, cell + 1] |= np.where(inside > 0, top << ((np.uint64(64) - inside) & np.uint64(63)), np.uint64(0))
    end = end[:, -1].astype(np.int64)
    width = (end + 7) >> 3
    base = np.concatenate(([0], np.cumsum(width)))
    n = int(base[-1])
    data = cells.astype(">u8").view(np.uint8).reshape(len(rows), -1)
    data = data[np.arange(data.shape[1]) < width[:, None]]
    data[base[1:] - 1] |= ((1 << ((-end) & 7)) - 1).astype(np.uint8)
    full = data == 0xFF
    shift = np.cumsum(full) - full  # stuffed zeros ahead of each byte
    behind = 2 * (marker >= 0)
    gap = np.cumsum(behind) - behind
    place = np.arange(n) + shift + np.repeat(gap, width)
    stuffed = np.add.reduceat(full, base[:-1]).astype(np.int64)
    ends = np.cumsum(width + stuffed + behind)
    out = np.zeros(int(ends[-1]), np.uint8)
    out[place] = data
    has = np.flatnonzero(marker >= 0)
    out[ends[has] - 2], out[ends[has] - 1] = 0xFF, 0xD0 + marker[has]
    return out.tobytes(), ends


def encode(payloads: list[bytes]) -> list[bytes]:
    """JPEG bytes of each payload (each a positive multiple of 64 bytes)."""
    counts = [len(p) // UNIT for p in payloads]
    within = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    total = np.repeat(counts, counts)
    frame = within % MOST_ROWS
    marker = np.where((frame == MOST_ROWS - 1) | (within == total - 1), -1, frame % 8)
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    parts, ends, done = [], [], 0
    for i in range(0, len(rows), CHUNK_ROWS):
        data, end = _entropy(rows[i : i + CHUNK_ROWS], marker[i : i + CHUNK_ROWS])
        parts.append(data)
        ends.append(end + done)
        done += len(data)
    data, ends = b"".join(parts), np.concatenate([[0], *ends]).astype(np.int64)
    out, row = [], 0
    for c in counts:
        image = []
        for i in range(0, c, MOST_ROWS):
            n = min(MOST_ROWS, c - i)
            image += [header(n), data[ends[row + i] : ends[row + i + n]], b"\xff\xd9"]
        out.append(b"".join(image))
        row += c
    return out


# --- reader ----------------------------------------------------------------------------------


@dataclass
class Scan:
    """One baseline image: its size, tables and entropy-coded bytes."""

    width: int
    height: int
    parts: tuple  # (id, h, v, quantiser) for each component in scan order
    dc: tuple  # DC table (bits, symbols) for each component in scan order
    ac: tuple
    interval: int
    data: bytes


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)


def parse(media: bytes) -> list[Scan]:
    """The images in ``media``, one behind the other; ValueError for a wrong marker, a short segment or a missing table."""
    try:
        return _images(media)
    except (KeyError, IndexError, struct.error) as wrong:
        raise ValueError(f"a segment is short or a table is missing: {wrong}") from wrong


def _images(media: bytes) -> list[Scan]:
    at, out = 0, []
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at, quant, tables, frame, interval = at + 2, {}, {}, None, 0
        while True:
            if at + 4 > len(media) or media[at] != 0xFF:
                raise ValueError("a marker is missing")
            kind, (size,) = media[at + 1], struct.unpack(">H", media[at + 2 : at + 4])
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                i = 0
                while i < len(body):
                    wide, k = body[i] >> 4, body[i] & 15
                    quant[k] = int.from_bytes(body[i + 1 : i + 2 + wide], "big")
                    i += 1 + 64 * (1 + wide)
            elif kind == 0xC4:
                i = 0
                while i < len(body):
                    bits = tuple(body[i + 1 : i + 17])
                    n = sum(bits)
                    tables[body[i]] = (bits, tuple(body[i + 17 : i + 17 + n]))
                    i += 17 + n
            elif kind == 0xC0:
                depth, height, width, n = struct.unpack(">BHHB", body[:6])
                if depth != 8:
                    raise ValueError("only 8-bit samples")
                frame = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif kind == 0xDD:
                (interval,) = struct.unpack(">H", body)
            elif kind == 0xDA:
                break
        if frame is None or body[0] != len(frame):
            raise ValueError("one scan with all components is asked for")
        order = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
        stop = _SCAN_END.search(media, at)
        if not stop:
            raise ValueError("no end of scan")
        if media[stop.start() + 1] != 0xD9:
            raise ValueError("more than one scan")
        out.append(Scan(
            width, height,
            tuple((c, frame[c][0], frame[c][1], quant[frame[c][2]]) for c, _ in order),
            tuple(tables[t >> 4] for _, t in order), tuple(tables[16 + (t & 15)] for _, t in order),
            interval, media[at : stop.start()],
        ))
        at = stop.end()
    return out


_LOOKUPS: dict = {}
_MOST_LOOKUPS = 64  # a megabyte each


def _lookup(table, dc: bool) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: bits used (0: invalid), and the symbol; for DC symbols the code's length alone."""
    if (table, dc) not in _LOOKUPS:
        if len(_LOOKUPS) >= _MOST_LOOKUPS:
            _LOOKUPS.clear()
        used, symbol = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
        for code, length, s in canonical(*table):
            low = code << (16 - length)
            used[low : low + (1 << (16 - length))] = length
            symbol[low : low + (1 << (16 - length))] = s
        _LOOKUPS[table, dc] = used, symbol
    return _LOOKUPS[table, dc]


def _whole_units(dc, ac) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: the bits of a DC code, its extra bits and an end of block (0: they don't fit), and the difference."""
    if (dc, ac) not in _LOOKUPS:
        used, size = _lookup(dc, True)
        every = np.arange(65536)
        left = 16 - used - size
        fits = (used > 0) & (left > 0)
        raw = (every >> np.maximum(left, 0)) & ((1 << size) - 1)
        diff = np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)
        skip, run = _lookup(ac, False)
        rest = (every << np.minimum(used + size, 16)) & 0xFFFF
        fits &= (skip[rest] > 0) & (skip[rest] <= left) & (run[rest] == 0)
        _LOOKUPS[dc, ac] = np.where(fits, used + size + skip[rest], 0), diff
    return _LOOKUPS[dc, ac]


def _lanes(scans: list[Scan]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all scans without stuffing and markers, where each interval starts and ends, and intervals for each scan."""
    data = np.frombuffer(b"".join(s.data + b"\x00\x00" for s in scans), np.uint8)
    full = np.flatnonzero(data == 0xFF)
    after = data[full + 1]
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(data), bool)
    keep[full[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    place = np.cumsum(keep) - keep
    ends = np.cumsum([len(s.data) + 2 for s in scans])
    begins = ends - np.array([len(s.data) + 2 for s in scans])
    starts = np.sort(np.concatenate((begins, marks + 2)))
    owner = np.searchsorted(begins, starts, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(starts, begins)[owner]
    inner = number > 0
    if np.any((number[inner] - 1) % 8 != data[starts[inner] - 1] - 0xD0):
        raise ValueError("restart markers out of order")
    stops = np.sort(np.concatenate((ends - 2, marks)))
    return data[keep], place[starts], place[stops], np.bincount(owner, minlength=len(scans))


def thumbnails(scans: list[Scan]) -> list[np.ndarray]:
    """For each image the uint8 array of its luminance DC values, one for each 8 x 8 block."""
    groups = defaultdict(list)
    for i, s in enumerate(scans):
        groups[s.parts, s.dc, s.ac, s.interval].append(i)
    out: list = [None] * len(scans)
    for (parts, dc, ac, interval), at in groups.items():
        own = [scans[i] for i in at]
        hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
        single = len(parts) == 1  # one component alone is never interleaved
        across = [-(-s.width // (8 if single else 8 * hmax)) for s in own]
        down = [-(-s.height // (8 if single else 8 * vmax)) for s in own]
        units = np.array([a * d for a, d in zip(across, down, strict=True)])
        data, starts, stops, lanes = _lanes(own)
        per = np.where(interval, interval, units)
        if np.any(lanes != -(-units // per)):
            raise ValueError("the number of restart intervals is wrong")
        owner = np.repeat(np.arange(len(own)), lanes)
        number = np.arange(len(owner)) - (np.cumsum(lanes) - lanes)[owner]
        todo = np.minimum(per[owner], units[owner] - number * per[owner])
        blocks = 1 if single else parts[0][1] * parts[0][2]
        values = _decode(data, starts, stops, todo, parts, dc, ac, single)
        scaled = np.clip((values.astype(np.int32) * parts[0][3] + 4) // 8 + 128, 0, 255).astype(np.uint8)
        first = np.cumsum(lanes) - lanes
        for k, i in enumerate(at):
            rows = scaled[first[k] : first[k] + lanes[k]]
            if int(todo[first[k] : first[k] + lanes[k]].min()) == rows.shape[1]:
                flat = rows.reshape(-1, blocks)
            else:
                flat = np.concatenate([r[: todo[first[k] + j]] for j, r in enumerate(rows)]).reshape(-1, blocks)
            if single:
                out[i] = flat.reshape(down[k], across[k])
            else:
                h, v = parts[0][1], parts[0][2]
                grid = flat.reshape(down[k], across[k], v, h).transpose(0, 2, 1, 3).reshape(down[k] * v, across[k] * h)
                out[i] = grid[: -(-own[k].height // 8), : -(-own[k].width // 8)]
    return out


def _decode(data, starts, stops, todo, parts, dc, ac, single) -> np.ndarray:
    """Accumulated luminance DC values: lane x unit (x block)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.int64)
    word = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    limit = len(data) * 8
    bit = starts.astype(np.int64) << 3
    most = int(todo.max())
    lum = 1 if single else parts[0][1] * parts[0][2]
    out = np.zeros((most, lum, len(starts)), np.int16)
    last = np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    same = int(todo.min()) == most

    def peek(at):
        return (word.take(at >> 3) >> (16 - (at & 7))) & 0xFFFF

    simple = len(parts) == 1 and same
    whole, jump = _whole_units(dc[0], ac[0]) if simple else (None, None)
    for unit in range(most):
        if simple:
            next16 = peek(bit)
            length = whole.take(next16)
            if length.all():
                last += jump.take(next16)
                bit += length
                out[unit, 0] = last
                continue
        if not same:
            live = np.flatnonzero(todo > unit)
        for c, (_, h, v, _) in enumerate(parts):
            used, symbol = _lookup(dc[c], True)
            skip, run = _lookup(ac[c], False)
            for block in range(1 if single else h * v):
                at = bit if same else bit[live]
                next16 = peek(at)
                length, size = used[next16], symbol[next16]
                if not length.all() or at.max() > limit:
                    raise ValueError("a code that the table doesn't have")
                at = at + length
                raw = (word.take(at >> 3) >> (32 - (at & 7) - size)) & ((1 << size) - 1)
                at += size
                if c == 0:
                    diff = np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)
                    last[live] += diff
                    out[unit, block, live] = last[live]
                # AC: run-length codes up to the end of the block
                next16 = peek(at)
                length, code = skip[next16], run[next16]
                if not length.all():
                    raise ValueError("a code that the table doesn't have")
                at += length
                if code.any():
                    at += code & 15
                    k = np.where(code == 0, 64, (code >> 4) + 1)
                    open_ = np.flatnonzero(k < 63)
                    while len(open_):
                        next16 = peek(at[open_])
                        length, code = skip[next16], run[next16]
                        if not length.all() or at.max() > limit:
                            raise ValueError("a code that the table doesn't have")
                        at[open_] += length + (code & 15)
                        k[open_] = np.where(code == 0, 64, k[open_] + (code >> 4) + 1)
                        open_ = open_[k[open_] < 63]
                if same:
                    bit = at
                else:
                    bit[live] = at
    if np.any(bit > stops << 3):
        raise ValueError("the scan is too short")
    return out.transpose(2, 0, 1)


# --- columns ---------------------------------------------------------------------------------


def pad(text: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: over an 8 x 9 grid of mean luminance, whether a cell is darker than its right neighbour."""
    r = np.arange(8) * thumb.shape[0] // 8
    c = np.arange(9) * thumb.shape[1] // 9
    grid = np.add.reduceat(np.add.reduceat(thumb, r, axis=0, dtype=np.int64), c, axis=1)
    n = np.maximum(np.diff(c, append=thumb.shape[1]), 1)
    darker = grid[:, :-1] * n[1:] < grid[:, 1:] * n[:-1]
    return int.from_bytes(np.packbits(darker).tobytes(), "big")


def to_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with the JPEG of its texts in ``media`` and their unpadded length in ``n_bytes``.

    A null or empty text is 64 zero bytes. Other columns pass through.
    """
    def fn(texts):
        raw = utf8(texts)
        return encode([pad(x) for x in raw]), [len(x) for x in raw]

    return with_arrow(docs, [text], [T.StructField(media, T.BinaryType()), T.StructField("n_bytes", T.LongType())], fn, 1 << 20)


def thumbnail_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """What the stored images hold, read back from their bytes: sizes, hashes, and the payload.

    ``images``: array of (width, height, thumbnail SHA-256); ``payload``: the thumbnails' bytes.
    A null media is no image and an empty payload. Wrong bytes raise ValueError.
    """
    image = T.ArrayType(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("thumb_sha256", T.StringType())]))
    fields = [T.StructField(n, k) for n, k in (("images", image), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]

    def fn(stored):
        found = [parse(m) if m else [] for m in stored]
        thumbs = iter(thumbnails([s for scans in found for s in scans]))
        rows = []
        for m, scans in zip(stored, found, strict=True):
            own = [next(thumbs) for _ in scans]
            blobs = [t.tobytes() for t in own]
            payload = b"".join(blobs)
            feature = ";".join(f"{s.width}x{s.height}:{difference_hash(t):016x}" for s, t in zip(scans, own, strict=True))
            images = [{"width": s.width, "height": s.height, "thumb_sha256": hashlib.sha256(b).hexdigest()} for s, b in zip(scans, blobs, strict=True)]
            rows.append((images, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m or b""), hashlib.sha256(m or b"").hexdigest(), feature))
        return list(map(list, zip(*rows, strict=True))) if rows else [[] for _ in fields]

    return with_arrow(df, [media], fields, fn, 2 << 20)
