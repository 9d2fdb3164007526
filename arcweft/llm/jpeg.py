"""Media columns: baseline JPEG files written, read back and described without an image library.

A payload of bytes is stored losslessly in the quantised coefficients of a baseline file: three components
without subsampling have 3 x 64 coefficients in a unit, so a unit carries 192 bytes.  Reading parses the
markers, Huffman-decodes the scan and rebuilds the luminance at an eighth of the size from the DC
coefficients alone.  Every unit is a restart interval, hence all intervals of all files of a batch are
decoded in step by numpy; memory is bounded by the chunk of files in hand.

Edge cases: a null text is the empty text and stores 192 blanks; texts of any length up to 65 535 x 65 535
pixels are stored whole; equal texts give equal files and features; an empty table gives an empty result.  Files
that ``describe_media`` can't read (null, damaged, not baseline, with subsampled components) get ``readable`` false
and nulls, and cost no other file its row.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, free_names

UNIT = 192
#: Units in a row of the picture.
COLUMNS = 64
#: Symbols of both Huffman tables, in code order; all have four-bit codes.
SYMBOLS = np.arange(12, dtype=np.uint8)
CODE_BITS = 4


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int, cols: int, length: int) -> bytes:
    quant = b"".join(_segment(0xDB, bytes([i]) + b"\x01" * 64) for i in range(2))
    frame = _segment(0xC0, b"\x08" + (rows * 8).to_bytes(2, "big") + (cols * 8).to_bytes(2, "big") + b"\x03\x01\x11\x00\x02\x11\x01\x03\x11\x01")
    counts = bytes([0, 0, 0, len(SYMBOLS)] + [0] * 12)
    tables = b"".join(_segment(0xC4, bytes([c << 4]) + counts + SYMBOLS.tobytes()) for c in range(2))
    return b"\xff\xd8" + _segment(0xFE, b"payload %d" % length) + quant + frame + tables + _segment(0xDD, b"\x00\x01") + _segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00")


_VALUES = np.where(np.arange(256) < 128, np.arange(256) - 128, np.arange(256) - 127)  # never 0: no runs of zeros
_SIZES = np.array([int(abs(v)).bit_length() for v in _VALUES], np.int64)
_BITS = np.where(_VALUES < 0, _VALUES + (1 << _SIZES) - 1, _VALUES)
_CODE = ((_SIZES << _SIZES) | _BITS).astype(np.uint64)  # four-bit code of the size, then the size's bits
_LEN = (CODE_BITS + _SIZES).astype(np.int64)


def grid(units: int) -> tuple[int, int]:
    """Rows and columns of units for a picture that holds so many."""
    cols = COLUMNS if units <= COLUMNS * 8191 else 8191
    cols = min(units, cols)
    return -(-units // cols), cols


def encode(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG file for each payload (lengths are positive multiples of 192)."""
    shapes = [grid(len(p) // UNIT) for p in payloads]
    data = b"".join(p + b" " * (r * c * UNIT - len(p)) for p, (r, c) in zip(payloads, shapes, strict=True))
    unit = np.frombuffer(data, np.uint8).reshape(-1, UNIT).T
    n = unit.shape[1]
    words = np.zeros((n, 76), np.uint32)  # 192 symbols of 12 bits at most are 72 words
    acc, held, at = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    every = np.arange(n)
    for k in range(UNIT):
        b = unit[k]
        size = _LEN[b]
        acc = (acc << size.astype(np.uint64)) | _CODE[b]
        held += size
        full = np.flatnonzero(held >= 32)
        if len(full):
            held[full] -= 32
            words[every[full], at[full]] = (acc[full] >> held[full].astype(np.uint64)).astype(np.uint32)
            at[full] += 1
            acc[full] &= (np.uint64(1) << held[full].astype(np.uint64)) - np.uint64(1)
    left = (32 - held).astype(np.uint64)
    words[every, at] = ((acc << left) | ((np.uint64(1) << left) - np.uint64(1))).astype(np.uint32)  # padded with ones
    raw = words.astype(">u4").view(np.uint8).reshape(n, -1)
    size = at * 4 + -(-held // 8)
    stuffed = raw == 0xFF
    used = np.arange(raw.shape[1])[None, :] < size[:, None]
    out, first = [], 0
    for p, (r, c) in zip(payloads, shapes, strict=True):
        rows = slice(first, first + r * c)
        first += r * c
        # data bytes, a zero behind every FF, and a restart marker behind every unit but the last
        m = used[rows]
        flat = raw[rows][m]
        extra = stuffed[rows][m]
        ends = np.cumsum(size[rows])
        pos = np.arange(len(flat)) + np.cumsum(extra) - extra
        unit_of = np.repeat(np.arange(r * c), size[rows])
        pos += 2 * unit_of
        total = len(flat) + int(extra.sum()) + 2 * (r * c - 1)
        buf = np.zeros(total, np.uint8)
        buf[pos] = flat
        marks = (pos[ends - 1] + 1 + extra[ends - 1])[:-1]
        buf[marks] = 0xFF
        buf[marks + 1] = 0xD0 + np.arange(r * c - 1) % 8
        out.append(_header(r, c, len(p)) + buf.tobytes() + b"\xff\xd9")
    return out


class Picture:
    """What the markers of a file say, and where its scan lies."""

    def __init__(self, file: bytes):
        if file[:2] != b"\xff\xd8":
            raise ValueError("no JPEG file")
        self.comment, self.interval, self.tables, self.quant, self.spec, at = b"", 0, {}, {}, b"", 2
        while True:
            marker, size = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
            body = file[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC0:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.components = [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(body[5])]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline file")
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                self.spec += body
                while body:
                    counts, n = body[1:17], sum(body[1:17])
                    self.tables[body[0]] = self._lookup(counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                self.scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        if any(c[1] != 0x11 for c in self.components):
            raise ValueError("subsampled components are not read")
        self.start = at
        self.rows, self.cols = -(-self.height // 8), -(-self.width // 8)

    @staticmethod
    @lru_cache(64)
    def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
        """By the next 16 bits: the code's length times 256 plus its symbol; 0 where there is no code."""
        look, code, k = np.zeros(1 << 16, np.int32), 0, 0
        for bits in range(1, 17):
            for _ in range(counts[bits - 1]):
                look[code << (16 - bits) : (code + 1) << (16 - bits)] = bits * 256 + symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        return look


def decode(files: list[bytes]) -> list[tuple[Picture, np.ndarray]]:
    """Of each file: what its markers say, and its coefficients as (unit, component, 64) in zigzag order.

    All restart intervals of all files that share their Huffman tables and the length of an interval advance
    together, a symbol a step.  A file that can't be read raises ValueError.
    """
    pictures = [Picture(f) for f in files]
    out: list = [None] * len(files)
    groups: dict[bytes, list[int]] = {}
    for i, p in enumerate(pictures):
        key = p.spec + bytes(x for c in p.components for x in (c[0], p.scan[c[0]])) + b"%d" % (p.interval or p.rows * p.cols)
        groups.setdefault(key, []).append(i)
    for members in groups.values():
        pieces, lengths, owner, units = [], [], [], []
        for i in members:
            p = pictures[i]
            data = np.frombuffer(files[i], np.uint8)[p.start : -2]
            ff = np.flatnonzero(data[:-1] == 0xFF)
            follow = data[ff + 1]
            marks = ff[(follow >= 0xD0) & (follow <= 0xD7)]
            drop = np.zeros(len(data), bool)
            drop[ff[follow == 0] + 1] = True
            drop[marks] = drop[marks + 1] = True
            bounds = np.concatenate([[0], marks, [len(data)]])
            kept = np.concatenate([[0], np.cumsum(~drop)])
            pieces.append(data[~drop])
            lengths.append(kept[bounds[1:]] - kept[bounds[:-1]])
            total = p.rows * p.cols
            each = p.interval or total
            owner.append(np.full(len(bounds) - 1, i))
            units.append(np.minimum(each, total - each * np.arange(len(bounds) - 1)))
        stream = np.concatenate([*pieces, np.full(8, 0xFF, np.uint8)])
        length, owner, units = np.concatenate(lengths), np.concatenate(owner), np.concatenate(units)
        pos = (np.cumsum(length) - length).astype(np.int64) * 8
        p = pictures[members[0]]
        parts = len(p.components)
        look = [(p.tables[p.scan[c[0]] >> 4], p.tables[16 + (p.scan[c[0]] & 15)]) for c in p.components]
        coefs = np.zeros((len(length), int(units.max()), parts, 64), np.int16)
        wide = (stream[:-3].astype(np.uint32) << 24) | (stream[1:-2].astype(np.uint32) << 16) | (stream[2:-1].astype(np.uint32) << 8) | stream[3:]

        def take(rows, table):
            at = pos[rows]
            byte = at >> 3
            window = (wide[byte] << (at & 7).astype(np.uint32)) >> np.uint32(16)
            code = table[window]
            if not code.all():
                raise ValueError("damaged scan")
            at = at + (code >> 8)
            symbol = code & 255
            size = symbol & 15
            byte = at >> 3
            window = (wide[byte] << (at & 7).astype(np.uint32)) >> np.uint32(16)
            bits = (window >> (16 - size).astype(np.uint32)).astype(np.int64)
            value = np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)
            pos[rows] = at + size
            return symbol >> 4, size, value

        for u in range(int(units.max())):
            active = np.flatnonzero(units > u)
            for c in range(parts):
                _, _, diff = take(active, look[c][0])
                coefs[active, u, c, 0] = diff + (coefs[active, u - 1, c, 0] if u else 0)
                rows, k = active, np.ones(len(active), np.int64)
                while len(rows):
                    run, size, value = take(rows, look[c][1])
                    if not run.any() and size.all():  # the usual step: no run of zeros and no end of block
                        coefs[rows, u, c, k] = value
                        k = k + 1
                        if k[0] == 64 and (k == 64).all():
                            break
                        more = k < 64
                    else:
                        put = (size > 0) & (k + run < 64)
                        coefs[rows[put], u, c, (k + run)[put]] = value[put]
                        k = np.where(size > 0, k + run + 1, np.where(run == 15, k + 16, 64))
                        more = k < 64
                    if not more.all():
                        rows, k = rows[more], k[more]
        first = 0
        for i in members:
            own = int((owner == i).sum())
            block = coefs[first : first + own].reshape(-1, parts, 64)
            if own * coefs.shape[1] != pictures[i].rows * pictures[i].cols:
                block = np.concatenate([coefs[first + j, : units[first + j]] for j in range(own)])
            out[i] = (pictures[i], block)
            first += own
    return out


def readable(files: list[bytes]) -> list[tuple[Picture, np.ndarray] | None]:
    """Like ``decode``, with None for the files that can't be read: a list with one is halved until it stands alone."""
    try:
        return decode(files)
    except (ValueError, IndexError, KeyError, AttributeError, TypeError, OverflowError, MemoryError):
        if len(files) == 1:
            return [None]
        half = len(files) // 2
        return readable(files[:half]) + readable(files[half:])


def payload_of(picture: Picture, coefs: np.ndarray) -> bytes:
    """The bytes that ``encode`` stored."""
    v = coefs.reshape(-1).astype(np.int16)
    return np.where(v < 0, v + 128, v + 127).astype(np.uint8).tobytes()[: int(picture.comment.split()[1])]


def thumbnail(picture: Picture, coefs: np.ndarray) -> np.ndarray:
    """Luminance at an eighth of the size: a unit's mean, from its DC coefficient."""
    dc = coefs[:, 0, 0].astype(np.int64) * int(picture.quant[picture.components[0][2]][0])
    return np.clip(128 + np.floor_divide(dc, 8), 0, 255).astype(np.uint8).reshape(picture.rows, picture.cols)


def thumb_hash(thumb: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 means is above the one to its left (the first: above the mean of all)."""
    rows = np.minimum(np.arange(8) * thumb.shape[0] // 8, thumb.shape[0] - 1)
    cols = np.minimum(np.arange(9) * thumb.shape[1] // 9, thumb.shape[1] - 1)
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), np.unique(rows), 0), np.unique(cols), 1)
    count = np.add.reduceat(np.add.reduceat(np.ones(thumb.shape, np.int64), np.unique(rows), 0), np.unique(cols), 1)
    small = (sums / count)[np.searchsorted(np.unique(rows), rows)][:, np.searchsorted(np.unique(cols), cols)]
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def describe(text: bytes, file: bytes, picture: Picture, coefs: np.ndarray) -> tuple:
    got = payload_of(picture, coefs)
    thumb = thumbnail(picture, coefs)
    feature = f"{picture.width}x{picture.height}:{thumb.shape[1]}x{thumb.shape[0]}:{thumb_hash(thumb)}:{zlib.crc32(thumb.tobytes()):08x}"
    return len(text), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id and the features read back from each document's file; with ``keep_media`` also the file."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column("text").cast(pa.binary())]
            for first, end in chunks(texts):
                part = texts[first:end]
                files = encode([t + b" " * (-len(t) % UNIT or (0 if t else UNIT)) for t in part])
                rows = [describe(t, f, *pc) for t, f, pc in zip(part, files, decode(files), strict=True)]
                cols = [b.column("doc_id").slice(first, end - first), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(files, pa.binary())] if keep_media else []), ["doc_id", *names] + (["media"] if keep_media else []))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}" + (", media binary" if keep_media else ""))


def describe_media(table: DataFrame, column: str = "media") -> DataFrame:
    """All columns of a table of JPEG files, and readable, width, height, thumbnail (its pixels), thumbnail_hash of each."""
    names = free_names(table, "readable", "width", "height", "thumbnail", "thumbnail_hash")
    at, kinds = table.columns.index(column), [pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def run(batches):
        for b in batches:
            files = [f or b"" for f in b.column(at).to_pylist()]
            for first, end in chunks(files):
                rows = []
                for got in readable(files[first:end]):
                    if got is None:
                        rows.append((False, None, None, None, None))
                    else:
                        thumb = thumbnail(*got)
                        rows.append((True, got[0].width, got[0].height, thumb.tobytes(), thumb_hash(thumb)))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                own = b.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*own.columns, *cols], [f"c{i}" for i in range(len(own.columns) + 5)])

    plain = table.toDF(*(f"c{i}" for i in range(len(table.columns))))  # by place: names may hold dots
    types = ", ".join(f"c{len(table.columns) + i} {t}" for i, t in enumerate(("boolean", "int", "int", "binary", "string")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", " + types
    return plain.mapInArrow(run, schema).toDF(*table.columns, *names)
