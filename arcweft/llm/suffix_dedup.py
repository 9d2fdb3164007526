"""Exact repeated passages across documents, by suffix arrays.

A byte goes if it is covered by a string of 50 bytes that also starts in a document with a smaller id.

1. Every window of 50 bytes names an anchor: the place in it whose 24-byte string has the least hash.  Equal
   windows name equal anchors, so a repeat is always seen where two documents share an anchor.  An anchor
   carries a hash of its 24 bytes and one of its context, all 76 bytes that its windows can reach.  Anchors
   travel as packed blocks dealt by the first hash; equal contexts of a block are one entry, the smallest id.
2. Where contexts are equal (by 64 bits of hash besides the anchor's), every document but the one with the
   smallest id loses the whole context.
3. Anchors with unequal contexts lie at the ends of a repeat.  Their contexts are cut from the texts and put,
   dealt by anchor, into suffix arrays; runs of suffixes that agree in 50 bytes are the repeats left.
4. Each document's covered stretches are merged.

The suffix array is built by linear grouping: suffixes start in groups by their first symbol; groups are taken
in descending order, and each sends the previous smaller suffixes of its members, by how many members point
to them, into new groups behind their own.  When all groups are taken they are groups of equal Lyndon prefix
in their final order, and one pass along the array puts each group's members in order.  Nothing is renamed.

An anchor that a large share of documents has in unequal contexts (a common line) sends its 27 windows as entries of their own
instead of its context: they are dealt by their own hashes, so no task meets all its documents, and need no
third step.  Both ways give the same bytes.

Edge cases: a null text is empty; texts below 50 bytes lose nothing; equal texts and repeats within runs such
as blanks are found like others; documents of one id never cost each other a byte; a null id counts as larger
than all; rows of null ids, and of one id with different texts, are told apart by a hash of the text; ids that are no
integers raise ValueError; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, integer_ids
from .ngrams import _BYTE, mix

LENGTH = 50
KEY = 24
REACH = LENGTH - KEY  # bytes that a context has on either side of its anchor
WINDOW = REACH + 1  # places in a window of 50 bytes
CONTEXT = KEY + 2 * REACH
#: Bytes of text of a range of documents, and of a block of anchors' texts.
PART_BYTES, BLOCK_BYTES = 4 << 20, 6 << 20
#: Bytes of text whose hashes are held at once, and whose anchors are packed together.
HASH_BYTES, PACK_BYTES = 1 << 19, 1 << 23
#: Contexts for one suffix array; a group of one anchor is never divided, larger ones are compared by window.
ARRAY_CONTEXTS, GROUP_CONTEXTS = 400, 4000
#: An anchor is common if one in so many documents has it, each in another context, by a sample of so many
#: documents.  Whether an anchor counts as common decides how its windows travel, never what is found.
COMMON, COMMON_SAMPLE = 200, 10_000
LOW32 = np.uint64((1 << 32) - 1)
NO_ID = np.iinfo(np.int64).max
#: Repeated ids with different texts that are broadcast; with more, every row carries the hash of its text.
SEVERAL = 200_000

_A = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a list of symbols whose last is smaller than all others, by linear grouping."""
    n = len(text)
    size = [0] * (max(text) + 2)
    for c in text:
        size[c + 1] += 1
    for c in range(1, len(size)):
        size[c] += size[c - 1]
    start, place = size, size[:]
    sa, where, group, count, prev = [0] * n, [0] * n, [0] * n, [0] * n, [-1] * n
    for i, c in enumerate(text):
        k = place[c]
        place[c] = k + 1
        sa[k] = i
        where[i] = k
        group[i] = g = start[c]
        count[g] += 1
    # first phase: groups in descending order refine the groups of their previous smaller suffixes
    end = n - 1
    while end >= 0:
        g = group[sa[end]]
        if g == end:
            i = sa[end]
            p = i - 1
            while p >= 0 and group[p] > g:
                p = prev[p]
            prev[i] = p
            levels = {1: [p]} if p >= 0 else {}
        else:
            members = sa[g : end + 1]
            members.sort()
            points: dict[int, int] = {}
            for i in members:
                p = i - 1
                while p >= 0 and group[p] >= g:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    points[p] = points.get(p, 0) + 1
            levels = {}
            for p, k in points.items():
                if k in levels:
                    levels[k].append(p)
                else:
                    levels[k] = [p]
        for k in sorted(levels, reverse=True) if len(levels) > 1 else levels:
            moved = levels[k]
            for p in moved:  # to the upper end of their group
                h = group[p]
                count[h] = c = count[h] - 1
                to, at = h + c, where[p]
                q = sa[to]
                sa[at], sa[to] = q, p
                where[q], where[p] = at, to
            for p in moved:
                h = group[p]
                group[p] = h + count[h]
            for p in moved:
                count[group[p]] += 1
        end = g - 1
    # second phase: each group's order, from the suffixes already in place
    front = list(range(n))
    placed = [False] * n
    sa[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = sa[k] - 1
        while j >= 0 and not placed[j]:
            h = group[j]
            sa[front[h]] = j
            front[h] += 1
            placed[j] = True
            j = prev[j]
    return sa


def repeated(contexts: np.ndarray, docs: np.ndarray, group: np.ndarray) -> np.ndarray:
    """(context, window) booleans: whether the window also is in a context of its group with a smaller id.

    ``contexts`` is (n, 76) bytes, 0xFF outside the text; windows that reach outside are never repeated.
    ``group`` numbers the anchors from 0: all contexts of one share the middle 24 bytes, which are one symbol.
    """
    n = len(contexts)
    out = np.zeros((n, WINDOW), bool)
    if n > GROUP_CONTEXTS:  # too many for one array: window by window
        for w in range(WINDOW):
            piece = np.ascontiguousarray(contexts[:, w : w + LENGTH])
            _, at = np.unique(piece.view(f"V{LENGTH}").ravel(), return_inverse=True)
            least = np.full(at.max() + 1, NO_ID)
            np.minimum.at(least, at, docs)
            out[:, w] = least[at] < docs
    else:
        width = 2 * REACH + 2
        text = np.full((n, width), 1, np.int64)
        text[:, :REACH] = contexts[:, :REACH].astype(np.int64) + 2
        text[:, REACH] = group + 258
        text[:, REACH + 1 : -1] = contexts[:, REACH + KEY :].astype(np.int64) + 2
        flat = text.ravel()
        order = np.array(suffix_array([*flat.tolist(), 0]), np.int64)[1:]
        order = order[order % width < WINDOW]
        row, col = order // width, order % width
        same = np.ones(max(0, len(order) - 1), bool)
        for k in range(REACH + 1):  # a window is its bytes before the key, the key, and its bytes behind
            live = np.flatnonzero(same)
            if not len(live):
                break
            same[live] = flat[order[live] + k] == flat[order[live + 1] + k]
        run = np.concatenate([[0], np.cumsum(~same)])
        least = np.full(int(run[-1]) + 1, NO_ID)
        np.minimum.at(least, run, docs[row])
        out[row, col] = least[run] < docs[row]
    outside = np.concatenate([np.zeros((n, 1), np.int32), np.cumsum(contexts == 0xFF, axis=1, dtype=np.int32)], axis=1)
    return out & (outside[:, LENGTH:] == outside[:, :WINDOW])


def likely(contexts: np.ndarray, docs: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Contexts that can share a window with another document: 13 more bytes on one side agree with one's.

    A window has 26 bytes besides the key, hence 13 at least on one side.
    """
    out = np.zeros(len(key), bool)
    half = REACH // 2
    for first in (REACH - half, REACH):
        piece = np.ascontiguousarray(contexts[:, first : first + KEY + half])
        whole = np.zeros((len(key), 40), np.uint8)
        whole[:, : KEY + half] = piece
        h = key.copy()
        for word in whole.view("<u8").T:
            h = mix(h ^ word)
        order = np.argsort(h)
        cut = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        low, high = np.minimum.reduceat(docs[order], cut), np.maximum.reduceat(docs[order], cut)
        out[order] |= np.repeat(low < high, np.diff(np.append(cut, len(order))))
    return out


def anchors(texts: list[bytes]):
    """Anchors of all texts: text, place, key, context hash; and a function for the hashes of one's windows."""
    gap = b"\xff" * REACH
    data = np.frombuffer(gap + gap.join(texts) + gap + b"\xff" * LENGTH, np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    start = REACH + np.concatenate([[0], np.cumsum(size + REACH)])[:-1]
    h1 = _BYTE[data]
    h2 = h1[:-1] * _A[0] + h1[1:]
    h4 = h2[:-2] * _A[1] + h2[2:]
    h8 = h4[:-4] * _A[2] + h4[4:]
    h16 = h8[:-8] * _A[3] + h8[8:]
    key = h16[:-8] * _A[4] + h8[16:]
    key ^= key >> np.uint64(31)
    key *= _A[5]
    key ^= key >> np.uint64(29)
    key |= np.uint64(1)
    least = np.minimum(key[:-1], key[1:])
    for step in (2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[: -(WINDOW - 16)], least[WINDOW - 16 :])
    windows = np.maximum(size - LENGTH + 1, 0)
    valid = np.zeros(len(least) + 1, np.int8)
    np.add.at(valid, start[windows > 0], 1)
    np.add.at(valid, (start + windows)[windows > 0], -1)
    least = np.where(np.cumsum(valid[:-1], dtype=np.int8) > 0, least, np.uint64(0))
    most = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    for step in (1, 2, 4, 8):
        most = np.maximum(most[:-step], most[step:])
    most = np.maximum(most[: -(WINDOW - 16)], most[WINDOW - 16 :])
    n = min(len(most), len(key))
    at = np.flatnonzero(most[:n] == key[:n])
    doc = np.searchsorted(start, at, side="right") - 1
    h32 = h16[at - REACH] * _A[4] + h16[at - REACH + 16]
    h64 = h32 * _A[5] + (h16[at - REACH + 32] * _A[4] + h16[at - REACH + 48])
    context = mix(h64 * _A[6] + h16[at - REACH + CONTEXT - 16])

    def window_hash(rows, w):
        p = at[rows] - REACH + w
        a = (h16[p] * _A[4] + h16[p + 16]) * _A[5] + (h16[p + 32] * _A[4] + h16[p + 34])
        inside = (p >= start[doc[rows]]) & (p + LENGTH <= (start + size)[doc[rows]])
        return mix(a * _A[6] + np.uint64(LENGTH)), inside

    return doc, (at - start[doc]).astype(np.int64), key[at], context, window_hash


def _give_back() -> None:
    """Return freed memory to the system: a Python worker lives on, and beside it others need the executor's share."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _ids(column) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], np.int64)


def _row(ids: np.ndarray, version: np.ndarray) -> np.ndarray:
    """Where a row is found: its id, or the hash of its text where the id does not name one text (0 elsewhere)."""
    return np.where(version != 0, version, ids)


def _versions(docs: DataFrame) -> DataFrame:
    """doc_id, text and version: a hash of the text for null ids and ids with different texts, 0 for others."""
    text = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)).bitwiseOR(F.lit(1))
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high"))
    several = checkpoint(ids.where("low <> high").select(F.col("doc_id").alias("several")))
    own, n = docs.select("doc_id", "text"), several.limit(SEVERAL + 1).count()
    if n > SEVERAL:
        return own.withColumn("version", text)
    if n == 0:
        return own.withColumn("version", F.when(F.col("doc_id").isNull(), text).otherwise(F.lit(0)))
    own = own.join(F.broadcast(several), F.col("doc_id") == F.col("several"), "left")
    return own.select("doc_id", "text", F.when(F.col("doc_id").isNull() | F.col("several").isNotNull(), text).otherwise(F.lit(0)).alias("version"))


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _slices(texts: list[bytes], limit: int):
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    """Spark's pmod(xxhash64(id), parts): XXH64 of the eight bytes with seed 42."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x, r):
        return (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    with np.errstate(over="ignore"):
        h = turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1 ^ (np.uint64(50) + p5)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64) % parts


def _pack(**arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n = len(blob) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _halves(x: np.ndarray) -> bytes:
    """Low halves of 32-bit numbers, then high halves: these are nearly all 0, and the shuffle's compression drops them."""
    x = x.astype("<i4").view("<u4")
    return (x & 0xFFFF).astype("<u2").tobytes() + (x >> 16).astype("<u2").tobytes()


def _whole(blob: bytes, n: int, at: int) -> np.ndarray:
    low, high = np.frombuffer(blob, "<u2", n, at), np.frombuffer(blob, "<u2", n, at + 2 * n)
    return (low.astype("<u4") | high.astype("<u4") << 16).view("<i4")


def _stretches(blob: bytes) -> tuple[np.ndarray, ...]:
    """Rows, starts and lengths of the stretches that go."""
    n = len(blob) // 14
    return np.frombuffer(blob, "<i8", n), _whole(blob, n, 8 * n), np.frombuffer(blob, "<i2", n, 12 * n)


def _entries(blob: bytes) -> tuple[np.ndarray, ...]:
    n, d, wide = np.frombuffer(blob, "<i4", 3)
    first = np.frombuffer(blob, "<i8", 1, 12)[0]
    at = 20 + (12 if wide & 1 else 6) * d
    ids = first + np.frombuffer(blob, "<i8" if wide & 1 else "<u4", d, 20).astype(np.int64)
    count = np.frombuffer(blob, "<i4" if wide & 1 else "<u2", d, at - (4 if wide & 1 else 2) * d)
    version = np.frombuffer(blob, "<i8", d, at) if wide & 2 else np.zeros(d, np.int64)
    at += 8 * d if wide & 2 else 0
    key = np.frombuffer(blob, "<u4", n, at).astype(np.uint64)
    context = np.frombuffer(blob, "<u8", n, at + 4 * n)
    place = _whole(blob, n, at + 12 * n)
    return key, context, np.repeat(ids, count), np.repeat(version, count), place


def _emit(column: str, keys: np.ndarray, kind: int, pack):
    """A batch of packed rows, one for each value of ``keys`` (already sorted); ``pack(a, b)`` packs a run."""
    if not len(keys):
        return
    cut = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    values = keys[cut[:-1]]
    blobs = [pack(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for i in range(0, len(blobs), 64):
        yield pa.RecordBatch.from_arrays([pa.array(values[i : i + 64], pa.int64()), pa.array([kind] * len(values[i : i + 64]), pa.int32()), pa.array(blobs[i : i + 64], pa.binary())], [column, "kind", "blob"])


def _class(key: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(key ^ mix(context * np.uint64(3)))


def _least(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least id of the rows with the same number in ``group``, for each row."""
    if not len(doc):
        return doc
    order = np.argsort(group)
    cut = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    out = np.empty_like(doc)
    out[order] = np.repeat(np.minimum.reduceat(doc[order], cut), np.diff(np.append(cut, len(order))))
    return out


BLOB = "long, kind int, blob binary"
#: Kinds of blobs: entries of anchors, stretches that go, open anchors, contexts.
ENTRIES, GONE, OPEN, CONTEXTS = 0, 1, 2, 3


def _gone(ids: np.ndarray, first: np.ndarray, last: np.ndarray, parts: int):
    """Stretches that go as blobs; ``ids`` are rows (see ``_row``)."""
    part = _part(ids, parts)
    order = np.lexsort((first, ids, part))
    part, ids, first, last = part[order], ids[order], first[order], last[order]
    yield from _emit("part", part, GONE, lambda a, b: ids[a:b].astype("<i8").tobytes() + _halves(first[a:b]) + (last - first)[a:b].astype("<i2").tobytes())


def _common(docs: DataFrame, total: int) -> np.ndarray:
    """Keys of the anchors with as many unequal contexts in a sample as one in COMMON documents.

    They are at most COMMON times as many as a document's anchors.  Copies have equal contexts and don't count.
    """

    def run(batches):
        for b in batches:
            texts = _texts(b.column("text"))
            for first, end in _slices(texts, HASH_BYTES):
                _, _, key, context, _ = anchors(texts[first:end])
                pairs = np.unique(np.stack([key, context], axis=1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["key", "context"])

    share = min(1.0, COMMON_SAMPLE / max(1, total))
    some = docs.where((F.xxhash64("doc_id", F.lit(7)) % 1_000_000 + 1_000_000) % 1_000_000 < int(1_000_000 * share)) if share < 1 else docs
    found = some.select("text").mapInArrow(run, "key long, context long").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= max(20, total * share // COMMON))
    return np.sort(np.array([r["key"] for r in found.select("key").collect()], np.int64).view(np.uint64))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return _plan(docs)[0]


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and ``kept``: the remaining bytes of each document."""
    return _plan(docs, keep=True)[0]


def _plan(docs: DataFrame, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    integer_ids(docs)
    kind = dict(docs.dtypes)["doc_id"]
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    parts = max(1, total["bytes"] // PART_BYTES)
    blocks = max(1, total["bytes"] // BLOCK_BYTES)
    sc = docs.sparkSession.sparkContext
    own = _versions(docs)
    common = sc.broadcast(_common(docs, total["n"]))

    def enter(batches):
        """Anchors of a batch as entries; of equal entries only the smallest id goes on, the others are settled here."""
        for b in batches:
            all_texts, all_ids, all_versions = _texts(b.column("text")), _ids(b.column("doc_id")), b.column("version").to_numpy()
            for lo, hi in _slices(all_texts, PACK_BYTES):
                texts, ids, versions = all_texts[lo:hi], all_ids[lo:hi], all_versions[lo:hi]
                pieces = []
                for first, end in _slices(texts, HASH_BYTES):
                    doc, place, key, context, window_hash = anchors(texts[first:end])
                    often = np.isin(key, common.value) if len(common.value) else np.zeros(len(key), bool)
                    hot, calm = np.flatnonzero(often), np.flatnonzero(~often)
                    pieces.append((key[calm], context[calm] & ~np.uint64(1), ids[first + doc[calm]], versions[first + doc[calm]], place[calm]))
                    for w in range(WINDOW if len(hot) else 0):
                        h, inside = window_hash(hot, w)
                        h, rows = h[inside], hot[inside]
                        pieces.append((h, h | np.uint64(1), ids[first + doc[rows]], versions[first + doc[rows]], place[rows] - REACH + w))
                key, context, doc, version, place = (np.concatenate(x) for x in zip(*pieces, strict=True))
                window = (context & np.uint64(1)).astype(bool)
                block = (mix(key) % np.uint64(blocks)).astype(np.uint16 if blocks < 1 << 16 else np.uint32)
                key = key & LOW32
                late = doc > _least(_class(key, context), doc)
                where = np.flatnonzero(late)
                start = np.where(window, place, place - REACH)[where]
                end = np.where(window, place + LENGTH, place + KEY + REACH)[where]
                for out in _gone(_row(doc[where], version[where]), start, end, parts):
                    # they go the way of the entries and are passed on there
                    blob = [p.to_bytes(8, "little") + x for p, x in zip(out.column(0).to_pylist(), out.column(2).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([p % blocks for p in out.column(0).to_pylist()], pa.int64()), out.column(1), pa.array(blob, pa.binary())], ["block", "kind", "blob"])
                go = np.flatnonzero(~late)
                go = go[np.argsort(block[go], kind="stable")]
                key, context, doc, version, place, block = (x[go] for x in (key, context, doc, version, place, block))

                def pack(a, b, key=key, context=context, doc=doc, version=version, place=place):
                    new = (doc[a + 1 : b] != doc[a : b - 1]) | (version[a + 1 : b] != version[a : b - 1])
                    cut = np.concatenate([[0], np.flatnonzero(new) + 1, [b - a]])
                    own, text, count = doc[a:b][cut[:-1]], version[a:b][cut[:-1]], np.diff(cut)
                    first = own.min()
                    wide = int(own.max()) - int(first) >= 1 << 32 or int(count.max()) >= 1 << 16
                    head = np.array([b - a, len(own), wide + 2 * bool(text.any())], "<i4").tobytes() + np.array([first], "<i8").tobytes()
                    head += (own - first).astype("<i8" if wide else "<u4").tobytes() + count.astype("<i4" if wide else "<u2").tobytes()
                    head += text.astype("<i8").tobytes() if text.any() else b""
                    return head + key[a:b].astype("<u4").tobytes() + context[a:b].astype("<u8").tobytes() + _halves(place[a:b])

                yield from _emit("block", block.astype(np.int64), ENTRIES, pack)
                del key, context, doc, version, place, block, window, late, go, pieces
                _give_back()

    def settle(table):
        """Of a block: stretches that go, and open anchors."""
        _give_back()
        schema = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        passed = [x for k, x in zip(kinds, blobs, strict=True) if k == GONE]
        out = [pa.RecordBatch.from_arrays([pa.array([int.from_bytes(x[:8], "little") for x in passed], pa.int64()), pa.array([GONE] * len(passed), pa.int32()), pa.array([x[8:] for x in passed], pa.binary())], schema=schema)]
        got = [_entries(x) for k, x in zip(kinds, blobs, strict=True) if k == ENTRIES]
        if not got:
            return pa.Table.from_batches(out, schema)
        key, context, doc, version, place = (np.concatenate(x) for x in zip(*got, strict=True))
        late = doc > _least(_class(key, context), doc)
        window = (context & np.uint64(1)).astype(bool)
        where = np.flatnonzero(late)
        out += list(_gone(_row(doc[where], version[where]), np.where(window, place, place - REACH)[where], np.where(window, place + LENGTH, place + KEY + REACH)[where], parts))
        rest = np.flatnonzero(~late & ~window)
        if len(rest):  # an anchor is open if documents have it with unequal contexts
            order = rest[np.argsort(key[rest])]
            starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            low, high = np.minimum.reduceat(doc[order], starts), np.maximum.reduceat(doc[order], starts)
            left = order[np.repeat(low < high, np.diff(np.append(starts, len(order))))]
            part = _part(_row(doc[left], version[left]), parts)
            by = np.argsort(part, kind="stable")
            left, part = left[by], part[by]
            out += _emit("part", part, OPEN, lambda a, b: _pack(k=key[left[a:b]].astype("<u8"), i=doc[left[a:b]].astype("<i8"), v=version[left[a:b]].astype("<i8"), p=place[left[a:b]].astype("<i4")))
        return pa.Table.from_batches(out, schema)

    def cut(table, blobs):
        """Contexts of the open anchors of a range of documents."""
        _give_back()
        got = [_unpack(x, "<u8", "<i8", "<i8", "<i4") for k, x in zip(blobs.column("kind").to_pylist(), blobs.column("blob").to_pylist(), strict=True) if k == OPEN]
        empty = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
        if not got or not len(table):
            return pa.Table.from_batches([], empty)
        key, doc, version, place = (np.concatenate(x) for x in zip(*got, strict=True))
        ids, texts = _row(_ids(table.column("doc_id")), table.column("version").to_numpy()), _texts(table.column("text"))
        at = np.argsort(ids, kind="stable")
        row = at[np.searchsorted(ids[at], _row(doc, version))]
        size = np.array([len(t) for t in texts], np.int64)
        start = REACH + np.concatenate([[0], np.cumsum(size + REACH)])[:-1]
        gap = b"\xff" * REACH
        data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
        matrix = data[(start[row] + place - REACH)[:, None] + np.arange(CONTEXT)]
        block = (mix(key) % np.uint64(4 * blocks)).astype(np.int64)
        order = np.lexsort((key, block))
        key, doc, version, place, matrix, block = (x[order] for x in (key, doc, version, place, matrix, block))
        return pa.Table.from_batches(list(_emit("block", block, CONTEXTS, lambda a, b: _pack(k=key[a:b].astype("<u8"), i=doc[a:b].astype("<i8"), v=version[a:b].astype("<i8"), p=place[a:b].astype("<i4"), m=matrix[a:b].view(f"V{CONTEXT}").ravel()))), empty)

    def sort(table):
        """Repeats among the contexts of a block, by suffix arrays."""
        _give_back()
        got = [_unpack(x, "<u8", "<i8", "<i8", "<i4", f"V{CONTEXT}") for x in table.column("blob").to_pylist()]
        key, doc, version, place, matrix = (np.concatenate(x) for x in zip(*got, strict=True))
        matrix = np.ascontiguousarray(matrix).view(np.uint8).reshape(-1, CONTEXT)
        key = np.zeros(len(matrix), np.uint64)  # of the 24 bytes themselves: equal keys share them
        for word in np.ascontiguousarray(matrix[:, REACH : REACH + KEY]).view("<u8").T:
            key = mix(key ^ word) + word
        use = np.flatnonzero(likely(matrix, doc, key))
        order = use[np.argsort(key[use], kind="stable")]
        key, doc, version, place, matrix = key[order], doc[order], version[order], place[order], matrix[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        group, bounds = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(key))
        out, first = [], 0
        while first < len(key):
            last = bounds[max(np.searchsorted(bounds, first + ARRAY_CONTEXTS, side="right") - 1, np.searchsorted(bounds, first, side="right"))]
            hit = repeated(matrix[first:last], doc[first:last], group[first:last] - group[first])
            rows = np.flatnonzero(hit.any(1))
            if len(rows):  # the windows of a context all hold its anchor: one stretch
                lo, hi = hit[rows].argmax(1), WINDOW - 1 - hit[rows][:, ::-1].argmax(1)
                p = place[first:last][rows] - REACH
                out.append((_row(doc[first:last][rows], version[first:last][rows]), p + lo, p + hi + LENGTH))
            first = last
        batches = list(_gone(*(np.concatenate(x) for x in zip(*out, strict=True)), parts)) if out else []
        return pa.Table.from_batches(batches, pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())]))

    def finish(table, blobs):
        """Merge each document's stretches."""
        _give_back()
        ids, texts = _row(_ids(table.column("doc_id")), table.column("version").to_numpy()), _texts(table.column("text"))
        got = [_stretches(x) for k, x in zip(blobs.column("kind").to_pylist(), blobs.column("blob").to_pylist(), strict=True) if k == GONE]
        size = np.array([len(t) for t in texts], np.int64)
        start = np.concatenate([[0], np.cumsum(size + 1)])
        cover = np.zeros(int(start[-1]) + 1, np.int32)
        if got and len(ids):
            doc, first, length = (np.concatenate(x) for x in zip(*got, strict=True))
            at = np.argsort(ids, kind="stable")
            lo, hi = np.searchsorted(ids[at], doc), np.searchsorted(ids[at], doc, side="right")
            for more in range(int((hi - lo).max(initial=0))):  # once, unless rows repeat
                live = lo + more < hi
                row = at[lo[live] + more]
                a, b = np.maximum(first[live], 0), np.minimum(first[live] + length[live], size[row])
                good = b > a
                np.add.at(cover, start[row[good]] + a[good], 1)
                np.add.at(cover, start[row[good]] + b[good], -1)
        gone = np.cumsum(cover, dtype=np.int32) > 0
        data = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8) if texts else np.empty(0, np.uint8)
        n_removed, n_spans, kept = [], [], []
        for i, t in enumerate(texts):
            g = gone[start[i] : start[i] + len(t)]
            n_removed.append(int(g.sum()))
            n_spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
            rest = t if not n_removed[-1] else data[start[i] : start[i] + len(t)][~g].tobytes()
            kept.append(rest if keep else hashlib.sha256(rest).hexdigest())
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept" if keep else "kept_sha256": pa.array(kept, pa.binary() if keep else pa.string())})

    entered = own.mapInArrow(enter, f"block {BLOB}")
    settled = entered.groupBy("block").applyInArrow(settle, f"part {BLOB}")
    part = F.pmod(F.xxhash64(F.when(F.col("version") != 0, F.col("version")).otherwise(F.col("doc_id").cast("long"))), F.lit(parts))
    by_part = own.withColumn("part", part)
    opened, gone = settled.where(F.col("kind") == OPEN), settled.where(F.col("kind") == GONE)
    contexts = by_part.groupBy("part").cogroup(opened.groupBy("part")).applyInArrow(cut, f"block {BLOB}")
    found = contexts.groupBy("block").applyInArrow(sort, f"part {BLOB}")
    everything = gone.unionByName(found)
    out = by_part.groupBy("part").cogroup(everything.groupBy("part")).applyInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, " + ("kept binary" if keep else "kept_sha256 string"))
    return out, contexts



#: The result window by window, for tables whose ids are unique and not null.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 49))) AS i FROM d)),
first AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT w.doc_id, i FROM w JOIN first USING (s) WHERE low < w.doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM runs),
cut AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
