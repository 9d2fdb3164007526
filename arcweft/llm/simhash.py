"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has the majority bits of its shingles' hashes.  Two fingerprints of 64 bits that differ
in at most t bits, cut into m segments on a ring, have a segment from which every chain of l consecutive
segments differs in at most l * t / m bits (the pigeonring principle).

With t = 2 and m = 8, chains of up to three segments are equal and chains of up to seven differ in one bit
at most, so one half of the four segments behind the first three is equal too: 16 equality keys of 40 bits,
which unrelated fingerprints hardly ever share.  Two fingerprints with a key are a pair to look at; up to PAIRED
of them are paired with each other; in larger groups a bit of the other half is left open in turn.  Fingerprints
that share all but that bit differ in nine known bits at most, so such a group holds at most 512 of them whatever
the data: no group of copies is ever paired with itself.  Equal fingerprints are one node from the start.

For the similarity of shingle sets (near_duplicates) t is so large that no chain gives a selective key;
there candidates come from min-wise samples of the shingles, chains and the full Hamming distance prune
them, a sketch estimates their Jaccard similarity, and what the sketch can't decide is compared exactly.
Buckets that these pairs leave in several components are compared whole, every text with every other.

Edge cases: null, empty and blank texts have no word and the fingerprint 0, linked like any other; fewer
words than a shingle make one shingle of all; equal texts and repeated rows get one component; rows with a
null id take part and get the least id of their component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, flagged, free_names

SEED = 42
SEGMENTS, SEGMENT_BITS = 8, 8
#: Fingerprints with one key that are paired with each other (all links are found either way), and the most
#: rows of a table of keys that is broadcast.
PAIRED, BROADCAST = 64, 100_000
#: near_duplicates: words of a shingle, least similarity, Hamming distance beyond which no pair is looked at.
SHINGLE, SIMILARITY, FAR = 5, 0.8, 22
#: Min-wise keys: so many bands of so many minima; a pair of similarity 0.8 shares none with probability 0.0002.
BANDS, ROWS = 12, 3
#: Bins of the sketch (15 bits each, 0 for an empty one), and estimates outside which no exact comparison is needed.
BINS, SURE, UNLIKE = 128, 0.93, 0.66
#: A band's bucket with more texts than this is sorted in parts, by the next band's key and at random.
BUCKET = 1024
#: Texts and shingles of a block in which all pairs of a bucket are compared, and least texts of a block that
#: share a shingle for it to be a column of a matrix product.
BLOCK_SETS, BLOCK_SHINGLES, DENSE = 1024, 1 << 20, 48


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of the text's shingles in order, repeats included; A-Z lower-cased, split at ASCII white space."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) < size:
        return np.array([h(join(w), SEED)], np.uint64)
    return np.array([h(join(s), SEED) for s in zip(*(w[i:] for i in range(size)), strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and the fingerprint of each whole text, as a signed long."""

    def run(batches):
        for b in batches:
            fp = [_signed(majority(shingle_hashes(t, shingle))) for t in _texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _turned(fp, start: int):
    """The ring of segments read from segment ``start``."""
    k = start * SEGMENT_BITS
    return F.shiftleft(fp, k).bitwiseOR(F.shiftrightunsigned(fp, 64 - k)) if k else fp


def links(fps: DataFrame) -> DataFrame:
    """(a, b): every pair of the distinct longs in ``fps.fp`` that differ in at most two bits, some more than once."""
    tags = F.array(*[(F.shiftleft(_first(F.col("fp"), i, half), 4).bitwiseOR(F.lit(2 * i + half))) for i in range(SEGMENTS) for half in range(2)])
    tags = fps.select("fp", F.explode(tags).alias("key"))
    groups = checkpoint(tags.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1"))
    pairs = groups.where("n = 2").select("a", "b")
    more = groups.where("n > 2").select("key", "n")
    n = more.count()
    if n:
        members = checkpoint(tags.join(F.broadcast(more) if n <= BROADCAST else more, "key"))
        pairs = pairs.unionByName(_within(members.where(F.col("n") <= PAIRED), ["key"]))
        large = members.where(F.col("n") > PAIRED).withColumn("ring", _ring(F.col("key"), F.col("fp")))
        # the half that is not in the key differs in one bit at most: the bits that stay open are the last segment and that one
        rest = F.shiftrightunsigned("ring", SEGMENT_BITS)
        low = F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, 0).otherwise(2 * SEGMENT_BITS)
        hubs = large.select("fp", "key", rest.alias("rest"), low.alias("low"), F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT_BITS - 1))).alias("j"))
        hubs = hubs.select("fp", "key", "j", F.expr("rest & ~shiftleft(1L, low + j)").alias("chain"))
        several = hubs.groupBy("key", "j", "chain").agg(F.count("*").alias("n")).where("n > 1")
        pairs = pairs.unionByName(_within(hubs.join(several, ["key", "j", "chain"]), ["key", "j", "chain"]))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def _ring(key, fp):
    """The ring of segments of ``fp`` from the segment that the key starts with."""
    out = fp
    for i in range(1, SEGMENTS):
        out = F.when(F.shiftright(key.bitwiseAND(F.lit(15)), 1) == i, _turned(fp, i)).otherwise(out)
    return out


def _first(fp, start: int, half: int):
    """40 bits: three segments of the ring, and the first or the second half of the next four."""
    ring = _turned(fp, start)
    if half == 0:
        return F.shiftrightunsigned(ring, 24)
    return F.shiftleft(F.shiftrightunsigned(ring, 40), 16).bitwiseOR(F.shiftrightunsigned(ring, 8).bitwiseAND(F.lit(0xFFFF)))


def _within(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of the rows that share the keys and differ in at most two bits."""
    left, right = rows.select(*keys, F.col("fp").alias("a")), rows.select(*keys, F.col("fp").alias("b"))
    return left.join(right, keys).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document; links at two bits or fewer."""
    own = checkpoint(fingerprints(docs))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(links(distinct.select("fp")))
    distinct = distinct.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = distinct.groupBy("component").agg(F.min("least").alias("component_id"))
    named = distinct.join(least, "component").select(F.col("fp").alias("node"), "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return own.join(named, F.col("fp") == F.col("node")).select("doc_id", hexed, "component_id")


# ---- similarity of shingle sets


_ODD = np.random.default_rng(11).integers(1, 1 << 62, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def signature(text: bytes, shingle: int = SHINGLE) -> tuple[int, int, int, list[int], bytes]:
    """Of the set of shingles: a hash, its size, the fingerprint, the band keys, and the sketch."""
    h = np.unique(shingle_hashes(text, shingle))
    whole = _signed(xxhash.xxh64_intdigest(h.tobytes(), SEED))
    if not len(h):
        return whole, 0, 0, [0] * BANDS, bytes(2 * BINS)
    least = np.array([(h * m).min() for m in _ODD])
    keys = [_signed(xxhash.xxh64_intdigest(least[i : i + ROWS].tobytes(), i)) for i in range(0, BANDS * ROWS, ROWS)]
    edges = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(57))
    nxt = np.append(edges[1:], len(h))
    sketch = np.where(edges < nxt, h[np.minimum(edges, len(h) - 1)] & np.uint64(0xFFFF) | np.uint64(1), np.uint64(0)).astype(np.uint16)
    return whole, len(h), _signed(majority(h)), keys, sketch.tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [signature(t) for t in _texts(b.column("text"))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "th", "whole", "n", "fp", "keys", "sketch"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, th long, whole long, n long, fp long, keys array<long>, sketch binary")


def _chain(x):
    """Whether some chain of up to four segments keeps within its budgets (see the module's text)."""
    seg = [F.bit_count(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))) for i in range(SEGMENTS)]
    some = F.lit(False)
    for i in range(SEGMENTS):
        total, holds = F.lit(0), F.lit(True)
        for length in range(1, 5):
            total = total + seg[(i + length - 1) % SEGMENTS]
            holds = holds & (total <= length * FAR // SEGMENTS)
        some = some | holds
    return some


def candidates(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct shingle sets that share a band and whose fingerprints are near.

    These are the pairs that settle most buckets; ``bucket_links`` compares what they leave apart.
    A bucket of any size gives a number of pairs in proportion to it: each member with the bucket's leader,
    which another hash order names in every band, and with its next two in the order of fingerprints, a
    large bucket being sorted in parts, by the next band's key and by a salt that bounds a part to about
    8192 texts whatever they share.  The leader is a partial aggregate.
    """
    rows = sets.select("whole", "fp", F.posexplode("keys").alias("band", "key"), F.col("keys").alias("all"))
    rows = rows.withColumn("next", F.element_at("all", (F.pmod(F.col("band") + 1, F.lit(BANDS)) + 1).cast("int"))).drop("all")
    lead = F.struct(F.xxhash64("band", "whole").alias("h"), "whole", "fp")
    buckets = rows.groupBy("band", "key").agg(F.min(lead).alias("lead"), F.count("*").alias("size")).where("size > 1")
    rows = rows.join(buckets, ["band", "key"])
    star = rows.select(F.col("whole").alias("a"), F.col("fp").alias("fa"), F.col("lead.whole").alias("b"), F.col("lead.fp").alias("fb"))
    large = F.col("size") > BUCKET
    part, salt = F.when(large, F.col("next")).otherwise(F.lit(0)), F.when(large, F.pmod(F.xxhash64("band", "whole"), F.ceil(F.col("size") / (8 * BUCKET)))).otherwise(F.lit(0))
    order = Window.partitionBy("band", "key", part, salt).orderBy("fp", "whole")
    after = F.array(*[F.struct(F.lead("whole", k).over(order).alias("b"), F.lead("fp", k).over(order).alias("fb")) for k in (1, 2)])
    side = rows.where("size > 2").withColumn("after", after).select(F.col("whole").alias("a"), F.col("fp").alias("fa"), F.explode("after").alias("x")).select("a", "fa", "x.b", "x.fb")
    pairs = star.unionByName(side).where("b is not null and a <> b")
    x = F.col("fa").bitwiseXOR(F.col("fb"))
    pairs = pairs.where(_chain(x)).where(F.bit_count(x) <= FAR)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _estimate(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
    return float(((x == y) & (x > 0)).sum() / max(1, ((x > 0) | (y > 0)).sum()))


def _groups(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, and (whole, component) of the shingle sets that have a near-duplicate."""
    rows = checkpoint(signatures(docs))
    sets = rows.groupBy("whole").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    n = rows.count()
    sets = checkpoint(sets, n)
    pairs = candidates(sets)
    a, b = (sets.select(F.col("whole").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")

    def estimate(batches):
        for t in batches:
            est = [_estimate(x, y) for x, y in zip(t.column("sa").to_pylist(), t.column("sb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(est, pa.float64())], ["a", "b", "est"])

    est = checkpoint(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(estimate, "a long, b long, est double").where(F.col("est") >= UNLIKE))
    sure = checkpoint(connected_components(est.where(F.col("est") >= SURE).select("a", "b")), n)
    ca, cb = (sure.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    open_pairs = est.where(F.col("est") < SURE).join(ca, "a", "left").join(cb, "b", "left")
    open_pairs = checkpoint(open_pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), est.count())
    agreed = _exact(docs, rows, open_pairs, similarity)
    edges = checkpoint(est.where(F.col("est") >= SURE).select("a", "b").unionByName(agreed))
    linked = checkpoint(connected_components(edges), n)
    edges = edges.unionByName(bucket_links(docs, rows, sets, linked, similarity))
    return rows, connected_components(edges).select(F.col("node").alias("whole"), "component")


def shared(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(i, j) numbers of hashes that sets i and j have in common; ``hashes`` holds one set after the other."""
    m = len(sizes)
    out = np.zeros((m, m), np.float32)
    row = np.repeat(np.arange(m), sizes)
    order = np.lexsort((row, hashes))
    row, first = row[order], np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    number, count = np.cumsum(first) - 1, np.diff(np.append(np.flatnonzero(first), len(hashes)))
    often = np.flatnonzero(count >= DENSE)
    column = np.full(len(count), -1)
    column[often] = np.arange(len(often))
    column, rare = column[number], count[number] < DENSE
    at = np.flatnonzero(column >= 0)
    for low in range(0, len(often), 512):
        part = at[np.searchsorted(column[at], low) : np.searchsorted(column[at], low + 512)]
        dense = np.zeros((m, 512), np.float32)
        dense[row[part], column[part] - low] = 1
        out += dense @ dense.T
    row, number = row[rare], number[rare]
    for k in range(1, DENSE):
        same = np.flatnonzero(number[k:] == number[:-k])
        if not len(same):
            break
        a, b = row[same], row[same + k]
        np.add.at(out, (a, b), 1)
        np.add.at(out, (b, a), 1)
    out[np.arange(m), np.arange(m)] = sizes
    return out


def forest(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left, a, b = np.ones(len(near), bool), [], []
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(near[i] & left)
            left[new] = False
            queue += new.tolist()
            a += [i] * len(new)
            b += new.tolist()
    return a, b


def bucket_links(docs: DataFrame, rows: DataFrame, sets: DataFrame, linked: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of that similarity that join the components of each band's buckets, by the shingles themselves.

    Buckets of up to three have had all their pairs, and those within one component need no more.  The others
    are dealt into blocks, and every two blocks of a bucket meet in a group of their own, so that any two texts of
    a bucket are compared.  A group gives a spanning forest of its links, never all of them.
    """
    spark = docs.sparkSession
    parts = linked.select(F.col("node").alias("whole"), "component")
    members = sets.select("whole", "n", F.posexplode("keys").alias("band", "key")).join(parts, "whole", "left")
    members = members.withColumn("component", F.coalesce("component", "whole"))
    mixed = members.groupBy("band", "key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = mixed.where("size > 3 and low < high")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    members = members.join(mixed.select("band", "key", blocks.alias("blocks")), ["band", "key"])
    members = checkpoint(members.select("whole", "component", "band", "key", "blocks", F.pmod(F.xxhash64("whole", F.lit(3)), F.col("blocks")).cast("int").alias("own")), BANDS * sets.count())
    if members.isEmpty():
        return spark.createDataFrame([], "a long, b long")

    def hashed(batches):
        for t in batches:
            own = [np.unique(shingle_hashes(x, SHINGLE)).tobytes() for x in _texts(t.column("text"))]
            yield pa.RecordBatch.from_arrays([t.column("whole"), pa.array(own, pa.binary())], ["whole", "hashes"])

    def compare(table):
        whole, component = table.column("whole").to_numpy(), table.column("component").to_numpy()
        blobs = table.column("hashes").to_pylist()
        sizes = np.array([len(x) // 8 for x in blobs], np.int64)
        both = shared(np.frombuffer(b"".join(blobs), np.uint64), sizes)
        near = np.empty(both.shape, bool)
        for i in range(len(both)):
            near[i] = (both[i] >= similarity * (sizes[i] + sizes - both[i].astype(np.float64))) & (component[i] != component)
        a, b = forest(near)
        return pa.table({"a": pa.array(whole[a], pa.int64()), "b": pa.array(whole[b], pa.int64())})

    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own"))))
    texts = _texts_of(docs, rows, members.select("whole").distinct()).mapInArrow(hashed, "whole long, hashes binary")
    met = members.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    met = met.join(texts, "whole").select("whole", "component", "band", "key", "i", "j", "hashes")
    return checkpoint(met.groupBy("band", "key", "i", "j").applyInArrow(compare, "a long, b long").distinct(), members.count())


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, th (hash of the text) and group of every document; near-duplicates have one group."""
    rows, parts = _groups(docs, similarity)
    return rows.join(parts, "whole", "left").select("doc_id", "th", F.coalesce("component", "whole").alias("group"))


def _texts_of(docs: DataFrame, rows: DataFrame, needed: DataFrame) -> DataFrame:
    """whole and a text of each of the shingle sets ``needed``; only texts that may be among them are sent."""
    one = checkpoint(rows.groupBy("whole").agg(F.min(F.struct("doc_id", "th")).alias("r")).join(needed, "whole", "left_semi"), rows.count())
    texts = docs.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("t"), "text")
    texts = flagged(texts, ["i", "t"], one.select("r.doc_id", "r.th"), one.count(), "needed").where("needed")
    texts = texts.join(one, F.col("i").eqNullSafe(F.col("r.doc_id")) & (F.col("t") == F.col("r.th")))
    return texts.select("whole", "text").dropDuplicates(["whole"])


def _exact(docs: DataFrame, rows: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs whose shingle sets have the similarity, by the texts themselves."""
    needed = pairs.select(F.col("a").alias("whole")).unionByName(pairs.select(F.col("b").alias("whole"))).distinct()
    texts = _texts_of(docs, rows, needed)
    a, b = (texts.select(F.col("whole").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")

    def run(batches):
        for t in batches:
            keep = []
            for x, y in zip(_texts(t.column("ta")), _texts(t.column("tb")), strict=True):
                hx, hy = np.unique(shingle_hashes(x, SHINGLE)), np.unique(shingle_hashes(y, SHINGLE))
                both = len(np.intersect1d(hx, hy, assume_unique=True))
                keep.append(both >= similarity * (len(hx) + len(hy) - both))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group (the least doc_id; nulls last, then by text), with all columns."""
    rows, parts = _groups(docs, SIMILARITY)
    # equal shingle sets meet first, in partial aggregates: copies in any number are one row of the join
    first = rows.groupBy("whole").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k"))
    first = first.join(parts, "whole", "left").groupBy(F.coalesce("component", "whole").alias("group")).agg(F.min("k").alias("k"))
    keep = first.select(F.col("k.doc_id").alias("i"), F.col("k.th").alias("h"))
    ids = rows.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    ids = ids.join(keep, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left")
    # what goes, and repeated rows of one id: the other texts, nearly all, stay where they are
    odd = checkpoint(ids.where("h is null or n > 1").select("doc_id", "th", F.col("h").isNull().alias("goes")), rows.count())
    goes, n = odd.agg(F.count_if("goes"), F.count("*")).first()
    if not n:
        return docs
    own, i, h, flag = free_names(docs, "hash", "odd_id", "odd_hash", "odd")
    out = flagged(docs.withColumn(own, F.xxhash64("text")), ["doc_id", own], odd.select("doc_id", "th"), n, flag)
    gone = odd.where("goes").select(F.col("doc_id").alias(i), F.col("th").alias(h))
    some = out.where(F.col(flag)).join(gone, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(h)), "left_anti")
    if goes < n:
        some = some.dropDuplicates(["doc_id", own])
    return out.where(~F.col(flag)).unionByName(some).drop(own, flag)
