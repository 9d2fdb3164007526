"""Best-fit packing of documents into training sequences, with conflicts.

A sequence holds ``capacity`` words.  Documents longer than that are cut into full pieces and a rest; pieces
are placed in descending size.  Open sequences are ordered by what is left in them; a piece goes to the first
in that order that it fits and that it does not conflict with, the search going on to the next larger one
until one is found, else a new sequence is opened.  Each sequence carries two bitmaps: of duplicate clusters,
a cluster being in a sequence once, and of sources, a source having as many bits as its share of a
sequence's documents (one at least), so that no sequence fills up with one source.

Documents are counted once; their lengths are checkpointed and everything else reads those.  Rows are dealt to blocks of bounded size by a hash of id, cluster and piece; a block is packed in one task, so a source
or cluster of any size is spread over all blocks.  No text is shuffled.

Edge cases: null, empty and blank texts have no word and no place: they come back with sequence null, as do
no others; equal texts are one cluster and never share a sequence (near copies only where a column names their
cluster, a null there meaning the text itself); null sources are a source; ties are broken by id, piece and cluster; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, word_count

CAPACITY = 2048
BLOCK_ROWS = 8192
SCHEMA = "sequence string, position int, doc_id {id}, piece int, first_word long, size long"


def place(pieces: list[tuple[int, int, int]], capacity: int, bits: dict[int, int]) -> list[tuple[int, int]]:
    """(bin, position) of each piece (size, source, cluster), the pieces being in the order of placing.

    ``bits`` says how many of its pieces a source may have in a bin.
    """
    residuals: list[tuple[int, int]] = []  # (what is left, bin), ascending
    clusters: list[int] = []
    sources: list[int] = []
    count: list[int] = []
    cluster_bit: dict[int, int] = {}
    source_bit: dict[int, int] = {}
    used = 0
    for s in sorted({p[1] for p in pieces}):
        source_bit[s], used = used, used + bits.get(s, 1)
    out = []
    for size, source, cluster in pieces:
        mine = 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        low, n = source_bit[source], bits.get(source, 1)
        own = ((1 << n) - 1) << low
        at, found = bisect_left(residuals, (size, -1)), -1
        while at < len(residuals):
            b = residuals[at][1]
            if not clusters[b] & mine and sources[b] & own != own:
                found = b
                break
            at += 1
        if found < 0:
            found, left = len(count), capacity
            clusters.append(0)
            sources.append(0)
            count.append(0)
        else:
            left = residuals.pop(at)[0]
        free = ~sources[found] & own
        sources[found] |= free & -free
        clusters[found] |= mine
        out.append((found, count[found]))
        count[found] += 1
        if left > size:
            insort(residuals, (left - size, found))
    return out


def _key(x) -> int:
    return xxhash.xxh64_intdigest(repr(x))


def pack(docs: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, cluster: str | None = None) -> DataFrame:
    """sequence, position, doc_id, piece, first_word, size: one row per piece of every document.

    ``cluster`` is a column of ``docs`` that names the duplicate cluster; without one equal texts are a cluster.
    """
    own = F.xxhash64("text")
    named = F.when(F.col(f"`{cluster}`").isNotNull(), F.xxhash64(F.col(f"`{cluster}`"))).otherwise(own) if cluster else own
    rows = checkpoint(docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), named.alias("cluster")))
    per = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.least("words", F.lit(capacity))).alias("w"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    n = total["n"]
    per_bin = capacity * n / max(1, total["w"])
    # the share of a source in all documents times the documents of a sequence, for the sources that get over one bit
    shares = per.where(F.col("n") * per_bin > max(1, n)).collect() if n else []
    bits = {_key(r["source"]): 1 + int(r["n"] / n * per_bin) for r in shares}
    blocks = max(1, -(-n // block_rows))
    piece = F.posexplode(F.when(F.col("words") > 0, F.sequence(F.lit(0).cast("long"), F.col("words") - 1, F.lit(capacity).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("piece", "first_word")
    rows = rows.select("doc_id", "source", "words", "cluster", piece).withColumn("size", F.least(F.col("words") - F.col("first_word"), F.lit(capacity).cast("long")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(blocks)))
    kind = dict(docs.dtypes)["doc_id"]

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        got = list(zip(*(t.column(c).to_pylist() for c in ("size", "doc_id", "piece", "cluster", "source", "first_word")), strict=True))
        got.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2], r[3], repr(r[4])))
        full = [r for r in got if r[0] > 0]
        spots = place([(r[0], _key(r[4]), r[3]) for r in full], capacity, bits) + [(None, 0)] * (len(got) - len(full))
        return pa.table({
            "sequence": pa.array([None if b is None else f"{block:08x}-{b:06x}" for b, _ in spots], pa.string()), "position": pa.array([p for _, p in spots], pa.int32()),
            "doc_id": pa.array([r[1] for r in got], t.schema.field("doc_id").type), "piece": pa.array([r[2] for r in got], pa.int32()),
            "first_word": pa.array([r[5] for r in got], pa.int64()), "size": pa.array([r[0] for r in got], pa.int64()),
        })

    return rows.groupBy("block").applyInArrow(run, SCHEMA.format(id=kind))
