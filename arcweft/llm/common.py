"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pattern of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a checkpoint's file, where their number is known beforehand.
FILE_ROWS = 20_000
#: Bits of a row of bitmap_construct_agg, a filter's bits for each of its keys, and the most rows that it has (16 MB in all).
BITMAP, KEY_BITS, FILTER_ROWS = 32_768, 32, 4096
#: Bytes of text that a numpy kernel works on at a time.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage through the shared folder that the session names.

    ``rows``, about how many there are, keeps small tables from being written as one file for each shuffle partition:
    every file costs a task, and on a local file system a process of its own that sets its permissions.

    A folder of our own is made only on one machine (a local master); a cluster must name a shared one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    return df.checkpoint(eager=True)


def free_names(df: DataFrame, *bases: str) -> list[str]:
    """A column name for each base that the table does not have (Spark compares names without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name, n = base, 0
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def integer_ids(docs: DataFrame) -> None:
    """Raise ValueError unless ``doc_id`` is an integer column: ids are compared as numbers."""
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"doc_id must be an integer column, not {kind}")


def word_count(text):
    """Words of a text, as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(doc_id, folds: int):
    """crc32 of the id written as text, modulo the number of folds (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def chunks(values, limit: int = CHUNK_BYTES):
    """Split a list of byte strings into runs of about ``limit`` bytes: yields (first, end)."""
    first = total = 0
    for i, v in enumerate(values):
        total += len(v)
        if total >= limit:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(values):
        yield first, len(values)


def flagged(df: DataFrame, columns: list[str], keys: DataFrame, n: int, flag: str) -> DataFrame:
    """``df`` with a boolean: true wherever the columns' values are one of the ``n`` rows of ``keys``, and seldom elsewhere.

    Rows that are not flagged need not be sent to a join with ``keys``; those that are need it still.  The hash of each key
    sets a bit, and the bits are broadcast, whose size is bounded: up to 4 million keys about one row in 32 is flagged without
    being one; with more keys more are.  The columns must have the keys' types.
    """
    size = BITMAP * min(FILTER_ROWS, max(1, -(-n * KEY_BITS // BITMAP)))
    at, part, bits = free_names(df, "at", "part", "bits")
    place = lambda names: F.pmod(F.xxhash64(*names), F.lit(size).cast("long"))
    row = (F.col(at) / BITMAP).cast("long")
    rows = keys.select(place(keys.columns).alias(at)).groupBy(row.alias(part)).agg(F.bitmap_construct_agg(F.col(at) % BITMAP).alias(bits))
    byte = F.conv(F.hex(F.col(bits).substr((F.col(at) % BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    out = df.withColumn(at, place(columns)).join(F.broadcast(rows), row == F.col(part), "left")
    return out.withColumn(flag, F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1, F.lit(False))).drop(at, part, bits)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b), component being its least node.

    Alternating large-star and small-star rounds: each round hangs neighbours below the least node they
    see, so the number of rounds grows with the logarithm of the longest chain.  Only edges are shuffled,
    each round is checkpointed in the shared folder, and a round that changes no edge ends the loop (equal counts
    and sums are confirmed by an anti join).
    A hub's neighbours are never gathered: the least neighbour is a partial aggregate, joined back.
    """
    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, rows = None, edges.count()
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")
        )
        before, edges = edges, checkpoint(small.select("e.*").where("a <> b").distinct(), rows)
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == state and edges.join(before, ["a", "b"], "left_anti").isEmpty():
            break
        state, rows = now, now[0]
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
