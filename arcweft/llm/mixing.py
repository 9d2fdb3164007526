"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is put in a seeded random order.  Its virtual finish time is the number of
tokens its source has sent up to and including it, divided by the source's target; a source that must
send more than it has sends its documents again, in the same order, after the first pass.  The queue is the
order of virtual finish times, cut where the total budget is used up.  To find the cut no global sort is needed:
slices of virtual time, counted in partial aggregates, take the place of a range sort's partitions, the slice
with the cut is sliced again, and only what is left of it is sorted.

Edge cases: a null text has size 0; a null source is a source of its own and the last in code-point
order; an empty table gives an empty result; equal ids and repeated rows are separate documents, each
with its own place in the queue (id and text decide it, so reruns agree); further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, free_names, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Hexadecimal digits of the shuffle key that make a bucket: a source's queue is summed by bucket first.
BUCKET_DIGITS = 3
#: Slices of virtual time per level of the range partitioning.
SLICES = 4096
MAX_PASSES = 2
#: Copies of one document that are ranked in one part.
SALTED = 8192
#: Rows of a table of sources that are broadcast at most.
BROADCAST = 100_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_num: int = 3, budget_den: int = 2, passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, weight, budget, target): one row per source.

    ``sizes`` has (source, size).  Targets share the budget by weight and stop at ``passes`` times the
    source's size; what is cut off is shared again by weight until none is above.  With sources sorted by
    limit over weight, the water level at the first source that does not reach its limit gives all targets.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * passes)
    everything = Window.partitionBy(F.lit(0))
    budget = F.floor(F.sum("source_size").over(everything) * budget_num / F.lit(budget_den)).cast("long")
    up = everything.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("budget", budget)
    per = per.withColumn("level", (F.col("budget") - F.sum("cap").over(up) + F.col("cap")).cast("double") / (F.sum("weight").over(everything) - F.sum("weight").over(up) + F.col("weight")).cast("double"))
    # levels fall from the first source whose limit is above its level; none: every source reaches its limit
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return per.select(
        "source", "source_size", "weight", "budget", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double"))).alias("target")
    )


def place():
    """The key that shuffles documents: a hash of id and text, so that rows of one id or of none are dealt like others."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))


def queue(docs: DataFrame, weights=WEIGHTS, budget_num: int = 3, budget_den: int = 2, passes: int = MAX_PASSES) -> DataFrame:
    """(row_key, doc_id, size, source, source_size, target, finish, pass, taken): one row per document and pass.

    ``taken`` is the size where the item is before the cut, else 0.  No text is shuffled.  Prefix sums have
    two levels, so that a source with a third of all rows is no single task: sums of (source, bucket) give
    each bucket's start, and a window runs within a bucket only.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place().alias("key"))
    sized = checkpoint(sized.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)))
    targets = source_targets(sized, weights, budget_num, budget_den, passes)
    starts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("start"))
    starts = starts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sent = sized.withColumn("sent", F.sum("size").over(within)).withColumn("nth", F.row_number().over(within))
    starts = starts.withColumnsRenamed({"source": "s", "bucket": "b"})
    items = sent.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("sent", F.col("sent") + F.col("start"))
    items = items.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    finish = F.when(F.col("target") > 0, (F.col("pass") * F.col("source_size") + F.col("sent")).cast("double") / F.col("target")).otherwise(F.lit(0.0))
    items = checkpoint(items.select("doc_id", "source", "size", "source_size", "target", "budget", "key", "bucket", "nth", "pass", finish.alias("finish")))
    return cut(items)


def cut(items: DataFrame) -> DataFrame:
    """Mark what the queue sends before the budget is used up.

    Virtual time is range-partitioned into slices; the slice in which the running total crosses the budget
    is sliced again, and again, until rows of one slice are few; only those are put in exact order.  Items of
    one source that have a size never tie, so a slice shrinks to as many rows as there are sources.
    """
    empty, items = items.where("size = 0").withColumn("taken", F.lit(0).cast("long")), items.where("size > 0")  # nothing to send
    row = items.agg(F.max("budget").alias("budget"), F.min("finish").alias("lo"), F.max("finish").alias("hi")).first()
    if row["budget"] is None:
        return empty
    budget, low, high, spent = row["budget"], row["lo"], row["hi"], 0
    for _ in range(3):
        width = (high - low) / SLICES
        if width <= 0 or low + width == low:
            break
        inside = items.where((F.col("finish") >= low) & (F.col("finish") <= high))
        g = F.least(F.floor((F.col("finish") - low) / width), F.lit(SLICES - 1))
        parts = inside.groupBy(g.alias("g")).agg(F.sum("size").alias("size"), F.min("finish").alias("lo"), F.max("finish").alias("hi"), F.count("*").alias("n")).orderBy("g").collect()
        at = None
        for p in parts:
            if spent + p["size"] > budget:
                at = p
                break
            spent += p["size"]
        if at is None:
            low = high = float("inf")
            break
        low, high = at["lo"], at["hi"]
        if at["n"] < 10_000:
            break
    edge = items.where((F.col("finish") >= low) & (F.col("finish") <= high))
    exact = Window.partitionBy(F.lit(0)).orderBy("finish", F.col("source").asc_nulls_last(), "key", "doc_id", "nth", "pass").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("taken", F.when(F.sum("size").over(exact) + F.lit(spent) <= budget, F.col("size")).otherwise(F.lit(0)).cast("long"))
    rest = items.where((F.col("finish") < low) | (F.col("finish") > high)).withColumn("taken", F.when(F.col("finish") < low, F.col("size")).otherwise(F.lit(0)).cast("long"))
    return rest.unionByName(edge).unionByName(empty)


def mix_sizes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    items = queue(docs.select("doc_id", "text", "source"))
    return items.groupBy("source", "bucket", "key", "doc_id", "nth").agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken")
    ).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed documents with all their columns, a document once for each pass that sends it.

    Rows that share id, text and source are copies of one document: together they are sent as often as the queue
    sends them.  Where that is no multiple of their number (at the cut of a source only) the copies are ranked,
    in parts, and the first ones are sent once more.
    """
    key, source, copies, times, extra, row, salt, nth, start = free_names(docs, "key", "mixed_source", "copies", "times", "extra", "row", "salt", "nth", "start")
    sent = (F.col("taken") > 0) | ((F.col("size") == 0) & (F.col("pass") == 0))
    per = queue(docs.select("doc_id", "text", "source")).groupBy(F.col("key").alias(row), F.col("source").alias(source))
    per = per.agg(F.count(F.when(F.col("pass") == 0, 1)).alias(copies), F.count(F.when(sent, 1)).alias(times)).where(F.col(times) > 0)
    per = checkpoint(per.select(row, source, copies, F.floor(F.col(times) / F.col(copies)).alias(times), F.pmod(F.col(times), F.col(copies)).alias(extra)))
    own, at = docs.withColumn(key, place()), (F.col(key) == F.col(row)) & F.col("source").eqNullSafe(F.col(source))
    out = own.join(per, at).withColumn(nth, F.explode(F.when(F.col(times) > 0, F.sequence(F.lit(1).cast("long"), F.col(times))))).select(*_quoted(docs))
    more = per.where(F.col(extra) > 0)  # a row for each source at most, as copies follow each other in the queue
    n = more.count()
    if n:
        some = own.join(F.broadcast(more) if n <= BROADCAST else more, at).withColumn(row, F.monotonically_increasing_id())
        some = checkpoint(some.withColumn(salt, F.pmod(F.xxhash64(row), F.ceil(F.col(copies) / SALTED))))
        before = Window.partitionBy(key, source).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
        first = some.groupBy(key, source, salt).agg(F.count("*").alias(nth)).withColumn(start, F.coalesce(F.sum(nth).over(before), F.lit(0))).drop(nth)
        first = first.withColumnsRenamed({key: "k", source: "s", salt: "p"}).select(F.struct("k", "s", "p").alias(row), start)
        ranked = some.withColumn(nth, F.row_number().over(Window.partitionBy(key, source, salt).orderBy(row))).drop(row)
        ranked = ranked.join(first, F.col(key).eqNullSafe(F.col(f"{row}.k")) & F.col(source).eqNullSafe(F.col(f"{row}.s")) & (F.col(salt) == F.col(f"{row}.p")))
        out = out.unionByName(ranked.where(F.col(start) + F.col(nth) <= F.col(extra)).select(*_quoted(docs)))
    return out


def _quoted(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM per),
weighted AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap,
         CAST(floor(CAST(sum(source_size) OVER () * 3 AS DOUBLE) / 2) AS BIGINT) AS budget
  FROM ranked),
levels AS (
  SELECT *, CAST(budget - sum(cap) OVER up + cap AS DOUBLE) / CAST(sum(weight) OVER () - sum(weight) OVER up + weight AS DOUBLE) AS level
  FROM weighted
  WINDOW up AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
targets AS (
  SELECT source, source_size, budget,
         least(CAST(cap AS DOUBLE), coalesce((max(CASE WHEN level * weight <= cap THEN level END) OVER ()) * weight, CAST(cap AS DOUBLE))) AS target
  FROM levels),
sent AS (
  SELECT d.*, t.source_size, t.target, t.budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS sent
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
items AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(pass * source_size + sent AS DOUBLE) / target ELSE 0.0 END AS finish
  FROM sent, (VALUES (0), (1)) p(pass)),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, pass ROWS UNBOUNDED PRECEDING) AS total FROM items)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(sum(CASE WHEN total <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM cut GROUP BY doc_id
"""
