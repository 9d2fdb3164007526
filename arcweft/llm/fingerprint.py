"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is cut into lines and sentences; the set of their 64-bit digests (40 bits of hash, 24 that check them) is
its sketch.  Digests are dealt by their bits to subtables, in number the least power of two that leaves
``LOAD`` digests to each on average, and a digest enters one cell of each of the subtable's five tables; a cell is (how
many, xor of digests).  The fingerprint is the sketch as text, so it grows with its document.

Two versions are compared by their sketches alone.  If one has fewer subtables, its digests are recovered by peeling
and entered in as many as the other has.  Then cells are subtracted, which leaves what differs, and peeled: a cell
that holds a single digest gives it, and it is taken from its other cells, until nothing is left.  A subtable
that gets stuck is retried larger: the digests of both sides, recovered by peeling, enter four times the cells by other
bits, are subtracted, and peeled again.  If that gets stuck as well (or a side can't be recovered), each cell that
is left counts for the digests that it holds, two at least, and five cells for one digest; that is the end of it.
Likeness is what two sets share over all that they have.

Everything is DataFrame expressions.  Texts are shuffled once, into ranges of ids, in which a window sees the
next document; a range's last document sees the first of the next range through one extra row.

Edge cases: a null text is the empty text; the empty text has no digest, and two empty texts have likeness 1;
rows of equal or null ids follow each other by the hash of their texts (null ids last, in ranges of that hash); one
single document is its own next; an empty table gives an empty result; other columns do not matter; ids that are
no integers raise ValueError.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, integer_ids

#: Documents of a range, and ranges that are found by quantiles (each is cut evenly further on).
RANGE_ROWS, QUANTILES = 2048, 64
#: The most ranges whose last documents are found by a broadcast of 40 bytes each; with more it is a shuffled join.
BROADCAST = 250_000
#: Digests of a subtable at most on average, its tables, bits of a cell's number, and those in a retry.
LOAD, TABLES, BITS, MORE_BITS = 8, 5, 3, 5
#: Bits of a digest that check the others, and the first of those that say its cells; the ones between say its subtable.
CHECK, FIRST = 24, 64 - TABLES * BITS
MASK = (1 << CHECK) - 1
NONE = "cast(array() as array<struct<n:int,k:bigint>>)"
#: Where a piece of text ends.
PIECE = r"\n|(?<=[.!?]) "


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def digests(text: str) -> str:
    """SQL: the set of piece digests of a text column."""
    one = _let("h", f"shiftrightunsigned(xxhash64(p), {CHECK})", f"shiftleft(h, {CHECK}) | (xxhash64(h) & {MASK}L)")
    return f"array_distinct(transform(filter(split({text}, r'{PIECE}'), p -> p <> ''), p -> {one}))"


def _word(d: str, bits: int) -> tuple[str, int]:
    """SQL of the bits that say a digest's cells, and where they start; a retry takes others."""
    return (d, FIRST) if bits == BITS else (f"xxhash64({d}, 1)", 0)


def subtables(n: str) -> str:
    """SQL: how many subtables a set of ``n`` digests has."""
    return f"if({n} <= {LOAD}, 1, cast(shiftleft(1, length(bin(cast(({n} - 1) div {LOAD} as bigint)))) as int))"


def deal(digests: str, count: str) -> str:
    """SQL: digests by subtable, in two steps, so that dealing takes the square root of their number a digest."""
    low = f"shiftrightunsigned(x, {CHECK})"
    coarse = f"filter(l, x -> ({low} & (s - 1)) div w = c)"
    fine = f"transform(sequence(0, w - 1), f -> filter(g, x -> ({low} & (w - 1)) = f))"
    width = "cast(shiftleft(1, cast((length(bin(s)) - 1) div 2 as int)) as int)"
    every = f"flatten(transform(sequence(0, cast(s div w as int) - 1), c -> {_let('g', coarse, fine)}))"
    return _let("l", digests, _let("s", count, _let("w", width, every)))


def sketch(elements: str, bits: int = BITS) -> str:
    """SQL: the tables of cells (count, xor of digests) of an array of digests."""
    word, first = _word("x", bits)
    cell = _let("m", f"filter({elements}, x -> (shiftrightunsigned({word}, h) & {(1 << bits) - 1}L) = r)", "named_struct('n', size(m), 'k', aggregate(m, 0L, (z, x) -> z ^ x))")
    numbers = ", ".join(f"{c}L" for c in range(1 << bits))
    return f"transform(array({', '.join(str(first + bits * t) for t in range(TABLES))}), h -> transform(array({numbers}), r -> {cell}))"


def sketches(digests: str) -> str:
    """SQL: all subtables of an array of digests."""
    return _let("own", digests, f"transform({deal('own', subtables('size(own)'))}, q -> {sketch('q')})")


def minus(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (v, w) -> zip_with(v, w, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k)))"


def peeled(table: str, bits: int = BITS) -> str:
    """SQL: struct(f, left): the digests that peeling recovers (with their sign), and how many are stuck."""
    word, first = _word("x.k", bits)
    place = f"cast(shiftrightunsigned({word}, {first} + {bits} * h) & {(1 << bits) - 1}L as int) = r"
    single = f"abs(x.n) = 1 and {place} and (xxhash64(shiftrightunsigned(x.k, {CHECK})) & {MASK}L) = (x.k & {MASK}L)"
    pure = f"array_distinct(flatten(transform(st.t, (row, h) -> filter(row, (x, r) -> {single}))))"
    word, _ = _word("y.k", bits)
    hit = f"filter(p, y -> cast(shiftrightunsigned({word}, g) & {(1 << bits) - 1}L as int) = r)"
    cell = _let("q", hit, "if(size(q) = 0, c, aggregate(q, c, (a, y) -> named_struct('n', a.n - y.n, 'k', a.k ^ y.k)))")
    less = f"transform(st.t, (row, h) -> {_let('g', f'{first} + {bits} * h', f'transform(row, (c, r) -> {cell})')})"
    # what a table's cells hold in all, less what was found: nothing is left as soon as count and xor are 0
    total = "aggregate({0}[0], named_struct('n', 0, 'k', 0L), (a, c) -> named_struct('n', a.n + c.n, 'k', a.k ^ c.k))"
    rest = "aggregate(p, st.rest, (a, y) -> named_struct('n', a.n - y.n, 'k', a.k ^ y.k))"
    found = f"if(u.n = 0 and u.k = 0L, {_state('st.t', 'concat(st.f, p)', 'u', 'true')}, {_state(less, 'concat(st.f, p)', 'u', 'false')})"
    step = _let("p", pure, f"if(size(p) = 0, {_state('st.t', 'st.f', 'st.rest', 'true')}, {_let('u', rest, found)})")
    start = _let("t", table, _let("u", total.format("t"), _state("t", NONE, "u", "u.n = 0 and u.k = 0L")))
    # every round that is no end finds a digest, so a table can't take more rounds than it has cells
    state = f"aggregate(sequence(1, {TABLES << bits}), {start}, (st, round) -> if(st.end, st, {step}))"
    stuck = f"cast(ceil(aggregate(flatten(z.t), 0, (s, x) -> s + if(x.n = 0 and x.k = 0L, 0, greatest(abs(x.n), 2))) / {TABLES}) as int)"
    return _let("z", state, f"named_struct('f', z.f, 'left', if(z.rest.n = 0 and z.rest.k = 0L, 0, {stuck}))")


def _state(table: str, found: str, rest: str, end: str) -> str:
    return f"named_struct('t', {table}, 'f', {found}, 'rest', {rest}, 'end', {end})"


def add_likeness(rows: DataFrame, name: str, a: str, na: str, b: str, nb: str) -> DataFrame:
    """A column with what two sets of ``na`` and ``nb`` digests share over all that they have, from their sketches a and b."""
    steps = {
        "small": f"if(size({a}) < size({b}), {a}, {b})",
        "large": f"if(size({a}) < size({b}), {b}, {a})",
        # the smaller one's digests, where it has fewer subtables, and these dealt to more of them
        "own": f"if(size(small) = size(large), null, transform(small, o -> {peeled('o')}))",
        "spread": f"if(own is null, small, transform({deal('flatten(transform(own, o -> transform(o.f, x -> x.k)))', 'size(large)')}, q -> if(size(q) = 0, null, {sketch('q')})))",
        "lost": "if(own is null, 0, aggregate(own, 0, (s, o) -> s + o.left))",
        # subtract and peel; where the other side has nothing, all that the cells of one table count differs
        "once": f"transform(large, (o, i) -> if(spread[i] is null, named_struct('f', {NONE}, 'left', 0), {peeled(minus('o', 'spread[i]'))}))",
        "whole": "aggregate(zip_with(large, spread, (o, x) -> if(x is null, aggregate(o[0], 0, (s, c) -> s + c.n), 0)), lost, (s, n) -> s + n)",
        # what is stuck again with more cells, from what both sides give by themselves
        "sides": f"transform(once, (o, i) -> if(o.left = 0, null, named_struct('a', {peeled('large[i]')}, 'b', {peeled('spread[i]')})))",
        "again": f"transform(sides, o -> if(o is null or o.a.left + o.b.left > 0, null, {peeled(minus(sketch('transform(o.a.f, x -> x.k)', MORE_BITS), sketch('transform(o.b.f, x -> x.k)', MORE_BITS)), MORE_BITS)}))",
        "differ": "aggregate(zip_with(once, again, (o, r) -> if(r is null, size(o.f) + o.left, size(r.f) + r.left)), whole, (s, n) -> s + n)",
    }
    kept = rows.columns
    for step, expr in steps.items():
        rows = rows.withColumn(step, F.expr(expr))
    return rows.select(*kept, F.expr(f"if({na} + {nb} = 0, 1D, greatest(0D, ({na} + {nb} - differ) / cast({na} + {nb} + differ as double)))").alias(name))


def written(sketch: str, n: str) -> str:
    """SQL: a sketch as text: how many digests, then for each cell count and xor, nothing for an empty one."""
    return f"concat({n}, ':', array_join(transform(flatten(flatten({sketch})), x -> if(x.n = 0, '', concat(x.n, '.', lower(hex(x.k))))), ' '))"


def _ranges(docs: DataFrame, rows_per_range: int):
    """An expression that numbers ranges in ascending order, about evenly filled: of ids, below 0 of null ids' hashes."""
    total, n, lo, hi = docs.agg(F.count("*"), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    parts = max(1, math.ceil((total - n) / rows_per_range))
    out = F.when(F.col("doc_id").isNull(), F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * parts).cast("long") - parts - 1)
    if not n or lo == hi:
        return out.otherwise(F.lit(0)).cast("long")
    quantiles = max(1, min(QUANTILES, n // rows_per_range))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / quantiles for i in range(1, quantiles)] or [0.5], 2000)).first()[0]
    edges = sorted({lo, *cuts, hi + 1})
    inner = math.ceil(n / len(edges) / rows_per_range)
    for i in range(len(edges) - 1):
        a, b = edges[i], edges[i + 1]
        part = F.floor((F.col("doc_id") - F.lit(a)).cast("double") * inner / float(b - a))
        out = out.when(F.col("doc_id") < F.lit(b), F.lit(i * inner) + F.least(part, F.lit(inner - 1)))
    return out.cast("long")


def with_next(docs: DataFrame, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, text, n, s, next_text, next_n, next_s) of every document, next being that of the next smaller id.

    ``n`` and ``s`` are a text's digests' number and subtables, computed once, behind the shuffle.
    """
    integer_ids(docs)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = own.withColumn("part", _ranges(own, rows_per_range))
    place = F.struct("doc_id", "tie")  # nulls are least
    first = rows.groupBy("part").agg(F.max(place).alias("top"))
    every = Window.partitionBy(F.lit(0)).orderBy(F.desc("part"))
    # a row for each range; the last one is followed by the first
    first = first.withColumn("to", F.coalesce(F.lag("part").over(every), F.min("part").over(Window.partitionBy(F.lit(0)))))
    first = checkpoint(first.select(F.col("part").alias("p"), F.col("top.doc_id").alias("i"), F.col("top.tie").alias("t"), "to"))
    first = F.broadcast(first) if first.count() <= BROADCAST else first
    heads = rows.join(first, (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")))
    heads = heads.select(F.col("to").alias("part"), "doc_id", "text", "tie", F.lit(1).alias("extra"))
    rows = rows.select("part", "doc_id", "text", "tie", F.lit(0).alias("extra")).unionByName(heads)
    # sorted before the sketches are made, so that neither the shuffle nor the sort carries them
    order = ["extra", F.col("doc_id").desc_nulls_last(), F.desc("tie")]
    rows = rows.repartition("part").sortWithinPartitions("part", *order).withColumn("d", F.expr(digests("text"))).withColumn("s", F.expr(sketches("d"))).withColumn("n", F.size("d")).drop("d")
    nxt = F.lead(F.struct("text", "n", "s")).over(Window.partitionBy("part").orderBy(*order))
    return rows.withColumn("next", nxt).where("extra = 0").select("doc_id", "text", "n", "s", F.col("next.text").alias("next_text"), F.col("next.n").alias("next_n"), F.col("next.s").alias("next_s"))


def compare_versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("e", F.expr(digests("edited")))
    rows = rows.withColumn("es", F.expr(sketches("e"))).withColumn("en", F.size("e"))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", "n", "s", "en", "es", "next_n", "next_s", F.expr(written("s", "n")).alias("fingerprint"), F.expr(written("es", "en")).alias("edited_fingerprint"))
    rows = add_likeness(add_likeness(rows, "near_edited", "s", "n", "es", "en"), "near_next", "s", "n", "next_s", "next_n")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
