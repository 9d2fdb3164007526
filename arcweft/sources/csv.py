"""LOAD CSV: rows of text, as maps by header or as lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import STRING

MARK = "﻿"


def read_csv(spark: SparkSession, clause) -> tuple[DataFrame, T.DataType]:
    """(rows with one column ``row``, its type): every field trimmed, missing cells empty text."""
    reader = spark.read.option("sep", clause.sep).option("quote", clause.quote).option("escape", clause.quote).option("multiLine", True)
    reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("header", clause.headers).option("enforceSchema", False)
    source = clause.source
    if source.startswith(("http://", "https://")):
        df = _from_url(spark, source, clause)
    else:
        df = reader.csv(source.removeprefix("file://") if source.startswith("file:///") else source)

    def cell(c):
        return F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))

    if clause.headers:
        names = {c: c.replace(MARK, "").strip() for c in df.columns}
        kind = T.StructType([T.StructField(n, STRING) for n in names.values()])
        return df.select(F.struct(*[cell(c).alias(n) for c, n in names.items()]).alias("row")), kind
    first = df.columns[0]
    cells = [F.regexp_replace(cell(c), f"^{MARK}", "") if c == first else cell(c) for c in df.columns]
    return df.select(F.array(*cells).alias("row")), T.ArrayType(STRING)


def _from_url(spark: SparkSession, url: str, clause) -> DataFrame:
    """A file behind HTTP is read on the driver: it is as large as one response."""
    import csv
    import io
    from urllib.request import urlopen

    with urlopen(url, timeout=30) as r:  # noqa: S310
        text = r.read().decode("utf-8-sig")
    rows = list(csv.reader(io.StringIO(text), delimiter=clause.sep, quotechar=clause.quote, skipinitialspace=True))
    if clause.headers:
        head, rows = (rows[0], rows[1:]) if rows else ([], [])
    else:
        head = [f"_c{i}" for i in range(max(map(len, rows), default=1))]
    rows = [tuple((r + [""] * len(head))[: len(head)]) for r in rows]
    return spark.createDataFrame(rows, T.StructType([T.StructField(h, STRING) for h in head]))
