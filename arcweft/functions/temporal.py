"""Temporal values, which are ISO-8601 text, and durations.

Text is taken apart by pattern; a timestamp or date column is taken as the text that it would be.  Parts out
of their range roll over (month 13 is next January), by counting months and then days and milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from .typed import BOOL, DOUBLE, LONG, STRING, Expr, field, is_null, is_number, is_string, is_struct, is_time, iso, number

# fixed values: the forms that count as temporal
DATETIME = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?"
DATE = r"^(\d{4})-(\d{2})-(\d{2})$"
TIME = r"^(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?"
OFFSET = r"([+-])(\d{2}):?(\d{2})$"
TEMPORAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}|^\d{4}-\d{2}-\d{2}$|^\d{2}:\d{2}:\d{2}"
DURATION = r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
PARTS = ("year", "month", "day", "hour", "minute", "second", "millisecond")
KINDS = ("datetime", "date", "time", "localdatetime", "localtime", "datetimewithtimezone", "timewithzone")
DEFAULTS = {"year": 1970, "month": 1, "day": 1, "hour": 0, "minute": 0, "second": 0, "millisecond": 0}


def _group(s: Column, pattern: str, k: int) -> Column:
    got = F.regexp_extract(s, pattern, k)
    return F.when(got != "", got)


def _millis(s: Column, pattern: str, k: int) -> Column:
    got = F.regexp_extract(s, pattern, k)
    return F.when(got != "", F.round(F.concat(F.lit("0."), got).cast("double") * 1000)).otherwise(0).cast("long")


def offset(s: Column) -> Column:
    """'Z', a signed offset, or null."""
    m = F.concat(F.regexp_extract(s, OFFSET, 1), F.regexp_extract(s, OFFSET, 2), F.lit(":"), F.regexp_extract(s, OFFSET, 3))
    # a date's own dashes are no offset
    return F.when(s.endswith("Z"), F.lit("Z")).when(s.rlike(r":\d{2}(\.\d+)?[+-]\d{2}:?\d{2}$"), m)


def offset_minutes(s: Column) -> Column:
    o = offset(s)
    minutes = F.substring(o, 2, 2).cast("long") * 60 + F.substring(o, 5, 2).cast("long")
    return F.when(o.isNull() | (o == "Z"), F.lit(0).cast("long")).when(F.substring(o, 1, 1) == "-", -minutes).otherwise(minutes)


def as_text(e: Expr) -> Column:
    if is_time(e.type):
        return iso(e)
    if is_string(e.type):
        return e.col
    return F.lit(None).cast("string")


def epoch_millis(year, month, day, hour, minute, second, milli) -> Column:
    """Milliseconds since 1970 of parts that may be out of range."""
    first = F.add_months(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (month - 1).cast("int"))
    days = F.datediff(first, F.lit("1970-01-01").cast("date")).cast("long") + day - 1
    return ((days * 24 + hour) * 60 + minute) * 60000 + second * 1000 + milli


def component(e: Expr, name: str) -> Expr:
    """One part of a temporal value; numbers count as epoch seconds, or milliseconds above 1e12."""
    if is_null(e.type):
        return Expr(F.lit(None).cast("string" if name == "timezone" else "long"), STRING if name == "timezone" else LONG)
    if is_number(e.type):
        millis = F.when(e.col > 1e12, F.floor(e.col)).otherwise(F.floor(e.col * 1000)).cast("long")
        if name == "epochseconds":
            return Expr(F.when(e.col > 1e12, F.floor(e.col / 1000)).otherwise(F.floor(e.col)).cast("long"), LONG)
        if name == "epochmillisecond":
            return Expr(millis, LONG)
        if name == "timezone":
            return Expr(F.when(e.col.isNotNull(), F.lit("Z")), STRING)
        return component(Expr(_iso_millis(millis), STRING), name)
    s = as_text(e)
    full, day, time = s.rlike(DATETIME), s.rlike(DATE), s.rlike(TIME)
    if name == "timezone":
        return Expr(F.when(full | time, offset(s)), STRING)

    def part(k: int) -> Column:  # 0..6
        out = F.when(full, _millis(s, DATETIME, 7) if k == 6 else _group(s, DATETIME, k + 1).cast("long"))
        if k < 3:
            return out.when(day, _group(s, DATE, k + 1).cast("long"))
        return out.when(time, _millis(s, TIME, 4) if k == 6 else _group(s, TIME, k - 2).cast("long"))

    if name in PARTS:
        return Expr(part(PARTS.index(name)), LONG)
    values = [F.coalesce(part(k), F.lit(DEFAULTS[p]).cast("long")) for k, p in enumerate(PARTS)]
    millis = F.when(full | day | time, epoch_millis(*values))
    if name == "epochseconds":
        return Expr(F.floor(millis / 1000).cast("long"), LONG)
    if name == "epochmillisecond":
        return Expr(millis, LONG)
    if name == "temporalepoch":
        return Expr(millis - offset_minutes(s) * 60000, LONG)
    raise QueryError(f"no temporal part {name}")


def temporal_epoch(e: Expr) -> Expr:
    """Epoch milliseconds with the offset applied."""
    if is_number(e.type):
        return Expr(F.when(e.col > 1e12, e.col).otherwise(e.col * 1000).cast("long"), LONG)
    return component(e, "temporalepoch")


def is_temporal(s: Column) -> Column:
    return s.rlike(TEMPORAL)


def _iso_millis(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _time_text(millis: Column) -> Column:
    t = F.timestamp_millis(millis)
    return F.when(F.pmod(millis, F.lit(1000)) > 0, F.date_format(t, "HH:mm:ss.SSS")).otherwise(F.date_format(t, "HH:mm:ss"))


def _pad(x: Column, n: int) -> Column:
    s = x.cast("long").cast("string")
    return F.when(F.length(s) < n, F.lpad(s, n, "0")).otherwise(s)


def _local_time(h, m, s, ms) -> Column:
    base = F.concat(_pad(h, 2), F.lit(":"), _pad(m, 2), F.lit(":"), _pad(s, 2))
    return F.when(ms > 0, F.concat(base, F.lit("."), _pad(ms, 3))).otherwise(base)


def _local_datetime(y, mo, d, h, m, s, ms) -> Column:
    return F.concat(_pad(y, 4), F.lit("-"), _pad(mo, 2), F.lit("-"), _pad(d, 2), F.lit("T"), _local_time(h, m, s, ms))


def _written(kind: str, millis: Column, zone: Column | None = None) -> Column:
    zone = F.lit("Z") if zone is None else F.coalesce(zone, F.lit("Z"))
    full = _iso_millis(millis)
    if kind == "datetime":
        return full
    if kind == "date":
        return F.substring(full, 1, 10)
    if kind in ("time", "localtime"):
        return _time_text(millis)
    if kind == "localdatetime":
        return F.concat(F.substring(full, 1, 10), F.lit("T"), _time_text(millis))
    if kind == "datetimewithtimezone":
        return F.concat(F.substring(full, 1, 23), zone)
    return F.concat(_time_text(millis), zone)


def build(kind: str, args: list[Expr]) -> Expr:
    """A temporal value of a kind: now, or from an epoch number, a map, a text or components."""
    if not args:
        return Expr(_written(kind, F.unix_millis(F.current_timestamp())), STRING)
    first = args[0]
    if is_null(first.type) and len(args) == 1:
        return Expr(F.lit(None).cast("string"), STRING)
    timed = kind in ("time", "localtime", "timewithzone")
    if len(args) == 1 and is_number(first.type):
        return Expr(_written(kind, temporal_epoch(first).col), STRING)
    if is_struct(first.type):
        get = {}
        for p in PARTS:
            f = field(first.type, p)
            get[p] = F.coalesce(first.col.getField(p).cast("long"), F.lit(DEFAULTS[p]).cast("long")) if f and not is_null(f.dataType) else F.lit(DEFAULTS[p]).cast("long")
        values = [get[p] for p in PARTS]
        zone = first.col.getField("timezone") if field(first.type, "timezone") else None
        if kind == "localdatetime":
            return Expr(_local_datetime(*values), STRING)
        if kind == "localtime":
            return Expr(_local_time(*values[3:]), STRING)
        return Expr(_written(kind, epoch_millis(*values), zone), STRING)
    if is_string(first.type) or is_time(first.type):
        s = as_text(first)
        text = Expr(s, STRING)
        millis = component(text, "temporalepoch").col
        whole = F.when(s.rlike(DATETIME) | s.rlike(DATE), _written(kind, millis, offset(s)))
        if timed:
            h, m, x = (_group(s, TIME, k).cast("long") for k in (1, 2, 3))
            clock = _local_time(h, m, x, _millis(s, TIME, 4))
            if kind == "timewithzone":
                clock = F.concat(clock, F.coalesce(offset(s), F.lit("Z")))
            return Expr(F.when(s.rlike(TIME), clock).otherwise(whole), STRING)
        if kind == "datetimewithtimezone":
            values = [_group(s, DATETIME, k).cast("long") for k in range(1, 7)] + [_millis(s, DATETIME, 7)]
            return Expr(F.when(s.rlike(DATETIME), F.concat(_local_datetime(*values), F.coalesce(offset(s), F.lit("Z")))).otherwise(whole), STRING)
        if kind == "localdatetime":
            return Expr(whole, STRING)
        return Expr(whole, STRING)
    numbers = [F.coalesce(n.col.cast("long"), F.lit(0).cast("long")) if (n := number(a)) else F.lit(0).cast("long") for a in args]
    if timed:
        h, m, s, ms = (numbers + [F.lit(0).cast("long")] * 4)[:4]
        if kind == "localtime":
            return Expr(_local_time(h, m, s, ms), STRING)
        zero = F.lit(1).cast("long")
        return Expr(_written(kind, epoch_millis(F.lit(1970).cast("long"), zero, zero, h, m, s, ms)), STRING)
    values = (numbers + [F.lit(DEFAULTS[p]).cast("long") for p in PARTS[len(numbers) :]])[:7]
    if kind == "localdatetime":
        return Expr(_local_datetime(*values), STRING)
    return Expr(_written(kind, epoch_millis(*values)), STRING)


def duration(args: list[Expr]) -> Expr:
    """An ISO-8601 duration from a map of parts, or a valid text as it is."""
    if not args:
        return Expr(F.lit(None).cast("string"), STRING)
    a = args[0]
    if is_struct(a.type):
        def part(name):
            f = field(a.type, name)
            return F.coalesce(a.col.getField(name).cast("double"), F.lit(0.0)) if f and not is_null(f.dataType) else F.lit(0.0)

        def piece(x, unit):
            from .typed import number_text

            return F.when(x != 0, F.concat(number_text(x), F.lit(unit))).otherwise("")

        seconds = part("seconds") + part("milliseconds") / 1000
        days = F.concat(piece(part("years"), "Y"), piece(part("months"), "M"), piece(part("days"), "D"))
        clock = F.concat(piece(part("hours"), "H"), piece(part("minutes"), "M"), piece(F.round(seconds, 3), "S"))
        iso_text = F.concat(F.lit("P"), days, F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
        return Expr(F.when(iso_text == "P", F.lit("P0D")).otherwise(iso_text), STRING)
    if is_string(a.type):
        return Expr(F.when(a.col.rlike(DURATION) & ~a.col.isin("P", "PT"), a.col), STRING)
    return Expr(F.lit(None).cast("string"), STRING)


def duration_part(e: Expr, name: str) -> Expr:
    """Parts of a duration; totals count hours, minutes and seconds only."""
    if not is_string(e.type):
        return Expr(F.lit(None).cast("double"), DOUBLE)
    s = e.col
    good = s.rlike(DURATION) & ~s.isin("P", "PT")

    def part(k):
        return F.coalesce(_group(s, DURATION, k).cast("double"), F.lit(0.0))

    y, mo, d, h, mi, sec = (part(k) for k in range(1, 7))
    if name == "totalseconds":
        return Expr(F.when(good, h * 3600 + mi * 60 + sec), DOUBLE)
    if name == "totalminutes":
        return Expr(F.when(good, h * 60 + mi + sec / 60), DOUBLE)
    whole = {"years": y, "months": mo, "days": d, "hours": h, "minutes": mi, "seconds": F.floor(sec), "milliseconds": F.round((sec - F.floor(sec)) * 1000)}
    return Expr(F.when(good, whole[name]).cast("long"), LONG)


def later(a: Column, b: Column, op: str) -> Column:
    """Comparison of two texts, by time where both are temporal."""
    ma, mb = component(Expr(a, STRING), "temporalepoch").col, component(Expr(b, STRING), "temporalepoch").col
    both = is_temporal(a) & is_temporal(b) & ma.isNotNull() & mb.isNotNull()
    one = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    return F.when(both, one(ma, mb)).otherwise(one(a, b))


__all__ = ["BOOL", "KINDS", "PARTS", "build", "component", "duration", "duration_part", "later", "temporal_epoch"]
