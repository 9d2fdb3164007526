"""Format-preserving pseudonyms for personal data.

E-mail names, telephone, card and social security numbers, IPv4 addresses and dates are found by pattern,
validated (Luhn sum, octets, number areas, calendar), and permuted within their format by a keyed Feistel
network: a value is a vector of numbers, each below its own limit, whose halves take turns being shifted by
a keyed SHA-256 of the other half.  A permutation gives every value one pseudonym and every pseudonym one
value, so equal values stay linked across documents, and a pseudonym is valid again: cards get their check
digit, numbers avoid unused areas, dates walk the permutation until they are calendar days of 1900 to 2099.

The key is the secret: whoever has it can undo the pseudonyms.  It is an argument without a default; the
registered query and the pipeline read it from the session's ``spark.arcweft.pii.key``, and make up a random one
for the session where that is unset, so that nothing is ever permuted with a key that others know.

Everything is DataFrame expressions in the row; nothing is shuffled.

Edge cases: a null text stays null; texts without a digit or @ are passed on as they are; numbers that don't
validate stay; several values in a row, at either end, or repeated are all replaced; texts are read whole.
"""

from __future__ import annotations

import secrets
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names

ROUNDS = 6
#: Session setting that holds the secret which selects the permutation.
SETTING = "spark.arcweft.pii.key"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# fixed values: patterns of the kinds, in the order in which they are tried
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9][A-Za-z0-9-]{0,62}){1,8}",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){3}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)"
    r"|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w|-\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/]|[.-]\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Days of 1900 to 2099, and the least number whose square is not below.
DAYS, SIDE = 73049, 271


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def feistel(values: str, limits: str, kind: str, key: str, rounds: int = ROUNDS) -> str:
    """SQL: the array of longs ``values``, each below its limit, permuted."""
    half = "cast(size(v) / 2 as int)"
    other = f"if(r % 2 = 0, slice(v, {half} + 1, size(v)), slice(v, 1, {half}))"
    shift = "cast(conv(substring(sha2(concat_ws('|', {key}, {kind}, r, i, o), 256), 1, 12), 16, 10) as bigint)".format(key=f"'{key}'", kind=f"'{kind}'")
    step = f"transform(v, (x, i) -> if((i < {half}) = (r % 2 = 0), pmod(x + {shift}, m[i]), x))"
    turn = _let("o", f"array_join({other}, ',')", step)
    return _let("m", limits, f"aggregate(sequence(0, {rounds - 1}), {values}, (v, r) -> {turn})")


def _letters(text: str, kind: str, key: str) -> str:
    """SQL: digits, small and capital letters of a text permuted, each within its kind and at its place."""
    chars = f"filter(split({text}, ''), c -> c <> '')"
    base = "case when {c} between '0' and '9' then 48 when {c} between 'a' and 'z' then 97 when {c} between 'A' and 'Z' then 65 else -1 end"
    values = f"transform(q, c -> cast(if({base.format(c='c')} < 0, 0, ascii(c) - {base.format(c='c')}) as bigint))"
    limits = "transform(q, c -> cast(case when c between '0' and '9' then 10 when c between 'a' and 'z' or c between 'A' and 'Z' then 26 else 1 end as bigint))"
    back = f"zip_with(q, {feistel(values, limits, kind, key)}, (c, x) -> if({base.format(c='c')} < 0, c, char({base.format(c='c')} + x)))"
    return _let("q", chars, f"array_join({back}, '')")


def _luhn(digits: str, doubled: int) -> str:
    """SQL: the Luhn sum of a string of digits; the digit at the right end is doubled if ``doubled`` is 0."""
    return (
        f"aggregate(transform(filter(split(reverse({digits}), ''), c -> c <> ''), (c, i) -> if(i % 2 = {doubled}, cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0), cast(c as int))), 0, (a, x) -> a + x)"
    )


def _email(t: str, key: str) -> str:
    return f"concat({_letters(f'''substring_index({t}, '@', 1)''', 'email', key)}, '@', substring_index({t}, '@', -1))"


def _phone(t: str, key: str) -> str:
    code = rf"regexp_extract({t}, r'^(\+\d{{1,3}}[ .-]|\+\d{{1,3}}(?=\()|\+)', 0)"
    return _let("p", code, f"concat(p, {_letters(f'substring({t}, length(p) + 1)', 'phone', key)})")


def _card(t: str, key: str) -> str:
    fresh = _let("b", _letters(f"substring({t}, 1, length({t}) - 1)", "card", key), f"concat(b, pmod(10 - pmod({_luhn('''regexp_replace(b, '[ -]', '')''', 0)}, 10), 10))")
    return _let("g", f"regexp_replace({t}, '[ -]', '')", f"if({_luhn('g', 1)} % 10 = 0 and g rlike '[1-9]', {fresh}, {t})")


def _ip(t: str, key: str) -> str:
    values = f"transform(split({t}, r'\\.'), x -> cast(x as bigint))"
    return f"array_join(transform({feistel(values, 'array_repeat(256L, 4)', 'ip', key)}, x -> cast(x as string)), '.')"


def _ssn(t: str, key: str) -> str:
    area = "cast(substring({t}, 1, 3) as bigint)".format(t=t)
    parts = f"array({area} - if({area} > 666, 2, 1), cast(substring({t}, 5, 2) as bigint) - 1, cast(substring({t}, 8, 4) as bigint) - 1)"
    back = "concat(lpad(cast(n[0] + if(n[0] >= 665, 2, 1) as string), 3, '0'), '-', lpad(cast(n[1] + 1 as string), 2, '0'), '-', lpad(cast(n[2] + 1 as string), 4, '0'))"
    valid = f"{area} between 1 and 899 and {area} <> 666 and substring({t}, 5, 2) <> '00' and substring({t}, 8, 4) <> '0000'"
    return f"if({valid}, {_let('n', feistel(parts, 'array(898L, 99L, 9999L)', 'ssn', key), back)}, {t})"


def _date(t: str, key: str) -> str:
    def walk(fmt: str) -> str:
        day = f"datediff(try_to_date({t}, '{fmt}'), date'1900-01-01')"
        permuted = feistel(f"array(cast(s.d div {SIDE} as bigint), cast(s.d % {SIDE} as bigint))", f"array({SIDE}L, {SIDE}L)", "date", key)
        once = _let("w", permuted, f"named_struct('d', w[0] * {SIDE} + w[1], 'n', s.n + 1)")
        again = f"aggregate(sequence(1, 12), named_struct('d', cast(u as bigint), 'n', 0), (s, k) -> if(s.n > 0 and s.d < {DAYS}, s, {once}))"
        # a walk of 12 steps outside the calendar has probability 1e-27; such a day would stay
        named = _let("z", again, f"if(z.d < {DAYS}, date_format(date_add(date'1900-01-01', cast(z.d as int)), '{fmt}'), {t})")
        return _let("u", day, f"if(u between 0 and {DAYS - 1}, {named}, cast(null as string))")

    return f"case when {t} like '%-%' then coalesce({walk('yyyy-MM-dd')}, {t}) when {t} like '%/%' then coalesce({walk('MM/dd/yyyy')}, {walk('dd/MM/yyyy')}, {t}) else coalesce({walk('dd.MM.yyyy')}, {t}) end"


def _pseudonym(t: str, key: str) -> str:
    whole = {k: "^(?:" + p + ")$" for k, p in PATTERNS.items()}
    kinds = {"email": _email, "ip": _ip, "phone": _phone, "card": _card, "ssn": _ssn, "date": _date}
    # an e-mail has an @, and the other kinds tell each other apart by their whole form
    cases = [f"when instr({t}, '@') > 0 then {_email(t, key)}"]
    cases += [f"when {t} rlike r'{whole[k]}' then {kinds[k](t, key)}" for k in ("ip", "ssn", "date", "card", "phone")]
    return f"case {' '.join(cases)} else {t} end"


def session_key(spark: SparkSession) -> str:
    """The session's key; a random one is set, with a warning, where it has none."""
    key = spark.conf.get(SETTING, None)
    if not key:
        warnings.warn(f"{SETTING} is not set: pseudonyms of this session can't be linked with those of others", stacklevel=2)
        key = secrets.token_hex(16)
        spark.conf.set(SETTING, key)
    return key


def pseudonyms(text: str, key: str, pairs_name: str = "pairs") -> tuple[str, str]:
    """SQL of a text column with pseudonyms in place, and of the array of (value, pseudonym) in text order.

    The first one reads the second as a column of the name ``pairs_name``.
    """
    if not key or "'" in key or "\\" in key:
        raise ValueError("a key is needed; it may hold no quote and no backslash")
    found = f"transform(regexp_extract_all({text}, r'{ANY}', 0), t -> named_struct('value', t, 'pseudonym', {_pseudonym('t', key)}))"
    has = f"{text} rlike '[0-9@]' and {text} rlike r'{ANY}'"
    pairs = f"case when {has} then {found} else array() end"
    joined = f"array_join(zip_with(split({text}, r'{ANY}', -1), {pairs_name}.pseudonym, (s, p) -> concat(s, coalesce(p, ''))), '')"
    return f"case when size({pairs_name}) > 0 then {joined} else {text} end", pairs


def pseudonymised(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    """All columns with ``text`` replaced, and one more: the values and pseudonyms in text order; and its name."""
    (name,) = free_names(docs, "pairs")
    text, pairs = pseudonyms("text", key, name)
    return docs.withColumn(name, F.expr(pairs)).withColumn("text", F.expr(text)), name


def without_pii(docs: DataFrame, key: str) -> DataFrame:
    """The documents with pseudonyms in their texts; n_chars, where there is one, is counted anew."""
    out, pairs = pseudonymised(docs, key)
    out = out.drop(pairs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def pii_report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_found, n_replaced, text (with pseudonyms) of every document."""
    out, pairs = pseudonymised(docs.select("doc_id", "text"), key)
    changed = F.size(F.filter(pairs, lambda x: x["value"] != x["pseudonym"]))
    return out.select("doc_id", F.size(pairs).cast("long").alias("n_found"), changed.cast("long").alias("n_replaced"), "text")
