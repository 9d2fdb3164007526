"""Expressions and functions, evaluated without a graph."""

import math

import pytest
from graphs import users

from arcweft import QueryError, register_column_function, register_function
from arcweft.functions.registry import FunctionError


@pytest.fixture(scope="module")
def ask(spark):
    g = users(spark)

    def run(*exprs):
        text = "RETURN " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(exprs))
        return list(g.cypher(text).first())

    return run


def test_arithmetic(ask):
    assert ask("1 + 2 * 3", "2 ^ 3 ^ 2", "7 / 2", "7 % 4", "1 / 0", "5 % 0", "-(3)", "+2", "1 + null", "'a' + 'b'", "'3' + 4", "'x' * 2", "10 - 2 - 3") == [7, 64.0, 3.5, 3, None, None, -3, 2, None, "ab", 7.0, None, 5]


def test_literals(ask):
    assert ask(r"'a\nA\''", '"q"', "1.5e2", "true", "null", "[1, 'x', true]", "{a: 1, b: [2]}.b[0]", "[]") == ["a\nA'", "q", 150.0, True, None, ["1", "x", "true"], 2, []]


def test_lists(ask):
    assert ask("[1,2,3][0]", "[1,2,3][-1]", "[1,2,3][9]", "[1,2,3,4][1..3]", "[1,2,3,4][..-1]", "[1,2,3][2..]", "'hello'[1]", "'hello'[1..-1]") == [1, 3, None, [2, 3], [1, 2, 3], [3], "e", "ell"]
    assert ask("[x IN [1,2,3] WHERE x > 1 | x * 2]", "[c IN 'abc' | toUpper(c)]", "[x IN null | x]", "reduce(s = '', x IN ['a','b'] | s + x)", "reduce(t = 0, x IN [1, 2.5] | t + x)") == [[4, 6], ["A", "B", "C"], [], "ab", 3.5]
    assert ask("[y IN [x IN [1,2] | x + 1] | y * size([1,2])]", "[x IN [1,2] | reduce(s = 0, y IN [10, 20] | s + x * y)]") == [[4, 6], [30, 60]]


def test_quantifiers(ask):
    assert ask("all(x IN [1,2] WHERE x > 0)", "any(x IN [1,2] WHERE x > 1)", "none(x IN [1,2] WHERE x > 2)", "single(x IN [1,2] WHERE x > 1)") == [True, True, True, True]
    assert ask("all(x IN [] WHERE x > 0)", "any(x IN [] WHERE x > 0)", "none(x IN [] WHERE x = 1)", "all(x IN null WHERE x > 0)", "all(x IN [1, null] WHERE x > 0)", "single(c IN 'aab' WHERE c = 'b')") == [True, False, True, False, False, True]


def test_case(ask):
    assert ask("CASE WHEN 1 > 2 THEN 'a' WHEN null THEN 'b' ELSE 'c' END", "CASE 2 WHEN 1 THEN 'x' WHEN 2 THEN 'y' END", "CASE null WHEN null THEN 1 ELSE 2 END", "CASE WHEN false THEN 1 END") == ["c", "y", 1, None]


def test_strings(ask):
    assert ask("toLower('AbC')", "toUpper('é')", "substring('hello', 1, 3)", "substring('hello', 3, 1)", "substring('hello', 2)", "substring('hi', -5, 99)") == ["abc", "É", "el", "el", "llo", "hi"]
    assert ask("split('a.b.c', '.')", "split('abc', '')", "repl('a.a', '.', '-')", "trim('\t x ')", "ltrim('  x ')", "rtrim(' x  ')", "reverse('abc')", "length('abc')", "size([1,2])") == [["a", "b", "c"], ["a", "b", "c"], "a-a", "x", "x ", " x", "cba", 3, 2]
    assert ask("head([1,2])", "last([1,2])", "tail([1,2])", "tail('abc')", "head([])", "head('xy')", "reverse([1,2])", "coalesce(null, 2)") == [1, 2, [2], "bc", None, "x", [2, 1], 2]


def test_conversions(ask):
    assert ask("toString(1.0)", "toString(1.5)", "toString(true)", "toString(12)", "toInteger('12abc')", "toInteger('x')", "toInteger(-2.7)", "toInt(3.9)", "toFloat('2.5kg')", "toFloat('.5')") == ["1", "1.5", "true", "12", 12, None, -2, 3, 2.5, 0.5]
    assert ask("toBoolean('false')", "toBoolean('')", "toBoolean(0)", "toBoolean(3)", "toBoolean(null)", "keys({a: 1, b: null, c: 2})", "keys([1])") == [True, False, False, True, None, ["a", "c"], None]


def test_temporal(ask):
    assert ask("date('2023-06-15')", "date(2023, 13, 1)", "date({year: 2024, month: 2, day: 30})", "date(1672531200)", "datetime(1672531200000)", "datetime('2023-06-15T14:30:45+02:00')") == [
        "2023-06-15", "2024-01-01", "2024-03-01", "2023-01-01", "2023-01-01T00:00:00.000Z", "2023-06-15T12:30:45.000Z"]
    assert ask("time(14, 30, 45)", "time('14:30:45.120')", "localtime(1, 2, 3, 4)", "localdatetime(2023, 1, 2)", "localdatetime({year: 2023, hour: 5})", "timewithzone('14:30:45+02:00')", "datetimewithtimezone('2023-06-15T14:30:45')") == [
        "14:30:45", "14:30:45.120", "01:02:03.004", "2023-01-02T00:00:00", "2023-01-01T05:00:00", "14:30:45+02:00", "2023-06-15T14:30:45Z"]
    assert ask("year('2023-06-15')", "hour('2023-06-15T14:30:45+02:00')", "millisecond('14:30:45.5')", "month(1672531200)", "year('junk')", "timezone('2023-06-15T14:30:45+02:00')", "timezone('2023-06-15')") == [2023, 14, 500, 1, None, "+02:00", None]
    assert ask("epochseconds('1970-01-01T01:00:00+01:00')", "temporalepoch('1970-01-01T01:00:00+01:00')", "epochmillisecond('1970-01-02')", "datetime('junk')") == [3600, 0, 86400000, None]
    assert ask("duration({years: 1, months: 2, days: 3, hours: 4, minutes: 5, seconds: 6})", "duration({})", "duration('P1DT2H')", "duration('P')", "totalSeconds('PT1H30M')", "totalMinutes('PT1H30S')", "duration({milliseconds: 1500})") == [
        "P1Y2M3DT4H5M6S", "P0D", "P1DT2H", None, 5400.0, 60.5, "PT1.5S"]
    assert ask("'2023-01-02T00:00:00+05:00' < '2023-01-01T22:00:00Z'", "'2023-01-02' > '2023-01-01'", "'b' > 'a'") == [True, True, True]
    now = ask("datetime()", "date()", "timestamp()")
    assert len(now[0]) == 24 and now[0].startswith(now[1]) and now[2] > 1_700_000_000


def test_random(ask):
    values = ask(*["random()"] * 20)
    assert all(0 <= v < 1 for v in values) and len(set(values)) > 10 and not math.isnan(sum(values))


def test_registered_functions(spark, ask):
    register_function("mock", "double", lambda x: None if x is None else x * 2, "long")
    register_column_function("mock", "shout", lambda c: c.__class__ and c.substr(1, 1), "string")
    register_function("mock", "sumOrNull", lambda xs: sum(xs) if xs else None, "long")
    assert ask("mock.double(21)", "MOCK.Double(null)", "mock.shout('abc')", "mock.sumornull([1, 2, 3])") == [42, None, "a", 6]
    with pytest.raises(FunctionError):
        register_function("mock", "DOUBLE", lambda x: x)
    with pytest.raises(FunctionError):
        register_function("", "f", lambda x: x)
    with pytest.raises(QueryError):
        ask("mock.nothing(1)")
