"""Checks for user-defined functions: each returns its argument or raises FunctionError with the function's name."""

from __future__ import annotations

from .registry import FunctionError


def arity(name: str, args, least: int, most: int | None = None):
    """The arguments, if there are at least ``least`` and at most ``most`` of them."""
    most = least if most is None else most
    if not least <= len(args) <= most:
        raise FunctionError(f"{name}() takes {least if least == most else f'{least} to {most}'} arguments, not {len(args)}")
    return args


def _need(name: str, value, kinds, what: str, nullable: bool):
    if value is None and nullable:
        return None
    if isinstance(value, bool) and bool not in kinds or not isinstance(value, kinds):
        raise FunctionError(f"{name}() needs {what}, not {value!r}")
    return value


def number(name: str, value, nullable: bool = True):
    return _need(name, value, (int, float), "a number", nullable)


def string(name: str, value, nullable: bool = True):
    return _need(name, value, (str,), "a string", nullable)


def boolean(name: str, value, nullable: bool = True):
    return _need(name, value, (bool,), "a boolean", nullable)


def array(name: str, value, nullable: bool = True):
    return _need(name, value, (list, tuple), "a list", nullable)


def numbers(name: str, value, nullable: bool = True):
    """A list of numbers; nulls in it are left out."""
    got = array(name, value, nullable)
    return None if got is None else [number(name, x, False) for x in got if x is not None]
