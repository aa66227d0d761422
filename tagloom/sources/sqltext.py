"""``#name`` parameters of user SQL and formulas."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any, Protocol

from ..spec import Param

# A quoted literal, a comment, or a whole #name outside both.
_TOKENS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|#(\w+)", re.S)
_NAME = re.compile(r"#(\w+)")


def replace_names(text: str, known: Iterable[str], write: Callable[[str], str]) -> str:
    """Rewrite every unquoted ``#name`` of ``known``; other tokens stay as they are."""
    names = set(known)
    return _TOKENS.sub(lambda m: write(m[1]) if m[1] in names else m[0], text)


def constant(param: Param) -> Any:
    """Python value of a constant parameter by its declared type, with the lenient zero for bad numbers."""
    value = param.value
    if param.type == "int":
        try:
            return int(str(value).strip())
        except ValueError:
            return 0
    if param.type == "double":
        try:
            return float(str(value).strip())
        except ValueError:
            return 0.0
    if param.type == "date":
        return parse_date(value)
    return value


def parse_date(value: Any) -> dt.datetime | None:
    """Date of a parameter: epoch milliseconds, ``yyyy-MM-dd HH:mm:ss`` or ``yyyy-MM-dd``, else None."""
    if value is None or isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime.combine(value, dt.time())
    text = str(value).strip()
    if re.fullmatch(r"[0-9]+", text):
        return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=int(text))
    for form in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            return dt.datetime.strptime(text, form)
        except ValueError:
            continue
    return None


def _unquoted_value(param: Param) -> Any:
    value = constant(param)
    if param.type is None and isinstance(value, str):
        if re.fullmatch(r"[+-]?\d+", value.strip()):
            return int(value)
        if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", value.strip()):
            return float(value)
    return value


def sql_arguments(text: str, params: Iterable[Param]) -> tuple[str, Mapping[str, Any]]:
    """Turn ``#name`` parameters into Spark's named parameters.

    Names match as whole words, so ``#a`` leaves ``#ab`` alone. Inside a quoted literal the parameter is text
    (``'#city'``, ``'%#word%'``); outside it is a typed value.
    """
    by_name = {p.name: p for p in params}
    args: dict[str, Any] = {}

    def bare(name: str) -> str:
        value = _unquoted_value(by_name[name])
        if isinstance(value, dt.datetime):
            args[f"v_{name}"] = value.isoformat(sep=" ")
            return f"cast(:v_{name} AS timestamp_ntz)"
        args[f"v_{name}"] = value
        return f":v_{name}"

    def quoted(literal: str) -> str:
        quote, pieces, at = literal[0], [], 1
        for m in _NAME.finditer(literal, 1, len(literal) - 1):
            if m[1] in by_name:
                if m.start() > at:
                    pieces.append(f"{quote}{literal[at:m.start()]}{quote}")
                value = by_name[m[1]].value
                args[f"t_{m[1]}"] = None if value is None else str(value)
                pieces.append(f":t_{m[1]}")
                at = m.end()
        if not pieces:
            return literal
        if at < len(literal) - 1:
            pieces.append(f"{quote}{literal[at:-1]}{quote}")
        return pieces[0] if len(pieces) == 1 else "concat(" + ", ".join(pieces) + ")"

    def rewrite(m: re.Match) -> str:
        if m[1] is not None:
            return bare(m[1]) if m[1] in by_name else m[0]
        return quoted(m[0]) if m[0][0] in "'\"" else m[0]

    return _TOKENS.sub(rewrite, text), args


class Literals(Protocol):
    """How values are written into the SQL of a database."""

    def literal(self, value: Any) -> str: ...

    def text(self, value: str, quote: str = "'") -> str: ...


def sql_with_literals(text: str, params: Iterable[Param], literals: Literals) -> str:
    """Write ``#name`` parameters into SQL as literals, by the rules of ``sql_arguments``.

    A value can neither end its literal nor become SQL. A quoted literal with a parameter that has no value is ``NULL``.
    """
    by_name = {p.name: p for p in params}

    def quoted(token: str) -> str:
        quote, inside = token[0], token[1:-1]
        held = [by_name[m[1]] for m in _NAME.finditer(inside) if m[1] in by_name]
        if any(p.value is None for p in held):
            return "NULL"
        put = lambda m: literals.text(str(by_name[m[1]].value), quote) if m[1] in by_name else m[0]
        return quote + _NAME.sub(put, inside) + quote

    def rewrite(m: re.Match) -> str:
        if m[1] is not None:
            return literals.literal(_unquoted_value(by_name[m[1]])) if m[1] in by_name else m[0]
        return quoted(m[0]) if m[0][0] in "'\"" else m[0]

    return _TOKENS.sub(rewrite, text.strip().removesuffix(";"))
