"""Script functions: an arithmetic template over ``$1``, ``$2`` becomes a SQL function that Catalyst inlines."""

from __future__ import annotations

import re

from .dialect import DialectError, quote_string

_TOKEN = re.compile(r"\s*(?:(\$\{?\d+\}?)|(\d+\.?\d*(?:[eE][+-]?\d+)?)|([-+*/()])|(true|false|null)\b|(.))", re.I | re.S)


def compile_script(text: str) -> tuple[int, str, str]:
    """Number of parameters, result type and SQL body. What isn't arithmetic is a text template."""
    count = max((int(n) for n in re.findall(r"\$\{?(\d+)", text)), default=0)
    try:
        return count, "DOUBLE", _arithmetic(text)
    except DialectError:
        parts = [f"p{m.strip('${}')}" if m.startswith("$") else quote_string(m) for m in re.split(r"(\$\{\d+\}|\$\d+)", text) if m]
        return count, "STRING", f"concat({', '.join(parts)})" if parts else "''"


def _arithmetic(text: str) -> str:
    tokens = [m.groups() for m in _TOKEN.finditer(text.strip())]
    at = 0

    def peek() -> str:
        return tokens[at][2] or "" if at < len(tokens) else ""

    def primary() -> str:
        nonlocal at
        if at >= len(tokens):
            raise DialectError("the script ends too soon")
        parameter, number, op, word, other = tokens[at]
        at += 1
        if other:
            raise DialectError(f"{other!r} is not arithmetic")
        if parameter:
            return f"try_cast(p{parameter.strip('${}')} AS DOUBLE)"
        if number:
            return f"{number}D" if "e" not in number.lower() else f"cast({number} AS DOUBLE)"
        if word:
            return {"true": "1D", "false": "0D", "null": "cast(NULL AS DOUBLE)"}[word.lower()]
        if op in "-+":
            return f"({op}{primary()})"
        if op == "(":
            out = total()
            if peek() != ")":
                raise DialectError("a parenthesis is not closed")
            at += 1
            return f"({out})"
        raise DialectError(f"unexpected {op!r}")

    def product() -> str:
        nonlocal at
        out = primary()
        while peek() in ("*", "/") and peek():
            op = peek()
            at += 1
            right = primary()
            out = f"({out} * {right})" if op == "*" else f"try_divide({out}, {right})"
        return out

    def total() -> str:
        nonlocal at
        out = product()
        while peek() in ("+", "-") and peek():
            op = peek()
            at += 1
            out = f"({out} {op} {product()})"
        return out

    out = total()
    if at < len(tokens):
        raise DialectError("more follows the expression")
    return out


def create_statement(name: str, text: str, description: str = "") -> str:
    """CREATE TEMPORARY FUNCTION xx_name; parameters are texts or numbers, cast inside."""
    count, kind, body = compile_script(text)
    parameters = ", ".join(f"p{i} STRING" for i in range(1, count + 1))
    return f"CREATE OR REPLACE TEMPORARY FUNCTION xx_{re.sub(r'^xx_', '', name)}({parameters}) RETURNS {kind} COMMENT {quote_string(description)} RETURN {body}"
