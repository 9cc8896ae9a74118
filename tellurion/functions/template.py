"""Templates of label_format and line_format as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.syntax import QueryError, split_top, unquote

_ACTION = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}", re.S)
Resolve = Callable[[str], Column]


def fields(template: str) -> list[str]:
    """Names of the fields that a template reads, dots as underscores."""
    out = []
    for action in _ACTION.findall(template):
        bare = re.sub(r'"(?:\\.|[^"\\])*"|`[^`]*`', '""', action)
        out += [m.replace(".", "_") for m in re.findall(r"(?<![\w)])\.([A-Za-z_][\w.]*)", bare)]
        out += [".".join(re.findall(r'"([^"]*)"', m)) for m in re.findall(r'index\s+\.\s+((?:"[^"]*"\s*)+)', action)]
    return list(dict.fromkeys(out))


def compile_template(template: str, resolve: Resolve) -> Column:
    """The template's text per row; absent and null fields count as ''."""
    parts, at = [], 0
    for m in _ACTION.finditer(template):
        if m.start() > at:
            parts.append(("text", template[at : m.start()]))
        parts.append(("action", m[1]))
        at = m.end()
    if at < len(template):
        parts.append(("text", template[at:]))
    column, rest = _sequence(parts, resolve)
    if rest:
        raise QueryError(f"unexpected {{{{ {rest[0][1]} }}}}")
    return column


def _sequence(parts: list, resolve: Resolve) -> tuple[Column, list]:
    out = []
    while parts:
        kind, text = parts[0]
        if kind == "action" and (text in ("end", "else") or text.startswith("else ")):
            break
        parts = parts[1:]
        if kind == "text":
            out.append(F.lit(text))
        elif text.startswith("if "):
            column, parts = _branch(text[3:], parts, resolve)
            out.append(column)
        elif text and not text.startswith("/*"):
            out.append(_string(_pipe(text, resolve)))
    return (F.concat(*out) if out else F.lit("")), parts


def _branch(condition: str, parts: list, resolve: Resolve) -> tuple[Column, list]:
    then, parts = _sequence(parts, resolve)
    other = F.lit("")
    if parts and parts[0][1].startswith("else if "):
        other, parts = _branch(parts[0][1][8:], parts[1:], resolve)
        return F.when(_truth(_pipe(condition, resolve)), then).otherwise(other), parts
    if parts and parts[0][1] == "else":
        other, parts = _sequence(parts[1:], resolve)
    if not parts or parts[0][1] != "end":
        raise QueryError("{{ if }} without {{ end }}")
    return F.when(_truth(_pipe(condition, resolve)), then).otherwise(other), parts[1:]


def _string(value: tuple[str, Column]) -> Column:
    return F.coalesce(value[1].cast("string"), F.lit(""))


def _truth(value: tuple[str, Column]) -> Column:
    return F.coalesce(value[1], F.lit(False)) if value[0] == "bool" else _string(value) != ""


def _pipe(text: str, resolve: Resolve) -> tuple[str, Column]:
    value = None
    for command in split_top(text, "|"):
        value = _command(command.strip(), value, resolve)
    return value


def _words(text: str) -> list[str]:
    return re.findall(r'"(?:\\.|[^"\\])*"|`[^`]*`|\((?:[^()"]|"[^"]*")*\)|[^\s()]+', text)


def _argument(word: str, resolve: Resolve) -> tuple[str, Column]:
    if word[0] in '"`':
        return "str", F.lit(unquote(word))
    if word[0] == "(":
        return _pipe(word[1:-1], resolve)
    if re.fullmatch(r"-?\d+(\.\d+)?", word):
        return "str", F.lit(word)
    if word in ("true", "false"):
        return "bool", F.lit(word == "true")
    if word.startswith(".") and len(word) > 1:
        return "str", F.coalesce(resolve(word[1:].replace(".", "_")).cast("string"), F.lit(""))
    raise QueryError(f"unsupported template expression {word!r}")


def _command(text: str, previous, resolve: Resolve) -> tuple[str, Column]:
    words = _words(text)
    if not words:
        raise QueryError("empty template expression")
    name = words[0]
    if name == "index":
        if words[1:2] != ["."]:
            raise QueryError("index takes . first")
        return "str", F.coalesce(resolve(".".join(unquote(w) for w in words[2:])).cast("string"), F.lit(""))
    if name[0] in '."`(-0123456789':
        return _argument(name, resolve)
    args = [_argument(w, resolve) for w in words[1:]] + ([previous] if previous is not None else [])
    texts = [_string(a) for a in args]
    one = {"lower": F.lower, "upper": F.upper, "trim": F.trim, "len": lambda c: F.coalesce(F.json_array_length(c), F.length(c))}
    two = {
        "hasPrefix": lambda p, s: s.startswith(p), "hasSuffix": lambda p, s: s.endswith(p), "contains": lambda p, s: s.contains(p),
        "match": lambda p, s: F.regexp_like(s, p), "eq": lambda a, b: a == b, "ne": lambda a, b: a != b,
    }
    if name in one and len(texts) == 1:
        return "str", one[name](texts[0])
    if name in two and len(texts) == 2:
        return "bool", two[name](*texts)
    if name in ("and", "or") and len(args) == 2:
        a, b = map(_truth, args)
        return "bool", (a & b) if name == "and" else (a | b)
    if name == "not" and len(args) == 1:
        return "bool", ~_truth(args[0])
    raise QueryError(f"unsupported template function {name!r} with {len(args)} arguments")
