"""Log pipelines: parsing of stages and their DataFrame form.

Stages apply in the order written, so a filter after line_format sees the new line. Parsers extract only the keys that
later stages, groupings and unwraps name, which keeps the plan a projection that Catalyst can prune.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.template import compile_template, fields
from ..functions.units import duration_seconds, size_bytes
from .syntax import Matcher, QueryError, Selector, Stage, label_name, split_top, unquote

_LINE = re.compile(r'\s*(\|=|!=|\|~|!~|\|>|!>)\s*("(?:\\.|[^"\\])*"|`[^`]*`)')
_COMPARE = re.compile(r'^\s*([A-Za-z_][\w.]*)\s*(=~|!~|!=|==|>=|<=|=|>|<)\s*("(?:\\.|[^"\\])*"|`[^`]*`|[^\s"`]+)\s*$')
_NO_EFFECT = ("decolorize", "label_replace")
UNWRAPPED = "__unwrap_value"


def parse_stages(text: str) -> tuple[Stage, ...]:
    """The stages of '|= "a" | json | level="x" | ...'."""
    out: list[Stage] = []
    while text.strip():
        m = _LINE.match(text)
        if m:
            op = {"|=": "=", "!=": "!=", "|~": "=~", "!~": "!~", "|>": "=~", "!>": "!~"}[m[1]]
            out.append(Stage("line", ((op, unquote(m[2])),)))
            text = text[m.end() :]
            continue
        text = text.lstrip()
        if not text.startswith("|"):
            raise QueryError(f"expected a pipeline stage, found {text[:20]!r}")
        body = _upto_stage(text[1:])
        text = text[1 + len(body) :]
        out.append(_stage(body.strip()))
    return _merged(out)


def _upto_stage(text: str) -> str:
    """Up to the next stage outside quotes; a line filter may follow without a pipe."""
    quote, depth, i = "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\" and quote != "`":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "({":
            depth += 1
        elif c in ")}":
            depth -= 1
        elif c == "|" and not depth:
            return text[:i]
        elif c == "!" and not depth and _LINE.match(text[i:]) and not re.search(r"[\w.]\s*$", text[:i].rstrip() and text[:i]):
            return text[:i]
        i += 1
    return text


def _pairs(text: str) -> tuple:
    out = []
    for part in split_top(text, ","):
        if part.strip():
            name, _, value = part.partition("=")
            value = value.strip()
            out.append((label_name(name.strip()), unquote(value) if value[:1] in ('"', "`") else "{{ ." + value + " }}"))
    return tuple(out)


def _stage(body: str) -> Stage:
    word, _, rest = body.partition(" ")
    rest = rest.strip()
    if word == "json":
        return Stage("json", tuple((label_name(n.strip()), unquote(v.strip()) if v.strip()[:1] in ('"', "`") else v.strip() or n.strip()) for n, _, v in (p.partition("=") for p in split_top(rest, ",") if p.strip())))
    if word == "logfmt":
        return Stage("logfmt", tuple((label_name(n.strip()), unquote(v.strip()) if v.strip()[:1] in ('"', "`") else v.strip() or n.strip()) for n, _, v in (p.partition("=") for p in split_top(re.sub(r"--[\w-]+", "", rest), ",") if p.strip())))
    if word == "regexp":
        return Stage("regexp", (unquote(rest),))
    if word == "label_format":
        return Stage("label_format", _pairs(rest))
    if word == "line_format":
        return Stage("line_format", (unquote(rest),))
    if word == "unwrap":
        m = re.fullmatch(r"(?:(duration|duration_seconds|bytes)\s*\(\s*([\w.]+)\s*\)|([\w.]+))", rest)
        if not m:
            raise QueryError(f"bad unwrap {rest!r}")
        return Stage("unwrap", (m[1] or "", label_name(m[2] or m[3])))
    if word in ("keep", "drop", "keep_labels", "drop_labels"):
        return Stage(word[:4], tuple(label_name(x.strip()) for x in rest.split(",") if x.strip()))
    if word in _NO_EFFECT:
        return Stage("none", (word,))
    return Stage("filter", (_condition(body),))


def _condition(text: str) -> tuple:
    """('or', ...), ('and', ...) or (name, op, value)."""
    text = text.strip()
    for joiner, pattern in (("or", r"\bor\b"), ("and", r"\band\b|,")):
        parts, depth, quote, last, i = [], 0, "", 0, 0
        while i < len(text):
            c = text[i]
            if quote:
                if c == "\\" and quote != "`":
                    i += 1
                elif c == quote:
                    quote = ""
            elif c in "\"`":
                quote = c
            elif c in "()":
                depth += 1 if c == "(" else -1
            elif not depth and (m := re.compile(pattern).match(text, i)) and (c == "," or text[i - 1 : i].isspace()):
                parts.append(text[last:i])
                last = i = m.end()
                continue
            i += 1
        if parts:
            return (joiner, *[_condition(p) for p in [*parts, text[last:]]])
    if text[:1] == "(" and text[-1:] == ")":
        return _condition(text[1:-1])
    m = _COMPARE.match(text)
    if not m:
        raise QueryError(f"unsupported pipeline stage {text!r}")
    value = unquote(m[3]) if m[3][0] in '"`' else m[3]
    return label_name(m[1]), "=" if m[2] == "==" else m[2], value, m[3][0] in '"`'


def _merged(stages: list[Stage]) -> tuple[Stage, ...]:
    """json after json, or logfmt after logfmt, is one parser."""
    out: list[Stage] = []
    for s in stages:
        if out and s.kind in ("json", "logfmt") and out[-1].kind == s.kind:
            out[-1] = Stage(s.kind, tuple(dict([*out[-1].params, *s.params]).items()))
        else:
            out.append(s)
    return tuple(out)


def condition_names(condition: tuple) -> list[str]:
    if condition[0] in ("or", "and") and isinstance(condition[1], tuple):
        return [n for c in condition[1:] for n in condition_names(c)]
    return [condition[0]]


def needed(stage: Stage) -> list[str]:
    """Labels that a stage reads."""
    if stage.kind == "filter":
        return condition_names(stage.params[0])
    if stage.kind == "unwrap":
        return [stage.params[1]]
    if stage.kind == "label_format":
        return [f for _, t in stage.params for f in fields(t)]
    if stage.kind == "line_format":
        return fields(stage.params[0])
    if stage.kind == "keep":
        return list(stage.params)
    return []


def made(stage: Stage) -> list[str]:
    """Labels that a stage sets by name."""
    if stage.kind in ("json", "logfmt", "label_format"):
        return [n for n, _ in stage.params]
    if stage.kind == "regexp":
        return [n for n in re.findall(r"\(\?P?<(\w+)>", stage.params[0])]
    return []


def matches(column: Column, op: str, value: str, anchored: bool) -> Column:
    """A label or line test. A null never passes; alternations of plain words become a list that pushes down."""
    if op == "=":
        return column == value
    if op == "!=":
        return column != value
    words = re.fullmatch(r"\^?(?:\(\?:|\()?([\w\-|]+)\)?\$?", value)
    if words and (anchored or (value.startswith("^") and value.endswith("$"))) and ("(" in value or "|" not in value or anchored):
        found = column.isin(*words[1].split("|"))
    elif value in (".*", ".+", "^.*$", "^.+$"):
        found = column.isNotNull() if value.strip("^$") == ".*" else column != ""
    else:
        pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", value)
        found = F.regexp_like(column, F.lit(f"^(?:{pattern})$" if anchored else pattern))
    return found if op == "=~" else ~found


def _test(df: DataFrame, condition: tuple) -> Column:
    if condition[0] in ("or", "and") and isinstance(condition[1], tuple):
        out = _test(df, condition[1])
        for c in condition[2:]:
            out = (out | _test(df, c)) if condition[0] == "or" else (out & _test(df, c))
        return out
    name, op, value, quoted = condition
    if name not in df.columns:
        return F.lit(False)
    column = F.col(f"`{name}`")
    if op in (">", ">=", "<", "<=") or (not quoted and op in ("=", "!=")):
        unit = re.fullmatch(r"[\d.]+(ns|us|µs|ms|s|m|h)", value), re.fullmatch(r"(?i)[\d.]+\s*([kmgtpe]?i?b)", value)
        number = duration_seconds(column) if unit[0] else size_bytes(column) if unit[1] else column.try_cast("double")
        limit = duration_seconds(F.lit(value)) if unit[0] else size_bytes(F.lit(value)) if unit[1] else F.lit(value).try_cast("double")
        return {">": number > limit, ">=": number >= limit, "<": number < limit, "<=": number <= limit, "=": number == limit, "!=": number != limit}[op]
    return matches(column.cast("string"), op, value, anchored=False)


def json_path(key: str) -> str:
    """A label's path: dots and brackets as written, other odd names as one quoted member."""
    return "$." + key if re.fullmatch(r"[\w\[\].]+", key) else f"$['{key}']"


def apply_selector(df: DataFrame, selector: Selector, extra: tuple[str, ...] = (), body: str = "log_message", lines: bool = True) -> DataFrame:
    """Matchers and stages of a selector over a table of log lines or spans; `extra` are labels that the caller needs."""
    waiting = []
    for m in selector.matchers:
        if m.label in df.columns:
            df = df.where(matches(F.col(f"`{m.label}`"), m.op, m.value, anchored=False))
        elif any(m.label in made(s) or s.kind in ("json", "logfmt") for s in selector.stages):
            waiting.append(m)  # a label that a stage makes is tested right after it
        else:
            return df.where(F.lit(False))
    original = set(df.columns)
    for k, stage in enumerate(selector.stages):
        later = [n for s in selector.stages[k:] for n in needed(s)] + list(extra) + [m.label for m in waiting]
        if stage.kind == "line":
            if lines:
                for op, value in stage.params:
                    text = F.col(body)
                    found = text.contains(value) if op in ("=", "!=") else F.regexp_like(text, F.lit(value))
                    df = df.where(~found if op.startswith("!") else found)
        elif stage.kind in ("json", "logfmt"):
            set_later = {n for s in selector.stages[k + 1 :] for n in made(s)}
            keys = dict(stage.params) | {n: n for n in later if n not in original and n not in dict(stage.params) and n not in set_later}
            columns = {}
            for name, source in keys.items():
                if stage.kind == "json":
                    first = F.get_json_object(body, json_path(source))
                    columns[name] = first if source != name or "_" not in name else F.coalesce(first, F.get_json_object(body, "$." + name.replace("_", ".")))
                else:
                    columns[name] = F.regexp_extract(body, rf"(?:^|\s){re.escape(source)}=([^\s]+)", 1)
            df = df.withColumns(columns) if columns else df
        elif stage.kind == "regexp":
            pattern, names = stage.params[0], made(stage)
            groups = _group_numbers(pattern)
            pattern = re.sub(r"\(\?P?<(\w+)>", "(", pattern)
            df = df.withColumns({label_name(n): F.regexp_extract(body, pattern, groups[n]) for n in names})
        elif stage.kind == "label_format":
            resolve = _resolver(df)
            df = df.withColumns({n: compile_template(t, resolve) for n, t in sorted(stage.params)})
        elif stage.kind == "line_format":
            if stage.params[0]:
                df = df.withColumn(body, compile_template(stage.params[0], _resolver(df)))
        elif stage.kind == "filter":
            df = df.where(_test(df, stage.params[0]))
        elif stage.kind == "unwrap":
            kind, name = stage.params
            column = F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")
            value = duration_seconds(column) if kind.startswith("duration") else size_bytes(column) if kind == "bytes" else column.try_cast("double")
            # a generated column: filters and aggregates on it do not work out the parsing again, as those on a projection do
            df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != UNWRAPPED], F.explode(F.array(value)).alias(UNWRAPPED))
        elif stage.kind == "drop":
            df = df.drop(*stage.params)
        elif stage.kind == "keep":
            core = [c for c in df.columns if c.startswith("chq_") or c in (body, "log_level", UNWRAPPED)]
            df = df.select(*dict.fromkeys([*core, *[c for c in stage.params if c in df.columns]]))
        for m in [m for m in waiting if m.label in df.columns]:
            df = df.where(matches(F.col(f"`{m.label}`").cast("string"), m.op, m.value, anchored=False))
            waiting.remove(m)
    return df.where(F.lit(False)) if waiting else df


def _resolver(df: DataFrame):
    have = set(df.columns)
    return lambda name: F.col(f"`{name}`") if name in have else F.lit(None).cast("string")


def _group_numbers(pattern: str) -> dict[str, int]:
    """Numbers of named groups, counting every capturing group."""
    out, n, i, in_class = {}, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            named = re.match(r"\(\?P?<(\w+)>", pattern[i:])
            if named or pattern[i + 1 : i + 2] != "?":
                n += 1
                if named:
                    out[named[1]] = n
        i += 1
    return out


def matcher_column(matcher: Matcher) -> Column:
    """A metric label matcher: regular expressions are anchored."""
    return matches(F.col(f"`{matcher.label}`"), matcher.op, matcher.value, anchored=True)
