"""Exclude patterns: text to a parsed pattern, a regular expression, a Column.

A pattern is `[!][/]body[/]`: `!` includes again, a leading `/` anchors the body
at the root, a trailing `/` restricts it to directories. In a body, `*` is any
run and `?` any one character inside a component, `[...]` a class (only `^`
negates; a leading `]` is literal; a reversed range holds nothing; never `/`),
`\\` quotes. `**` as a whole component is zero or more components, at the end
one or more. Of the patterns of a list the last one that matches decides.

The expressions use what Java's and RE2's dialects share.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = set("*?[\\")
_NOTHING = "[^\\x{0}-\\x{10FFFF}]"


class PatternError(ValueError):
    """A pattern that cannot be used."""


@dataclass(frozen=True)
class Pattern:
    body: str
    anchored: bool = False
    dir_only: bool = False
    include: bool = False

    @property
    def literal(self) -> bool:
        return not _META & set(self.body)

    @property
    def regex(self) -> str:
        return f"(?s)^{'' if self.anchored else '(?:.*/)?'}(?:{glob_regex(self.body)})\\z"

    def __str__(self) -> str:
        return f"{'!' if self.include else ''}{'/' if self.anchored else ''}{self.body}{'/' if self.dir_only else ''}"

    def matches(self, path: str, is_dir: bool) -> bool:
        """The same in Python, for tests and single paths."""
        if not path or self.dir_only and not is_dir:
            return False
        if self.literal:
            return path == self.body or not self.anchored and path.endswith("/" + self.body)
        found = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", self.regex).replace("\\z", "\\Z")
        return re.search(found, path) is not None

    def column(self, path: Column, is_dir: Column) -> Column:
        if self.literal:
            hit = path == F.lit(self.body)
            if not self.anchored:
                hit = hit | F.endswith(path, F.lit("/" + self.body))
        else:
            hit = (path != F.lit("")) & path.rlike(self.regex)
        return hit & is_dir if self.dir_only else hit

    def sql(self, path: str, is_dir: str) -> str:
        """The same test in DuckDB's SQL."""
        q = lambda s: "'" + s.replace("'", "''") + "'"
        if self.literal:
            hit = f"({path} = {q(self.body)}" + ("" if self.anchored else f" or ends_with({path}, {q('/' + self.body)})") + ")"
        else:
            hit = f"({path} <> '' and regexp_matches({path}, {q(self.regex)}))"
        return f"({hit} and {is_dir})" if self.dir_only else hit


def parse(text: str) -> Pattern:
    body = text
    include = body.startswith("!")
    body = body[include:]
    anchored = body.startswith("/")
    body = body[anchored:]
    dir_only = body.endswith("/")
    body = body[:-1] if dir_only else body
    if not body or "\0" in body or "\n" in body:
        raise PatternError(f"empty pattern, NUL or newline: {text!r}")
    found = Pattern(body, anchored, dir_only, include)
    if not found.literal:
        glob_regex(body)
    return found


def quoted(c: str) -> str:
    return c if c.isalnum() and c.isascii() or c in "_/-" else f"\\x{{{ord(c):X}}}"


def _class(body: str, at: int) -> tuple[str, int]:
    """A class that starts after its bracket: its expression and where it ends."""
    negated = body[at : at + 1] == "^"
    at += negated
    ranges: list[tuple[int, int]] = []
    first = True

    def one(at: int) -> tuple[int, int]:
        if body[at : at + 1] == "\\":
            at += 1
        if at >= len(body):
            raise PatternError(f"unterminated class: {body!r}")
        return ord(body[at]), at + 1

    while True:
        if at >= len(body):
            raise PatternError(f"unterminated class: {body!r}")
        if body[at] == "]" and not first:
            at += 1
            break
        first = False
        low, at = one(at)
        if body[at : at + 1] == "-" and body[at + 1 : at + 2] not in ("]", ""):
            high, at = one(at + 1)
        else:
            high = low
        if low <= high:
            ranges.append((low, high))
    slash = ord("/")
    if negated:
        ranges.append((slash, slash))
    else:
        ranges = [r for a, b in ranges for r in ([(a, min(b, slash - 1)), (max(a, slash + 1), b)] if a <= slash <= b else [(a, b)]) if r[0] <= r[1]]
        if not ranges:
            return _NOTHING, at
    inside = "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in ranges)
    return f"[{'^' if negated else ''}{inside}]", at


def glob_regex(body: str) -> str:
    """The expression for a body, without anchors."""
    parts: list[str] = [""]
    whole: list[str] = [""]
    at = 0
    while at < len(body):
        c = body[at]
        start = at
        at += 1
        if c == "/":
            parts.append("")
            whole.append("")
            continue
        if c == "*":
            parts[-1] += "[^/]*"
        elif c == "?":
            parts[-1] += "[^/]"
        elif c == "[":
            made, at = _class(body, at)
            parts[-1] += made
        elif c == "\\":
            if at >= len(body):
                raise PatternError(f"trailing backslash: {body!r}")
            parts[-1] += _NOTHING if body[at] == "/" else quoted(body[at])
            at += 1
        else:
            parts[-1] += quoted(c)
        whole[-1] += body[start:at]
    out, n = "", len(parts)
    for i, (part, text) in enumerate(zip(parts, whole)):
        last = i == n - 1
        if text == "**":
            if last:
                out += "[^/]+(?:/[^/]+)*"
            elif whole[i + 1] != "**":
                out += "(?:[^/]+/)*"
        else:
            out += part + ("" if last else "/")
    return out


def parse_all(texts: Sequence[str]) -> list[Pattern]:
    return [parse(x) for x in texts]


def excluded(patterns: Sequence[Pattern], path: Column, is_dir: Column) -> Column:
    """Whether the last matching pattern excludes; no match keeps."""
    out = None
    for p in reversed(patterns):
        hit = p.column(path, is_dir)
        out = F.when(hit, F.lit(not p.include)) if out is None else out.when(hit, F.lit(not p.include))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def excluded_sql(patterns: Sequence[Pattern], path: str, is_dir: str) -> str:
    if not patterns:
        return "false"
    return "case " + " ".join(f"when {p.sql(path, is_dir)} then {str(not p.include).lower()}" for p in reversed(patterns)) + " else false end"


def ancestors(path: Column) -> Column:
    """The proper ancestors of a path, the shallowest first, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))


def pruned(patterns: Sequence[Pattern], path: Column, is_dir: Column, veto: Callable[[Column, Column], Column] | None = None) -> Column:
    """Whether a node or any directory above it is excluded; an expression, no join."""

    def verdict(p: Column, d: Column) -> Column:
        out = excluded(patterns, p, d)
        return out | veto(p, d) if veto else out

    return verdict(path, is_dir) | F.exists(ancestors(path), lambda a: verdict(a, F.lit(True)))
