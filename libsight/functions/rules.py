"""Plan-time parsers for the small rule languages; each yields Column expressions.

Rules are short user settings, so they are parsed once in Python and become
ordinary predicates and replacements that Catalyst can push down and compile.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from libsight.functions.text import col, strip


def matches_query(text: Column | str, query: str) -> Column:
    """``a && b``, ``a || b`` or a plain substring, ignoring case; blank is true."""
    query = query.strip().lower()
    haystack = F.lower(F.coalesce(col(text), F.lit("")))
    if "&&" in query:
        parts, all_of = query.split("&&"), True
    elif "||" in query:
        parts, all_of = query.split("||"), False
    else:
        parts, all_of = [query], True
    tests = [F.contains(haystack, F.lit(p.strip())) for p in parts if p.strip()]
    if all_of:
        out = F.lit(True)
        for test in tests:
            out = out & test
        return out
    if len(tests) < len(parts):  # an empty part matches everything
        return F.lit(True)
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def _delimited(rule: str) -> tuple[str, str] | None:
    """(pattern, flags) of a ``/pattern/flags`` rule, else None."""
    end = rule.rfind("/")
    return (rule[1:end], rule[end + 1:]) if rule.startswith("/") and end > 0 else None


def _groups(pattern: str) -> int:
    """Number of capture groups; raises ``re.error`` on an invalid pattern."""
    return re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern)).groups


def _check_flags(flags: str) -> None:
    if not set(flags) <= set("gimsuy") or len(set(flags)) != len(flags):
        raise re.error(f"unknown flags {flags!r}")


def _inline(flags: str) -> str:
    kept = "".join(f for f in flags if f in "ims")
    return f"(?{kept})" if kept else ""


@dataclass(frozen=True)
class Rewrite:
    """One replacement rule: a literal, or a pattern with flags."""

    source: str
    target: str
    flags: str | None = None

    def apply(self, text: Column) -> Column:
        if self.flags is None:
            return F.replace(text, F.lit(self.source), F.lit(self.target)) if self.source else text
        if "g" in self.flags:
            return F.regexp_replace(text, _inline(self.flags) + self.source,
                                    _java_target(self.target, 0, _groups(self.source)))
        # First match only: anchor at the start, skip lazily, keep what was skipped.
        shifted = re.sub(r"\\([1-9]\d*)", lambda m: rf"\{int(m[1]) + 2}", self.source)
        flags = _inline(self.flags)
        pattern = rf"\A([\s\S]*?)({flags}{shifted})"
        return F.regexp_replace(
            text, pattern, "$1" + _java_target(self.target, 2, _groups(self.source)))


def _java_target(target: str, shift: int, groups: int) -> str:
    def one(m: re.Match[str]) -> str:
        token = m[0]
        if token == "$$":
            return r"\$"
        if token == "$&":
            return f"${shift}"
        if token.startswith("$") and 0 < int(token[1:]) <= groups:
            return f"${int(token[1:]) + shift}"
        return token.replace("\\", r"\\").replace("$", r"\$")
    return re.sub(r"\$\$|\$&|\$[0-9]|[\\$]", one, target)


def parse_rewrites(source: str) -> list[Rewrite]:
    """Rules ``A=B, /re/flags=C``; a comma inside a pattern does not separate."""
    rules = []
    for part in re.split(r",(?![^/]*/[^/]*=)", source):
        left, eq, right = part.partition("=")
        left, right = left.strip(), right.strip()
        if not eq:
            continue
        delimited = _delimited(left)
        if delimited:
            pattern, flags = delimited
            try:
                _check_flags(flags)
                _groups(pattern)
                rules.append(Rewrite(pattern, right, flags))
                continue
            except re.error:
                pass  # an invalid pattern is taken literally
        rules.append(Rewrite(left, right))
    return rules


def rewrite(text: Column | str, rules: str | list[Rewrite]) -> Column:
    """Apply the rules in order and trim."""
    out = col(text)
    for rule in parse_rewrites(rules) if isinstance(rules, str) else rules:
        out = rule.apply(out)
    return strip(out)


@dataclass(frozen=True)
class TagRule:
    """A parsed tag rule: which tags it takes and what they are shown as."""

    takes: Callable[[Column], Column]
    label: Callable[[Column], Column]


def parse_tag_rule(rule: str) -> TagRule:
    """``/re/flags``, ``~prefix`` (all but), ``prefix`` (stripped) or empty (all)."""
    def whole(tag: Column) -> Column:
        return tag

    delimited = _delimited(rule)
    if delimited:
        pattern, flags = delimited[0], re.sub("[gy]", "", delimited[1])
        try:
            _check_flags(flags)
            groups = _groups(pattern)
        except re.error:
            return TagRule(lambda tag: F.lit(False), whole)
        java = _inline(flags) + pattern

        def label(tag: Column) -> Column:
            if not groups:
                return F.regexp_extract(tag, java, 0)
            parts = F.array(*[F.regexp_extract(tag, java, g) for g in range(1, groups + 1)])
            return F.array_join(F.filter(parts, lambda p: p != ""), " ")

        return TagRule(lambda tag: tag.rlike(java), label)
    if rule.startswith("~"):
        return TagRule(lambda tag: ~tag.startswith(rule[1:]), whole)
    if rule:
        return TagRule(lambda tag: tag.startswith(rule),
                       lambda tag: tag.substr(F.lit(len(rule) + 1), F.length(tag)))
    return TagRule(lambda tag: F.lit(True), whole)


def pick_tags(tags: Column | str, rule: str, rewrites: str = "") -> Column:
    """Array of (tag, label) for the tags a rule takes; empty labels are dropped."""
    parsed, rules = parse_tag_rule(rule), parse_rewrites(rewrites)
    taken = F.filter(col(tags), parsed.takes)
    labelled = F.transform(taken, lambda t: F.struct(
        t.alias("tag"), rewrite(parsed.label(t), rules).alias("label")))
    return F.filter(labelled, lambda p: p["label"] != "")


def tags_outside(tags: Column | str, rule: str, exclusive: bool = True) -> Column:
    """The tags a rule leaves over, order and duplicates kept."""
    if not exclusive or not rule:
        return col(tags)
    parsed = parse_tag_rule(rule)
    return F.filter(col(tags), lambda t: ~(
        parsed.takes(t) & (rewrite(parsed.label(t), []) != "")))


@dataclass(frozen=True)
class FieldRule:
    """A matrix column: annotations whose colour or tag meets a condition."""

    name: str
    attribute: str  # "tag" or "color"
    operator: str   # "is", "contains" or "beginsWith"
    value: str

    def test(self, color: Column | str, tags: Column | str) -> Column:
        value = F.lit(self.value.lower())

        def holds(c: Column) -> Column:
            text = F.lower(F.coalesce(c, F.lit("")))
            if self.operator == "is":
                return text == value
            if self.operator == "beginsWith":
                return F.startswith(text, value)
            return F.contains(text, value)

        if self.attribute == "color":
            return holds(col(color))
        return F.coalesce(F.exists(col(tags), holds), F.lit(False))
