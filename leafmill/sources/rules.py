"""URL rules: read from TOML, checked and translated on the driver, compiled to columns."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

MATCH_TYPES = ("domain", "host", "starts_with", "regex")
ACTION_TYPES = ("skip", "prepend", "replace", "regex_replace")


@dataclass(frozen=True)
class Action:
    type: str
    reason: str = ""
    text: str = ""
    old: str = ""
    new: str = ""
    pattern: str = ""
    replacement: str = ""


@dataclass(frozen=True)
class Rule:
    name: str
    match_type: str
    pattern: str
    actions: tuple[Action, ...] = field(default_factory=tuple)


def parse_rules(text: str) -> list[Rule]:
    """The rules of a TOML text: [[rule]] tables with name, type, match and [[rule.action]].

    Text that is no TOML has no rules; a rule without a known type, a match or any
    valid action is left out, as is an action of no known type or without its text.
    """
    try:
        tables = tomllib.loads(text).get("rule", [])
    except tomllib.TOMLDecodeError:
        return []
    rules = []
    for number, table in enumerate(tables if isinstance(tables, list) else [], 1):
        if not isinstance(table, dict) or table.get("type") not in MATCH_TYPES or not isinstance(table.get("match"), str) or not table["match"]:
            continue
        actions = tuple(a for raw in table.get("action", []) if (a := _action(raw)))
        if actions:
            rules.append(Rule(str(table.get("name", f"rule {number}")), table["type"], table["match"], actions))
    return rules


def _action(raw: object) -> Action | None:
    if not isinstance(raw, dict) or raw.get("type") not in ACTION_TYPES:
        return None
    known = {k: v for k, v in raw.items() if k in Action.__dataclass_fields__ and isinstance(v, str)}
    needs = {"prepend": "text", "replace": "old", "regex_replace": "pattern"}.get(raw["type"])
    return Action(**known) if not needs or known.get(needs) else None


def load_rules(defaults: list[Rule], user_file: str | Path | None = None) -> list[Rule]:
    """The user's rules, which win, and then the defaults; a missing or broken file adds none."""
    own: list[Rule] = []
    if user_file is not None:
        try:
            own = parse_rules(Path(user_file).read_text(encoding="utf-8"))
        except (OSError, UnicodeDecodeError):
            own = []
    return own + list(defaults)


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's syntax, case-insensitive, with Python's line ends and end anchors."""
    out = re.sub(r"\(\?P<", "(?<", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    return "(?diu)" + out


def java_replacement(replacement: str) -> str:
    """``$1``, ``${1}`` and ``$$`` in Java's syntax; a backslash is itself."""

    def one(m: re.Match) -> str:
        if m[0] == "\\":
            return "\\\\"
        if m[0] == "$$" or m[0] == "$":
            return "\\$"
        return "$" + (m[1] or m[2])

    return re.sub(r"\\|\$\$|\$\{(\d+)\}|\$(\d+)|\$", one, replacement)


def valid_java(spark, pattern: str) -> bool:
    """Whether Java accepts ``pattern``; asked once on the driver, so no task fails on it."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:  # noqa: BLE001 - py4j wraps PatternSyntaxException
        return False
