"""Public suffixes, read from a file in the format of the public suffix list."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Suffixes:
    """Suffixes of two labels and more, the parents of all-embracing rules ("*.ck": "ck"), and names that such a rule
    does not take in ("www.ck"). A suffix that no rule names has one label."""

    rules: frozenset[str] = frozenset()
    wildcards: frozenset[str] = frozenset()
    exceptions: frozenset[str] = frozenset()

    def labels(self) -> int:
        """Labels of the longest suffix."""
        return max([1, *(x.count(".") + 1 for x in (*self.rules, *self.exceptions)), *(x.count(".") + 2 for x in self.wildcards)])


def parse_suffixes(text: str) -> Suffixes:
    """The rules of a text: one in a line, up to the first blank; // begins a remark. Names come in the form of hosts (punycode)."""
    found: dict[str, set[str]] = {"": set(), "*": set(), "!": set()}
    for line in text.splitlines():
        rule = line.split("//", 1)[0].strip().split(" ", 1)[0].lower().strip(".")
        kind = "*" if rule.startswith("*.") else "!" if rule.startswith("!") else ""
        name = _ascii(rule.removeprefix("*.").removeprefix("!"))
        if name and (kind or "." in name):
            found[kind].add(name)
    return Suffixes(*(frozenset(found[kind]) for kind in ("", "*", "!")))


def _ascii(name: str) -> str:
    try:
        return name if name.isascii() else name.encode("idna").decode("ascii")
    except UnicodeError:
        return ""


def read_suffixes(path: str | Path) -> Suffixes:
    return parse_suffixes(Path(path).read_text(encoding="utf-8"))
