"""Tokens of plain texts are those of the pattern."""

import random

import pytest

from leafmill.llm import messages, quality


def test_tokens_are_those_of_the_pattern():
    rng = random.Random(2)
    signs = [*"ab C.!?\"')(*_:;|\t  ,#-1[]{}", "\x01", "\x1c", "...", ".) ", "\r", "…", "ß", "”"]
    for _ in range(2000):
        lines = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(4)]
        expected = [["." if t in "!?…" else t for t in messages._TOKENS.findall(line.lower())] for line in lines]
        assert messages.tokenised(lines) == expected


@pytest.mark.parametrize("line, n", [("a {{x}} [NAME] b %s", 3), ("see [text](url) and 5 %", 0), ("- {{x}}", 0), ("{{x", 0)])
def test_slots_of_lines(line, n):
    lines = ["Some text without any.", "", line, "", "It goes on}} here."]
    assert quality.statistics(lines).slots == n
