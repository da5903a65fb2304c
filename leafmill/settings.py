"""Numbers that the environment may set: LEAFMILL_CONCURRENCY, LEAFMILL_RETRIES, LEAFMILL_TIMEOUT_MS."""

from __future__ import annotations

import os
import warnings
from collections.abc import Mapping
from dataclasses import dataclass


def number(name: str, default: int, least: int = 1, given: Mapping[str, str] | None = None) -> int:
    """The number called ``name``; the default, with a warning, if it is none or less than ``least``."""
    text = (os.environ if given is None else given).get(name)
    if text is None:
        return default
    try:
        value = int(text)
    except ValueError:
        value = None
    if value is None or value < least:
        warnings.warn(f"{name}={text!r} is no number of at least {least}: {default} is used", stacklevel=2)
        return default
    return value


@dataclass(frozen=True)
class Settings:
    """Pages that a task fetches at once, attempts after the first, and how long one may take."""

    concurrency: int = 8
    retries: int = 2
    timeout_ms: int = 30_000

    @classmethod
    def of(cls, given: Mapping[str, str] | None = None) -> Settings:
        return cls(
            number("LEAFMILL_CONCURRENCY", cls.concurrency, 1, given),
            number("LEAFMILL_RETRIES", cls.retries, 0, given),
            number("LEAFMILL_TIMEOUT_MS", cls.timeout_ms, 1, given),
        )
