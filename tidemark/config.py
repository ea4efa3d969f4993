"""Settings, checked when they are made."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Windows in minutes, gaps and lateness in seconds, retention in hours."""

    trading_minutes: tuple[int, ...] = (5,)
    liquidity_minutes: tuple[int, ...] = (60,)
    session_gap_seconds: int = 3
    trend_minutes: int = 30
    trend_slide_minutes: int = 5
    lateness_seconds: int = 60
    finality_blocks: int = 64
    backfill_blocks: int = 500
    trading_retention_hours: int = 168
    liquidity_retention_hours: int = 720

    def __post_init__(self):
        for name in ("trading_minutes", "liquidity_minutes"):
            if not getattr(self, name) or any(m <= 0 for m in getattr(self, name)):
                raise ValueError(f"{name} must list positive numbers of minutes")
        for name in ("session_gap_seconds", "trend_minutes", "trend_slide_minutes", "trading_retention_hours", "liquidity_retention_hours"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name in ("lateness_seconds", "finality_blocks", "backfill_blocks"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.trend_minutes % self.trend_slide_minutes:
            raise ValueError("trend_minutes must be a multiple of trend_slide_minutes")

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> EngineConfig:
        """From text settings: names of the fields in upper case, lists separated by commas; blanks mean the default."""
        out = {}
        for name, field in cls.__dataclass_fields__.items():
            raw = values.get(name.upper(), "").strip()
            if raw:
                try:
                    out[name] = tuple(int(x) for x in raw.split(",")) if "tuple" in str(field.type) else int(raw)
                except ValueError:
                    raise ValueError(f"{name.upper()} is not a number: {raw}") from None
        return cls(**out)


def result_topics(sizes: tuple[int, ...], base: str, explicit: bool) -> dict[int, str]:
    """The topic of each window size; an explicit list gives every size a suffix, the default none."""
    return {m: f"{base}-{m}m" if explicit else base for m in sizes}


def check_endpoint(url: str) -> str:
    if not re.match(r"^wss?://[^\s/]+", url or ""):
        raise ValueError("the endpoint must be a ws:// or wss:// address")
    return url


def check_address(text: str) -> str:
    if not re.fullmatch(r"0[xX][0-9a-fA-F]{40}", text or ""):
        raise ValueError("an address is 0x and 40 hexadecimal digits")
    return text
