"""Argument checks."""

from __future__ import annotations


def positive(name: str, value: int, least: int = 1) -> None:
    if value < least:
        raise ValueError(f"{name} must be at least {least}")


def one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
