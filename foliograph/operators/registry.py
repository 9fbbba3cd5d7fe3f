"""Extension points: block kinds, checks and content features are rows of a registry, folded into the plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class BlockKind:
    """A kind of block: its line test, its number of paragraphs, what its plan operations are (None: a paragraph's), and its priority: kinds below 0 come before the built-in ones."""

    kind: str
    match: Callable[[Column], Column]
    count: int = 1
    ops: Callable[[DataFrame], DataFrame] | None = None
    priority: int = 0


_BLOCKS: dict[str, BlockKind] = {}
_CHECKS: dict[str, Callable[..., DataFrame]] = {}
_FEATURES: dict[str, tuple[str, str]] = {}


def register_block(kind: str, match: Callable[[Column], Column], count: int = 1, ops: Callable[[DataFrame], DataFrame] | None = None, priority: int = 0) -> None:
    """Adds a block kind; consecutive matching lines make one block. Lines are tested in the order of priority, then of registration; below 0 before breaks, lists and tables, else after them. Fences come first."""
    _BLOCKS[kind] = BlockKind(kind, match, count, ops, priority)


def unregister_block(kind: str) -> None:
    _BLOCKS.pop(kind, None)


def block_kinds() -> list[BlockKind]:
    return sorted(_BLOCKS.values(), key=lambda b: b.priority)


def register_check(name: str, check: Callable[..., DataFrame]) -> None:
    """Adds a check that returns rows of the checks schema; checks run in the order of registration."""
    _CHECKS[name] = check


def unregister_check(name: str) -> None:
    _CHECKS.pop(name, None)


def checks() -> dict[str, Callable[..., DataFrame]]:
    return dict(_CHECKS)


def register_feature(feature: str, capability: str, note: str) -> None:
    """Adds a content feature and the capability that it needs."""
    _FEATURES[feature] = (capability, note)


def unregister_feature(feature: str) -> None:
    _FEATURES.pop(feature, None)


def features() -> dict[str, tuple[str, str]]:
    return dict(_FEATURES)
