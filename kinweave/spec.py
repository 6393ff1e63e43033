"""How a table of labelled entities is described to the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Texts that mean a missing value, after trimming (fixed values).
MISSING = ("", "-", "nan", "None", "(empty)", "0")
SPLITS = ("train", "val", "test")
TIMEBIN_SECONDS = 300


@dataclass(frozen=True)
class RelationSpec:
    """Entities are related if they share the value of a column, or a time bin of it."""

    name: str
    column: str
    kind: str = "value"
    bin_seconds: int = TIMEBIN_SECONDS


@dataclass(frozen=True)
class EntitySpec:
    """Column names of an entity table; ``relations`` in the order in which they are reported."""

    id: str = "id"
    label: str = "label"
    ts: str = "ts"
    category: str = "category"
    split: str = "split"
    features: tuple[str, ...] = ()
    relations: tuple[RelationSpec, ...] = field(default_factory=tuple)
