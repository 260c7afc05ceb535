"""Provenance tags: real beats derived beats synthetic-assigned; a result is as weak as its weakest input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REAL = "real"
DERIVED = "derived"
ASSIGNED = "synthetic-assigned"
STRENGTH = {REAL: 3, DERIVED: 2, ASSIGNED: 1}
BY_STRENGTH = {rank: tag for tag, rank in STRENGTH.items()}


def combine(*tags: str) -> str:
    if not tags:
        raise ValueError("at least one provenance tag is needed")
    return BY_STRENGTH[min(STRENGTH[tag] for tag in tags)]


def derive(*tags: str) -> str:
    return combine(DERIVED, *tags) if tags else combine()


def strength(tag: Column) -> Column:
    levels = F.create_map(*[F.lit(part) for pair in STRENGTH.items() for part in pair])
    return levels[tag]


def tag_of(level: Column) -> Column:
    names = F.create_map(*[F.lit(part) for pair in BY_STRENGTH.items() for part in pair])
    return names[level]


def combine_agg(tag: Column) -> Column:
    """Weakest tag of a group, as an aggregate."""
    return tag_of(F.min(strength(tag)))


def derive_agg(tag: Column) -> Column:
    return tag_of(F.least(F.min(strength(tag)), F.lit(STRENGTH[DERIVED])))
