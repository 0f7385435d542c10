"""Application name rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: app families used when two neighbouring intervals are compared
SPLIT_BROWSERS = ["chrome", "firefox", "edge", "safari", "msedge", "opera"]
SPLIT_IDES = ["vscode", "code", "pycharm", "idea", "eclipse", "sublime"]


def _words(app: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(app), r"\.exe", ""), "_")


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def neighbour_similarity(a: Column, b: Column) -> Column:
    """1 equal, .8 shared name word, .9 same family (browser, IDE), else .3."""
    wa, wb = _words(a), _words(b)

    def both_in(family: list[str]) -> Column:
        return F.arrays_overlap(wa, _literals(family)) & F.arrays_overlap(wb, _literals(family))

    return (
        F.when(a == b, 1.0)
        .when(F.arrays_overlap(wa, wb), 0.8)
        .when(both_in(SPLIT_BROWSERS) | both_in(SPLIT_IDES), 0.9)
        .otherwise(0.3)
    )
