"""Positions of regular-expression matches, by built-in expressions alone.

``regexp_extract_all`` gives the matches of a row and ``split`` on the same pattern gives what lies between them; folding their
lengths gives positions in code points. A cheap test comes first, so that rows without a match are read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,score:int>>"


def find_spans(
    kind: str, text: Column, pattern: str, gate: Column, keep: Callable[[Column], Column] | None = None, score: Callable[[Column], Column] | None = None
) -> Column:
    """The leftmost non-overlapping matches of ``pattern`` that ``keep`` accepts, as an array of spans with end exclusive.

    ``pattern`` must not match the empty string. ``score`` gets the start of a match, in code points from 0.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(
        matches, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap"), F.length(m).alias("len"))
    )

    def step(seen: Column, x: Column) -> Column:
        start = seen["at"] + x["gap"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["len"]).alias("end"), (score(start) if score else F.lit(100)).alias("score"))
        found = F.concat(seen["found"], F.array(span))
        return F.struct((start + x["len"]).alias("at"), (F.when(keep(x["m"]), found).otherwise(seen["found"]) if keep else found).alias("found"))

    nothing = F.array().cast(SPAN)
    folded = F.aggregate(steps, F.struct(F.lit(0).alias("at"), nothing.alias("found")), step, lambda seen: seen["found"])
    return F.when(gate, folded).otherwise(nothing)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def chars_of(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")
