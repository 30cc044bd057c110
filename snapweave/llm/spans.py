"""Places of pattern matches as native array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern: str, kind: int, quick: str, keep: Callable[[Column], Column]) -> Column:
    """The leftmost non-overlapping matches of ``pattern`` that pass ``keep`` as an array of
    ``(start, kind, end)``, in code points, end exclusive. Splitting a text by a pattern gives the
    gaps between its matches, so running sums of gap and match lengths are the places.
    ``quick`` is a pattern that every text with a kept match contains."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.zip_with(F.split(text, pattern), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
    empty = F.array().cast(SPAN)

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & keep(x["m"]), F.concat(s["out"], F.array(one)))
                        .otherwise(s["out"]).alias("out"))

    run = F.aggregate(each, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(quick), run).otherwise(empty)


def joined(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of each span, comma-joined in the order of the array."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
