"""Places of pattern matches in whole texts, from DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "array<struct<start:int,end:int,kind:string,match:string>>"


def matches(text: Column, pattern: str, kind: str, shown: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as ``start, end, kind, match``, in code points, end exclusive.

    Between n matches lie n + 1 gaps; the running sum of both lengths gives the places. ``shown``
    is the text the match is cut from, where ``text`` is a copy with single characters replaced.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def place(d: Column) -> Column:
        sizes = F.zip_with(
            d["found"],
            F.slice(d["gaps"], 1, F.size(d["found"])),
            lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")),
        )
        nothing = F.array().cast("array<struct<start:int,end:int>>")
        return F.aggregate(
            sizes,
            F.struct(F.lit(0).alias("at"), nothing.alias("spans")),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + s["size"]).alias("at"),
                F.array_append(
                    acc["spans"],
                    F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["size"]).alias("end")),
                ).alias("spans"),
            ),
        )["spans"]

    spans = let(F.struct(found.alias("found"), gaps.alias("gaps")), place)
    source = text if shown is None else shown
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            F.substring(source, s["start"] + 1, s["end"] - s["start"]).alias("match"),
        ),
    )


def when(condition: Column, spans: Column) -> Column:
    """The spans where a cheap test finds them possible, else none."""
    return F.when(condition, spans).otherwise(F.array().cast(SPAN))


def ordered(spans: Column, kinds: list[str]) -> Column:
    """Sorted by start, then kind in the order given, then end."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        spans,
        lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("k"), s["end"], s["kind"].alias("kind")),
    )
    return F.array_sort(keyed)


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def apart(added: Column, base: Column) -> Column:
    """Those of ``added`` that overlap none of ``base``."""
    return let(base, lambda b: F.filter(added, lambda a: ~F.exists(b, lambda s: (s["start"] < a["end"]) & (a["start"] < s["end"]))))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
