"""Bookmarks of a view as text, and back: column expressions.

A bookmark is ``f=frame&o=overlays&h=basis`` with, where there is one, the
chosen block ``b=x,y``, the tab ``t`` unless it is the first, and the digests of
the stream ``s`` and of the source ``y``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Overlays (a bookmark holds their initials), tabs and bases, the first of each being the default.
OVERLAYS = ("partition", "intra", "motion", "qp", "heatmap", "residual")
TABS = ("projection", "cutting", "curves")
BASES = ("modeled", "emitted")
FIELDS = ("s", "y", "c", "f", "o", "h", "b", "t")


def encoded(frame: Column, overlays: Column, basis: Column, x: Column, y: Column, tab: Column, stream: Column) -> Column:
    initials = F.array_join(F.transform(F.filter(F.array(*[F.lit(o) for o in OVERLAYS]), lambda o: F.array_contains(overlays, o)), lambda o: F.substring(o, 1, 1)), "")
    part = lambda name, value: F.concat(F.lit(f"{name}="), value)
    return F.concat_ws(
        "&", part("f", frame.cast("string")), part("o", initials), part("h", basis), F.when(x.isNotNull() & y.isNotNull(), part("b", F.concat_ws(",", x.cast("string"), y.cast("string")))),
        F.when(tab != TABS[0], part("t", tab)), F.when(stream.isNotNull(), part("s", stream)),
    )


def decoded(fragment: Column) -> Column:
    """A struct of frame, overlays, basis, x, y, tab and stream; what is missing or makes no sense takes its default.

    A bookmark bound to a stream must be whole: an unknown or repeated field, or
    a digest that is none, makes it null.
    """
    # one pattern a field, in generated code: a list of pairs would be made anew wherever a field is read
    value = lambda name: F.regexp_extract(fragment, rf"(?:\A#?|&){name}(?:=([^&]*))?(?=&|\z)", 1)
    has = lambda names: fragment.rlike(rf"(?:\A#?|&)[{names}](?:=[^&]*)?(?=&|\z)")
    number = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))
    chosen = F.get(F.transform(F.array(value("o")), lambda i: F.array_compact(F.array(*[F.when(F.instr(i, F.lit(o[0])) > 0, o) for o in OVERLAYS]))), F.lit(0))
    overlays = F.when(has("o"), chosen).otherwise(F.array(F.lit(OVERLAYS[0])))
    place = lambda i: number(F.get(F.split(value("b"), ","), F.lit(i)))
    x, y = place(0), place(1)
    both = x.isNotNull() & y.isNotNull()
    bound = has("syc")
    view = F.struct(
        F.coalesce(number(value("f")), F.lit(0)).alias("frame"), overlays.alias("overlays"), F.when(value("h").isin(*BASES), value("h")).otherwise(BASES[0]).alias("basis"),
        F.when(both, x).alias("x"), F.when(both, y).alias("y"), F.when(value("t").isin(*TABS), value("t")).otherwise(TABS[0]).alias("tab"), F.when(has("s"), F.lower(value("s"))).alias("stream"),
    )
    one = rf"[{''.join(FIELDS)}](?:=[^&]*)?"
    again = rf"(?s)(?:\A#?|&)([{''.join(FIELDS)}])(?=[=&]).*&\1(?=[=&]|\z)"
    whole = fragment.rlike(rf"\A#?{one}(?:&{one})*\z") & ~fragment.rlike(again) & value("s").rlike("^[0-9a-fA-F]{64}$")
    return F.when(~bound | whole, view)
