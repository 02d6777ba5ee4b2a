"""Ordered work inside groups that may be very large.

A plain window sorts a whole group in one task, which fails when one thread or document holds a third of all
rows. `scan` cuts every group into chunks by its order key, runs the window inside each chunk, carries one
small summary row per chunk across chunk borders, and joins the carry back. The results are those of the plain
window. `assemble` joins the ordered text fragments of a group into one value, at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.session import materialize

CHUNK_ROWS = 65536


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that shuffles both sides. Spark weighs a written table by its compressed files, and a few MB of keys and
    heights are some hundred MB as a broadcast in the driver; tables that grow with the input meet like this."""
    return left.join(right.hint("merge"), on, how)


def chunk_of(order: str, size: int | None = None) -> Column:
    return F.floor(F.col(order) / (size or CHUNK_ROWS))


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column | None = None,
    *,
    lead: dict[str, Column] | None = None,
    lag: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    top: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ordered columns per group.

    lead/lag: value of the next/previous row. last: newest non-null value on an earlier row (wrap nullable
    values in a struct). before: sum over all earlier rows. total: sum over the group. top: largest value of all earlier rows. `order` is unique within
    the group; `chunk` never falls along it (default: blocks of an integer order column).
    """
    lead, lag, last, before, total, top = lead or {}, lag or {}, last or {}, before or {}, total or {}, top or {}
    chunk = chunk_of(order[0]) if chunk is None else chunk
    pos = F.struct(*[F.col(o) for o in order])
    base = df.withColumn("_chunk", chunk)
    inner = W.partitionBy(*keys, "_chunk").orderBy(*order)
    earlier = inner.rowsBetween(W.unboundedPreceding, -1)

    specs, carries = [], []
    outer = W.partitionBy(*keys).orderBy("_chunk")
    outer_before = outer.rowsBetween(W.unboundedPreceding, -1)
    cols: dict[str, tuple[Column, Column, Column]] = {}
    for name, c in lead.items():
        specs.append(F.min_by(F.struct(c.alias("v")), pos).alias(f"_s_{name}"))
        carries.append(F.lead(f"_s_{name}").over(outer).alias(f"_c_{name}"))
        cols[name] = (F.lead(F.struct(c.alias("v"))).over(inner), "v", None)
    for name, c in lag.items():
        specs.append(F.max_by(F.struct(c.alias("v")), pos).alias(f"_s_{name}"))
        carries.append(F.lag(f"_s_{name}").over(outer).alias(f"_c_{name}"))
        cols[name] = (F.lag(F.struct(c.alias("v"))).over(inner), "v", None)
    for name, c in last.items():
        specs.append(F.max_by(F.struct(c.alias("v")), F.when(c.isNotNull(), pos)).alias(f"_s_{name}"))
        carries.append(F.last(f"_s_{name}", ignorenulls=True).over(outer_before).alias(f"_c_{name}"))
        cols[name] = (F.last(F.when(c.isNotNull(), F.struct(c.alias("v"))), ignorenulls=True).over(earlier), "v", None)
    for name, c in before.items():
        specs.append(F.sum(c).alias(f"_s_{name}"))
        carries.append(F.coalesce(F.sum(f"_s_{name}").over(outer_before), F.lit(0)).alias(f"_c_{name}"))
        cols[name] = (F.coalesce(F.sum(c).over(earlier), F.lit(0)), None, None)
    for name, c in top.items():
        specs.append(F.max(c).alias(f"_s_{name}"))
        carries.append(F.max(f"_s_{name}").over(outer_before).alias(f"_c_{name}"))
        cols[name] = (F.max(c).over(earlier), None, F.greatest)
    for name, c in total.items():
        specs.append(F.sum(c).alias(f"_s_{name}"))
        carries.append(F.sum(f"_s_{name}").over(W.partitionBy(*keys)).alias(f"_c_{name}"))
        cols[name] = (None, None, None)

    summary = base.groupBy(*keys, "_chunk").agg(*specs).select(*keys, "_chunk", *carries)
    windowed = base.select("*", *[c[0].alias(f"_i_{n}") for n, c in cols.items() if c[0] is not None])
    # The window has sorted its rows by these keys already, so only the summary is shuffled.
    joined = meet(windowed, summary, [*keys, "_chunk"], "left")
    out = []
    for name, (own, field, join) in cols.items():
        if own is None:
            out.append(F.col(f"_c_{name}").alias(name))
        elif join is not None:
            out.append(join(F.col(f"_i_{name}"), F.col(f"_c_{name}")).alias(name))
        elif field:
            out.append(F.coalesce(F.col(f"_i_{name}"), F.col(f"_c_{name}"))["v"].alias(name))
        else:
            out.append((F.col(f"_i_{name}") + F.col(f"_c_{name}")).alias(name))
    return joined.select(*[F.col(c) for c in df.columns], *out)


def prefix_maps(maps: DataFrame, keys: list[str], order: str, field: str) -> DataFrame:
    """keys, order (whole numbers from 0 without gaps), field: a map from small whole numbers to such numbers or null,
    as an array. Every map is replaced by the composition of all maps of its group up to it, the first applied first.

    Maps that cover 1, 2, 4, .. rows are joined with those before them, so a group of n rows takes log n rounds and no
    task ever holds more than two maps of a group.
    """
    last = maps.agg(F.max(order)).first()[0]
    step = 1
    while last is not None and step <= last:
        before = maps.select(*keys, (F.col(order) + step).alias(order), F.col(field).alias("_before"))
        both = F.transform("_before", lambda x: F.get(field, x.cast("int")))
        joined = maps.join(before, [*keys, order], "left")
        maps = materialize(joined.select(*keys, order, F.when(F.col("_before").isNull(), F.col(field)).otherwise(both).alias(field)), "maps")
        step *= 2
    return maps


def assemble(fragments: DataFrame, keys: list[str], order: list[str], text: str, sep: str = "") -> DataFrame:
    """keys, text: the ordered texts of each group joined to one value."""
    joined = fragments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("_parts"))
    return joined.select(*keys, F.array_join(F.transform("_parts", lambda p: p[text]), sep).alias(text))
