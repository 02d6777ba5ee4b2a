"""Table-valued cells: array<array<string>> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions import fixed as v
from quirefold.functions.text import trim


def _width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def _padded(rows: Column) -> Column:
    width = _width(rows)
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def normalize_table(rows: Column) -> Column:
    """Clean cells, missing rows dropped, rows padded to one width; null when nothing is left."""
    clean = F.transform(
        F.filter(rows, lambda r: r.isNotNull()),
        lambda r: F.transform(r, lambda c: trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\n+", " "))),
    )
    return F.when(_width(clean) > 0, _padded(clean))


def table_text(rows: Column) -> Column:
    """Size line and the rows, cells joined by bars."""
    full = _padded(rows)
    body = F.array_join(
        F.transform(full, lambda r: F.array_join(F.transform(r, lambda c: F.regexp_replace(c, "\n+", " ")), " | ")), "\n"
    )
    head = F.concat(F.lit("［表格 "), F.size(rows).cast("string"), F.lit(" 行 × "), _width(rows).cast("string"), F.lit(" 列］\n"))
    return F.concat(head, body)


def expand_spans(cells: Column, spans: Column) -> Column:
    """Each cell followed by the empty cells its span covers."""
    return F.flatten(
        F.zip_with(
            cells,
            spans,
            lambda c, n: F.concat(F.array(c), F.array_repeat(F.lit(""), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) - 1)),
        )
    )


def table_markdown(rows: Column) -> Column:
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), "\n+", " ")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    drawn = F.transform(_padded(rows), lambda r: line(F.transform(r, cell)))
    rule = line(F.array_repeat(F.lit("---"), _width(rows)))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(drawn, 1, 1), F.array(rule), F.filter(drawn, lambda r, i: i > 0)), "\n")).otherwise("")


def fit_image(width: Column, height: Column) -> Column:
    """Drawing size of an image: defaults for missing sides, width capped with its ratio kept."""
    w = F.when(F.coalesce(width, F.lit(0)) > 0, width.cast("double")).otherwise(float(v.FIT_DEFAULT_WIDTH))
    h = (
        F.when(F.coalesce(height, F.lit(0)) == 0, float(v.FIT_DEFAULT_HEIGHT))
        .when(height < 0, F.floor(w * v.FIT_RATIO + 0.5).cast("double"))
        .otherwise(height.cast("double"))
    )
    capped = F.greatest(F.lit(1.0), F.floor(h * (F.lit(float(v.FIT_WIDTH)) / w) + 0.5).cast("double"))
    return F.struct(
        F.least(w, F.lit(float(v.FIT_WIDTH))).alias("width"),
        F.when(w > v.FIT_WIDTH, capped).otherwise(h).alias("height"),
    )
