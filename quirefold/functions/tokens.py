"""Token costs as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions import fixed as v


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, for values that an expression names several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cjk_chars(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, f"[{v.CJK_TOKEN}]+", ""))


def token_cost(cjk: Column, other: Column) -> Column:
    """Cost of a non-empty text from its character counts."""
    return (F.ceil(cjk * F.lit(v.CJK_TOKENS) + other * F.lit(v.OTHER_TOKENS)) + v.TEXT_TOKENS).cast("long")


def estimate_tokens(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    cjk = cjk_chars(s)
    return F.when(s == "", F.lit(0).cast("long")).otherwise(token_cost(cjk, F.length(s) - cjk))


def list_tokens(total: Column, n: Column) -> Column:
    """Cost of a message list from the summed text costs and the number of messages."""
    return (total + n * v.MESSAGE_TOKENS + v.LIST_TOKENS).cast("long")


def messages_tokens(contents: Column) -> Column:
    """Cost of an array of message texts."""
    total = F.aggregate(contents, F.lit(0).cast("long"), lambda a, t: a + estimate_tokens(t))
    return list_tokens(total, F.size(contents))


_SUFFIX_CJK = sum(any(a <= ord(ch) <= b for a, b in v.CJK_TOKEN_RANGES) for ch in v.FIT_SUFFIX)
_SUFFIX_OTHER = len(v.FIT_SUFFIX) - _SUFFIX_CJK


def fit_text(c: Column, tokens: Column) -> Column:
    """The text, or its longest prefix that fits together with the cut mark.

    The cost of a prefix never falls as it grows, so the length is found by halving: the state is two numbers,
    and no text longer than the budget allows is looked at.
    """
    return let(F.struct(F.coalesce(c, F.lit("")).alias("s"), tokens.cast("double").alias("limit")), lambda x: _fit(x["s"], x["limit"]))


def _fit(s: Column, limit: Column) -> Column:
    top = F.least(F.length(s), F.greatest(F.ceil(limit / v.OTHER_TOKENS), F.lit(0)).cast("int"))

    def halve(state, _):
        lo, hi = state["lo"], state["hi"]
        mid = F.ceil((lo + hi) / 2).cast("int")
        head = F.left(s, mid)
        cjk = cjk_chars(head)
        fits = token_cost(cjk + _SUFFIX_CJK, mid - cjk + _SUFFIX_OTHER) <= limit
        step = F.when(
            fits, F.struct(mid.alias("lo"), hi.alias("hi"))
        ).otherwise(F.struct(lo.alias("lo"), (mid - 1).alias("hi")))
        return F.when(lo < hi, step).otherwise(state)

    start = F.struct(F.lit(0).alias("lo"), top.alias("hi"))
    # As many halvings as the text is long, so that any length ends at one value.
    halvings = F.ceil(F.log2(F.greatest(top, F.lit(1)) + F.lit(1.0))).cast("int")
    length = F.aggregate(F.sequence(F.lit(0), halvings), start, halve, lambda st: st["lo"])
    return F.when(estimate_tokens(s) <= limit, s).otherwise(F.concat(F.left(s, length), F.lit(v.FIT_SUFFIX)))
