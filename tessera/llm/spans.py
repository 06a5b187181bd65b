"""Expressions on spans of long texts: running folds, pieces and replacement, none of them quadratic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a text's block, for cutting pieces out of long texts.
BLOCK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, fold: Callable[[Column, Column], Column], wanted: Column | None = None) -> Column:
    """For each position (or each of those `wanted`), the fold from 0 of the values before it.

    In blocks of the square root of the length, so that m of n positions cost n + m n^0.5 cheap steps; an array that
    grows by one element a step would be copied n times.
    """

    def at(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        over = lambda part: F.aggregate(part, F.lit(0), fold)
        heads = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: over(F.slice(v, b * width + 1, width)))
        places = F.sequence(F.lit(0), F.size(v) - 1) if wanted is None else wanted
        before = lambda h, i: fold(over(F.slice(h, F.lit(1), F.floor(i / width).cast("int"))), over(F.slice(v, i - i % width + 1, i % width)))
        return let(heads, lambda h: F.transform(places, lambda i: before(h, i)))

    return let(values, lambda v: F.when(F.size(v) > 0, at(v)).otherwise(F.array().cast("array<int>")))


def piece(blocks: Column, start: Column, stop: Column) -> Column:
    """Code points start (from 0) to stop of a text held as blocks of BLOCK code points."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(stop / BLOCK).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    several = F.concat(F.substring(block(first), start % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(block(last), F.lit(1), stop % BLOCK))
    return F.when(start >= stop, "").when(first == last, F.substring(block(first), start % BLOCK + 1, stop - start)).otherwise(several)


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with each span (structs that begin with start and stop) replaced; a span that begins within an earlier one
    is left out, and what it covers goes."""

    def build(s: Column) -> Column:
        def parts(reach: Column) -> Column:
            def cut(blocks: Column) -> Column:
                one = lambda x, r: F.when(x["start"] < r, "").otherwise(F.concat(piece(blocks, r, x["start"]), by(x)))
                end = F.greatest(F.element_at(reach, -1), F.element_at(s, -1)["stop"])
                return F.concat(F.array_join(F.zip_with(s, reach, one), ""), piece(blocks, end, F.length(text)))

            return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), cut)

        return let(running(F.transform(s, lambda x: x["stop"]), lambda a, b: F.greatest(a, b)), parts)

    return let(F.array_sort(spans), lambda s: F.when(F.size(s) > 0, build(s)).otherwise(text))
