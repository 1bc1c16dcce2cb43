"""Column expressions over token and id arrays. All run in one pass over the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_prefix_length(left: Column, right: Column) -> Column:
    """Number of equal leading elements of two arrays; null arrays count as empty."""
    shorter = F.least(F.size(left), F.size(right))
    equal = F.zip_with(left, right, lambda a, b: a.eqNullSafe(b))
    first_difference = F.array_position(equal, False)
    return F.when(first_difference == 0, shorter).otherwise(
        F.least(first_difference - 1, shorter)).cast("int")


def collapse_above(ids: Column, limit: Column | int) -> Column:
    """Replace every id above ``limit`` by ``limit + 1`` and keep one of each run of such ids."""
    top = F.lit(limit) if isinstance(limit, int) else limit
    return F.transform(
        F.filter(ids, lambda x, i: ~((x > top) & (i > 0) & (F.get(ids, i - 1) > top))),
        lambda x: F.when(x > top, top + 1).otherwise(x))


def pad(ids: Column, width: Column | int, filler: Column) -> Column:
    """Cut to ``width`` elements or fill up on the right."""
    n = F.lit(width) if isinstance(width, int) else width
    return F.slice(F.concat(ids, F.array_repeat(filler, n)), F.lit(1), n)


def scale_path(path: Column, multiple: int) -> Column:
    """Add ``multiple`` times the distance to the path's last step to every step."""
    return F.transform(path, lambda x, i: (x + (F.size(path) - 1 - i) * multiple).cast("int"))


def fixed_path(path: Column, multiple: int, depth: int) -> Column:
    """Scaled path cut or zero-padded to ``depth`` steps."""
    return pad(scale_path(path, multiple), depth, F.lit(0))


def ngrams(tokens: Column, longest: int) -> list[Column]:
    """Arrays of all runs of 1 to ``longest`` tokens, as space-joined strings; each built from the one before."""
    grams = [tokens]
    for n in range(2, longest + 1):
        count = F.greatest(F.size(tokens) - n + 1, F.lit(0))
        grams.append(F.zip_with(F.slice(grams[-1], F.lit(1), count), F.slice(tokens, F.lit(n), count),
                                lambda a, b: F.concat(a, F.lit(" "), b)))
    return grams


def map_text(m: Column) -> Column:
    """A map as ``key=value`` items in key order, for reports and comparisons."""
    return F.array_join(F.sort_array(F.transform(
        F.map_entries(m), lambda e: F.concat(e["key"].cast("string"), F.lit("="),
                                             e["value"].cast("string")))), ",")
