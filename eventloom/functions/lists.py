"""Small array helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    A lambda body re-evaluates every outer expression per element; going through a
    one-element array turns the value into a bound variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def mark_repeats(items: Column, key: Callable[[Column], Column]) -> Column:
    """``array<struct<pos, item, repeat>>`` in the given order, ``repeat`` true from the second
    equal key on.

    Sorting by (key, pos) and looking at the left neighbour keeps this n log n for long texts.
    """
    keyed = F.transform(
        items, lambda x, i: F.struct(key(x).alias("key"), i.alias("pos"), x.alias("item"))
    )
    flagged = bind(
        F.array_sort(keyed),
        lambda s: F.transform(
            s,
            lambda x, i: F.struct(
                x["pos"].alias("pos"),
                x["item"].alias("item"),
                F.when(i > 0, F.get(s, i - 1)["key"] == x["key"]).otherwise(False).alias("repeat"),
            ),
        ),
    )
    return F.array_sort(flagged)
