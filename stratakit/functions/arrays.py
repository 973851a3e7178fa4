"""Array helpers: argmax with first-index ties (H7) and majority vote with
lowest-class ties (D11), as native higher-order expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, also where ``body``
    uses it inside the lambda of a higher-order function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(values: Column) -> Column:
    """Array of structs (value, at): each different element of an array with
    its 0-based places in ascending order, ordered by value."""
    def begins(own):
        return F.filter(F.transform(own, lambda s, i: F.when((i == 0) | (s["value"] != F.get(own, i - 1)["value"]), i)),
                        lambda i: i.isNotNull())

    def groups(own, first):
        return F.transform(first, lambda b, k: F.struct(
            F.get(own, b)["value"].alias("value"),
            F.transform(F.slice(own, b + 1, F.coalesce(F.get(first, k + 1), F.size(own)) - b), lambda s: s["at"]).alias("at")))

    placed = F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("at"))))
    return once(placed, lambda own: once(begins(own), lambda first: groups(own, first)))


def argmax(arr: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def majority_vote(preds: Column, num_classes: int) -> Column:
    """Most frequent class in an ``array<int>``; ties -> lowest class."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)),
                         lambda c: F.size(F.filter(preds, lambda p: p == c)))
    return argmax(counts)
