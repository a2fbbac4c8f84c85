"""A join that stays even when few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 1000


def join_counted_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    value: str,
    rows: str,
    only: Column | None = None,
) -> DataFrame:
    """``facts`` with ``value`` of the lookup row that has the same keys, else null; with
    ``only``, a condition on the lookup, the facts whose lookup row meets it and no others.

    ``lookup`` holds one row per key with the number of facts in ``rows``. A key is hot when
    it has more than 1/MAX_HOT_KEYS of all facts, so fewer than MAX_HOT_KEYS keys can be hot
    and those are broadcast. Hot facts are answered by that alone and cross no shuffle; the
    others join by a shuffle in which no key is large. ``facts`` is read twice, so pass a table.
    """
    total = lookup.agg(F.sum(rows)).first()[0] or 0
    is_hot = F.col(rows) * MAX_HOT_KEYS > total
    hot, cold = lookup.filter(is_hot), lookup.filter(~is_hot)
    wanted = F.lit(True) if only is None else only
    answered = facts.join(F.broadcast(hot.filter(wanted).select(*keys, value)), keys)
    rest = facts.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    joined = rest.join(cold.filter(wanted).select(*keys, value), keys, "left" if only is None else "inner")
    return answered.unionByName(joined)
