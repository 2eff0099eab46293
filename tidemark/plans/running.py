"""Running totals and moments per key, in order, safe for keys of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.plans.segments import (
    DEFAULT_SPLIT,
    HALO,
    SEG,
    Split,
    segment_rows,
    segment_window,
    with_halo,
    with_prefix,
)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    sums: dict[str, Column],
    *,
    include_self: bool = True,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """Add running sums, one new column per entry of ``sums``."""
    values = {f"_v_{name}": c for name, c in sums.items()}
    rows = segment_rows(df.withColumns(values), keys, order_by, split)
    end = Window.currentRow if include_self else -1
    frame = segment_window(rows, keys, order_by).rowsBetween(Window.unboundedPreceding, end)
    rows = with_prefix(
        rows,
        keys,
        {name: F.sum(f"_v_{name}") for name in sums},
        lambda earlier: {f"_p_{name}": F.sum(name).over(earlier) for name in sums},
    )
    zero = F.lit(0)
    totals = {
        name: F.coalesce(F.sum(f"_v_{name}").over(frame), zero) + F.coalesce(F.col(f"_p_{name}"), zero)
        for name in sums
    }
    return rows.select(*df.columns, *[c.alias(name) for name, c in totals.items()])


def pair_names(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(columns, 2))


def running_moments(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    columns: Sequence[str],
    *,
    pairs: Sequence[tuple[str, str]] | None = None,
    include_self: bool = True,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """Add ``_n``, ``_mean_<c>`` and ``_m2_<a>_<b>`` (sums of centred products).

    ``pairs`` picks the products; by default every pair.  A row counts when all
    its columns have values; before the first such row ``_n`` and the means are 0.  Earlier segments enter by the parallel variance formula,
    so nothing is summed uncentred.
    """
    pairs = pair_names(columns) if pairs is None else list(pairs)
    names = moment_names(columns, pairs)
    rows = segment_rows(df, keys, order_by, split)
    if SEG in rows.columns:
        rows = _with_earlier_moments(rows, keys, columns, pairs)
    end = Window.currentRow if include_self else -1
    frame = segment_window(rows, keys, order_by).rowsBetween(Window.unboundedPreceding, end)

    def so_far(value: Column) -> Column:
        return F.coalesce(value.over(frame), F.lit(0.0))

    value = valued(columns)
    n = _counted(columns).over(frame).cast("double")
    own = [n, *[so_far(F.avg(value[c])) for c in columns]]
    own += [so_far(_spread(value, a, b)) * n for a, b in pairs]
    if SEG not in rows.columns:
        return rows.select(*df.columns, *[c.alias(name) for c, name in zip(own, names)])
    rows = rows.withColumns({f"_own{name}": c for c, name in zip(own, names)})
    merged = merge_moments(
        {name: F.col(f"_earlier{name}") for name in names},
        {name: F.col(f"_own{name}") for name in names},
        columns,
        pairs,
    )
    return rows.select(*df.columns, *[merged[name].alias(name) for name in names])


def valued(columns: Sequence[str]) -> dict[str, Column]:
    """The columns, NULL in rows where any of them is NULL."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return {c: F.when(whole, F.col(c)) for c in columns}


def _counted(columns: Sequence[str]) -> Column:
    return F.count(valued(columns)[columns[0]])


def _spread(value: dict[str, Column], a: str, b: str) -> Column:
    return F.var_pop(value[a]) if a == b else F.covar_pop(value[a], value[b])


def _with_earlier_moments(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], pairs: Sequence[tuple[str, str]]
) -> DataFrame:
    """Add the moments of all earlier segments of the key, ``_earlier_...``."""
    value, zero = valued(columns), F.lit(0.0)
    partials = {"n": _counted(columns).cast("double")}
    partials |= {f"mean_{c}": F.coalesce(F.avg(value[c]), zero) for c in columns}
    partials |= {f"cov_{a}_{b}": F.coalesce(_spread(value, a, b), zero) for a, b in pairs}
    # segments are centred on the key's own mean before squares are added
    whole = Window.partitionBy(*keys)
    prepare = {f"off_{c}": F.col(f"mean_{c}") - F.avg(f"mean_{c}").over(whole) for c in columns}

    def merge(earlier: WindowSpec) -> dict[str, Column]:
        total = F.sum("n").over(earlier)
        some = F.greatest(total, F.lit(1.0))
        off = {c: F.sum(F.col("n") * F.col(f"off_{c}")).over(earlier) / some for c in columns}
        merged = {"_earlier_n": total}
        for c in columns:
            merged[f"_earlier_mean_{c}"] = F.sum(F.col("n") * F.col(f"mean_{c}")).over(earlier) / some
        for a, b in pairs:
            inside = F.sum(F.col("n") * F.col(f"cov_{a}_{b}")).over(earlier)
            between = F.sum(F.col("n") * F.col(f"off_{a}") * F.col(f"off_{b}")).over(earlier)
            merged[f"_earlier_m2_{a}_{b}"] = inside + between - total * off[a] * off[b]
        return merged

    return with_prefix(rows, keys, partials, merge, prepare)


def moment_names(columns: Sequence[str], pairs: Sequence[tuple[str, str]]) -> list[str]:
    return ["_n", *[f"_mean_{c}" for c in columns], *[f"_m2_{a}_{b}" for a, b in pairs]]


def merge_moments(
    earlier: dict[str, Column],
    later: dict[str, Column],
    columns: Sequence[str],
    pairs: Sequence[tuple[str, str]],
) -> dict[str, Column]:
    """Moments of two row sets together (parallel variance formula); NULL ``_n`` means no rows."""
    n0, n1 = earlier["_n"], later["_n"]
    none = n0.isNull()
    total = n0 + n1
    safe = F.greatest(total, F.lit(1.0))
    step = {c: later[f"_mean_{c}"] - earlier[f"_mean_{c}"] for c in columns}
    merged = {"_n": F.when(none, n1).otherwise(total)}
    for c in columns:
        name = f"_mean_{c}"
        merged[name] = F.when(none, later[name]).otherwise(earlier[name] + step[c] * n1 / safe)
    for a, b in pairs:
        name = f"_m2_{a}_{b}"
        both = earlier[name] + later[name] + step[a] * step[b] * n0 * n1 / safe
        merged[name] = F.when(none, later[name]).otherwise(both)
    return merged


def group_moments(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], pairs: Sequence[tuple[str, str]]
) -> DataFrame:
    """The moments of each key's rows that have all values, one aggregation."""
    value, zero = valued(columns), F.lit(0.0)
    n = _counted(columns).cast("double")
    aggregates = [n.alias("_n"), *[F.coalesce(F.avg(value[c]), zero).alias(f"_mean_{c}") for c in columns]]
    for a, b in pairs:
        aggregates.append((F.coalesce(_spread(value, a, b), zero) * n).alias(f"_m2_{a}_{b}"))
    return df.groupBy(*keys).agg(*aggregates)


def sliding_rows(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    size: int,
    columns: dict[str, Column],
    *,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """Add window expressions over the last ``size`` rows of the key.

    ``columns`` holds aggregates without a window.  Hot keys are numbered and
    cut into blocks of rows; the last ``size - 1`` rows of a block are copied
    to the next one, so every frame is whole.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    rows = segment_rows(df, keys, order_by, split)

    def over(part: DataFrame, by: Sequence[str]) -> DataFrame:
        frame = Window.partitionBy(*by).orderBy(*order_by).rowsBetween(-(size - 1), 0)
        return part.withColumns({name: c.over(frame) for name, c in columns.items()})

    if SEG not in rows.columns:
        return over(rows, keys)
    plain = over(rows.filter(F.col(SEG).isNull()), keys).select(*df.columns, *columns)
    hot = rows.filter(F.col(SEG).isNotNull())
    hot = with_prefix(hot, keys, {"n": F.count(F.lit(1))}, lambda w: {"_n0": F.sum("n").over(w)})
    place = F.row_number().over(segment_window(hot, keys, order_by))
    number = F.coalesce("_n0", F.lit(0)) + place - 1
    length = max(4 * size, split.hot_rows // 4, 1)
    block = F.floor(F.col("_row") / length)
    is_tail = F.col("_row") % length >= length - (size - 1)
    copies = F.when(is_tail, F.array(block, block + 1)).otherwise(F.array(block))
    hot = hot.withColumn("_row", number).withColumn("_home", block).withColumn("_block", F.explode(copies))
    hot = over(hot, [*keys, "_block"]).filter(F.col("_block") == F.col("_home"))
    return plain.unionByName(hot.select(*df.columns, *columns))


def previous_values(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    columns: dict[str, Column],
    *,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """Add values of the row before (NULL on the first row of a key)."""
    values = {f"_v_{name}": c for name, c in columns.items()}
    rows = segment_rows(df.withColumns(values), keys, order_by, split)
    rows = with_halo(rows, keys, order_by)
    order = segment_window(rows, keys, order_by)
    rows = rows.withColumns({name: F.lag(f"_v_{name}").over(order) for name in columns})
    return rows.filter(~F.col(HALO)).select(*df.columns, *columns)


def latest_defined(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    name: str,
    value: Column,
    *,
    include_self: bool = True,
    split: Split = DEFAULT_SPLIT,
) -> DataFrame:
    """As-of lookup: add the latest non-NULL ``value`` up to (or before) each row."""
    rows = segment_rows(df.withColumn("_v", value), keys, order_by, split)
    rows = with_halo(rows, keys, order_by, keep=F.col("_v").isNotNull())
    end = Window.currentRow if include_self else -1
    frame = segment_window(rows, keys, order_by).rowsBetween(Window.unboundedPreceding, end)
    rows = rows.withColumn(name, F.last("_v", ignorenulls=True).over(frame))
    return rows.filter(~F.col(HALO)).select(*df.columns, name)
