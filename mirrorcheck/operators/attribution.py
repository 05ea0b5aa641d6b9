"""Proximity-based attribution: statistically unique rows and generalised correct-attribution measures.

Rows are near each other when their categorical values are equal and a numeric value differs by less
than a radius. Sums over near rows never pair rows: they are read off running counts and sums of the
values in their order. A statistically unique row is the only one of its kind in its bin, which is as
wide as the radius, so the work grows with the data and not with its square.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import null_safe_join, ratio
from ..functions.ordered import running_sums, value_counts
from ..functions.session import stable

#: Differences up to this are none; running sums are exact to fewer digits than single products.
TOLERANCE = 1e-9


def _check(radii: Mapping[str, float]) -> None:
    bad = [k for k, r in radii.items() if not r > 0]
    if bad:
        raise ValueError(f"the radius must be positive: {', '.join(bad)}")


def kernel(a: Column, b: Column, radius: float) -> Column:
    """max(0, 1 - |a-b|/radius); a missing value on either side counts as distance 0."""
    near = F.greatest(F.lit(0.0), 1.0 - F.abs(a.cast("double") - b.cast("double")) / F.lit(float(radius)))
    return F.when(a.isNull() | b.isNull(), F.lit(1.0)).otherwise(near)


def proximity(categorical: Sequence[tuple[Column, Column]], numeric: Sequence[tuple[Column, Column, float]]) -> Column:
    """Proximity of two rows: 0 if a category differs, else the mean kernel of the numeric values."""
    same = reduce(lambda x, y: x & y, [a.eqNullSafe(b) for a, b in categorical], F.lit(True))
    if not numeric:
        return same.cast("double")
    mean = reduce(lambda x, y: x + y, [kernel(a, b, r) for a, b, r in numeric]) / float(len(numeric))
    return F.when(same, mean).otherwise(0.0)


def _isolated(rows: DataFrame, row_id: str, cats: Sequence[str], radii: Mapping[str, float]) -> DataFrame:
    """(row id, variable) pairs whose value has no other value of the group within the radius.

    Two values in one bin are always near; a bin with a single value is compared with the largest
    value of the bin below and the smallest of the bin above.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("__key"), F.col(k).cast("double").alias("__v"), F.lit(float(r)).alias("__r"))
                      for k, r in radii.items()])
    long = rows.select(row_id, *cats, F.inline(cells)).where(F.col("__v").isNotNull())
    by = [*cats, "__key", "__r"]
    bins = long.groupBy(*by, F.floor(F.col("__v") / F.col("__r")).alias("__bin")).agg(
        F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.min(row_id).alias("id"))
    none, no_id = F.lit(None).cast("double"), F.lit(None).cast(rows.schema[row_id].dataType)
    spread = bins.select(*by, F.inline(F.array(
        F.struct(F.col("__bin").alias("bin"), F.col("n").alias("n"), F.col("id").alias("id"), F.col("lo").alias("v"), none.alias("below"), none.alias("above")),
        F.struct((F.col("__bin") + 1).alias("bin"), F.lit(0).cast("long").alias("n"), no_id.alias("id"), none.alias("v"), F.col("hi").alias("below"), none.alias("above")),
        F.struct((F.col("__bin") - 1).alias("bin"), F.lit(0).cast("long").alias("n"), no_id.alias("id"), none.alias("v"), none.alias("below"), F.col("lo").alias("above")))))
    merged = spread.groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.max("id").alias("id"), F.max("v").alias("v"),
                                            F.max("below").alias("below"), F.min("above").alias("above"))
    free_below = F.col("below").isNull() | (F.col("v") - F.col("below") >= F.col("__r"))
    free_above = F.col("above").isNull() | (F.col("above") - F.col("v") >= F.col("__r"))
    return merged.where((F.col("n") == 1) & free_below & free_above).select(F.col("id").alias(row_id), F.col("__key").alias("variable"))


def _all_isolated(rows: DataFrame, row_id: str, cats: Sequence[str], radii: Mapping[str, float]) -> DataFrame:
    """Ids of the rows that are isolated in each of their present numeric values."""
    present = reduce(lambda a, b: a + b, [F.col(k).isNotNull().cast("int") for k in radii])
    free = _isolated(rows, row_id, cats, radii).groupBy(row_id).agg(F.count("*").alias("__free"))
    return (rows.select(row_id, present.alias("__present")).join(free, row_id, "left")
            .where(F.col("__present") == F.coalesce("__free", F.lit(0))).select(row_id))


def unique_rows(data: DataFrame, row_id: str, categorical: Sequence[str], radii: Mapping[str, float],
                published: bool = False) -> DataFrame:
    """Ids of statistically unique rows with a multiplicity ``times``.

    Unique: alone in its combination of categories, or without another row of that combination
    within the radius of any numeric value. ``published=True`` keeps only rows alone in their
    categories and counts those twice that have no numeric neighbour among such rows.
    """
    _check(radii)
    alone = data.groupBy(*categorical).agg(F.count("*").alias("n"), F.min(row_id).alias(row_id)).where("n = 1").select(row_id)
    if published:
        out = alone.withColumn("times", F.lit(1))
        if radii:
            kept = data.join(alone, row_id, "left_semi").withColumn("__one", F.lit(1))
            again = _all_isolated(kept, row_id, ["__one"], radii)
            out = out.unionByName(again.withColumn("times", F.lit(1)))
        return out.groupBy(row_id).agg(F.sum("times").cast("int").alias("times"))
    if radii:
        alone = alone.union(_all_isolated(data, row_id, categorical, radii)).distinct()
    return alone.withColumn("times", F.lit(1))


def _groups(data: DataFrame, cats: Sequence[str], outer: str | None) -> tuple[DataFrame, list[str]]:
    """Data rows in the groups that a query may look at, and what names a group.

    Without an outer dimension these are the categories. With one, a row stands in the group of its outer value, or of
    the missing ones, and in the group of all, which queries without an outer value look at.
    """
    if outer is None:
        return data, list(cats)
    x, null = F.col(outer).cast("double"), F.lit(None).cast("double")
    own = F.struct(F.when(x.isNull(), "missing").otherwise("value").alias("__kind"), x.alias("__x"))
    return data.select("*", F.inline(F.array(own, F.struct(F.lit("all").alias("__kind"), null.alias("__x"))))), [*cats, "__kind", "__x"]


def _reached(queries: DataFrame, grouped: DataFrame, row_id: str, cats: Sequence[str], keep: Sequence[str], outer: tuple[str, float] | None) -> DataFrame:
    """(row id, group, keep, __w): the groups that each query looks at, with the kernel of the outer dimension.

    Queries meet the distinct outer values of their categories in their own bin and the two beside it.
    """
    if outer is None:
        return queries.select(row_id, *cats, *keep, F.lit(1.0).alias("__w"))
    name, r = outer
    u, null = F.col(name).cast("double"), F.lit(None).cast("double")
    fixed = queries.select(row_id, *cats, *keep, F.when(u.isNull(), "all").otherwise("missing").alias("__kind"), null.alias("__x"), F.lit(1.0).alias("__w"))
    values = grouped.where(F.col("__kind") == "value").select(*cats, "__x").distinct().withColumn("__bin", F.floor(F.col("__x") / F.lit(float(r))))
    asked = queries.where(u.isNotNull()).select(row_id, *cats, *keep, u.alias("__u"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(u / F.lit(float(r))) + k)).alias("__bin"))
    near = null_safe_join(asked, values, [*cats, "__bin"]).withColumn("__w", kernel(F.col("__u"), F.col("__x"), r)).where(F.col("__w") > 0)
    return fixed.unionByName(near.select(row_id, *cats, *keep, F.lit("value").alias("__kind"), "__x", "__w"))


def kernel_sums(queries: DataFrame, data: DataFrame, row_id: str, cats: Sequence[str],
                dims: Sequence[tuple[str, float]]) -> DataFrame:
    """Per query row: sum over the data rows with equal categories of the product of the kernels.

    The kernel falls linearly on both sides of a value v, so its sum over a dimension follows from running counts and
    running sums of the values, read at v - radius, v and v + radius; no query meets the rows themselves. With two
    dimensions this is done for each distinct value of the first within its radius.
    """
    if not dims:
        counted = data.groupBy(*cats).agg(F.count("*").cast("double").alias("s"))
        return null_safe_join(queries.select(row_id, *cats), counted, cats).select(row_id, "s")
    outer = dims[0] if len(dims) == 2 else None
    name, r = dims[-1][0], float(dims[-1][1])
    grouped, by = _groups(data, cats, outer[0] if outer else None)
    y = F.col(name).cast("double")
    counts = grouped.groupBy(*by, y.alias("__y")).agg(F.count("*").alias("__n"))
    asked = stable(_reached(queries.withColumn("__v", y), grouped, row_id, cats, ["__v"], outer))
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__all"), F.sum(F.when(F.col("__y").isNull(), F.col("__n")).otherwise(0)).alias("__missing"))
    flat = null_safe_join(asked, totals, by).select(
        row_id, (F.col("__w") * F.when(F.col("__v").isNull(), F.col("__all")).otherwise(F.col("__missing"))).alias("s"))
    points = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.struct(k.alias("__side"), (F.col("__v") + k * F.lit(r)).alias("__y")))
    probes = asked.where(F.col("__v").isNotNull()).select(row_id, *by, "__v", "__w", F.inline(points))
    values = counts.where(F.col("__y").isNotNull()).withColumn("__ny", F.col("__n") * F.col("__y"))
    every = values.unionByName(probes.select(*by, "__y", F.lit(0).cast("long").alias("__n"), F.lit(0.0).alias("__ny")))
    run = running_sums(value_counts(every, by, "__y", {"__n": F.sum("__n"), "__ny": F.sum("__ny")}), by, "__y", ["__n", "__ny"])
    # at the upper end only smaller values count, so that values at a distance of the radius are outside on both sides
    own = (F.col("__side") == 1).cast("int")
    read = null_safe_join(probes, run, [*by, "__y"]).select(row_id, *by, "__v", "__w", "__side", (F.col("cum___n") - own * F.col("__n")).alias("__c"), (F.col("cum___ny") - own * F.col("__ny")).alias("__t"))

    def at(side: int, column: str) -> Column:
        return F.sum(F.when(F.col("__side") == side, F.col(column)))

    v = F.col("__v") / r
    left = (at(0, "__c") - at(-1, "__c")) * (1 - v) + (at(0, "__t") - at(-1, "__t")) / r
    right = (at(1, "__c") - at(0, "__c")) * (1 + v) - (at(1, "__t") - at(0, "__t")) / r
    sums = read.groupBy(row_id, *by, "__v", "__w").agg(F.when(at(1, "__c") > at(-1, "__c"), left + right).otherwise(0.0).alias("__k"))
    return flat.unionByName(sums.select(row_id, (F.col("__w") * F.col("__k")).alias("s"))).groupBy(row_id).agg(F.sum("s").alias("s"))


def _mean_sums(queries, data, row_id, cats, groups):
    """Average of kernel_sums over several lists of dimensions; 0 where nothing matches."""
    total = None
    for dims in groups:
        part = kernel_sums(queries, data, row_id, cats, dims)
        total = part if total is None else total.unionByName(part)
    sums = total.groupBy(row_id).agg((F.sum("s") / float(len(groups))).alias("s"))
    return queries.select(row_id).join(sums, row_id, "left").select(row_id, F.coalesce("s", F.lit(0.0)).alias("s"))


def attribution_baseline(queries: DataFrame, data: DataFrame, row_id: str, target_cats: Sequence[str],
                         target_radii: Mapping[str, float]) -> DataFrame:
    """Mean proximity of each row's targets to all rows of the data."""
    if not target_cats:
        raise ValueError("at least one categorical target is needed to limit the rows that meet")
    groups = [[t] for t in target_radii.items()] or [[]]
    n = data.agg(F.count("*")).scalar()
    return _mean_sums(queries, data, row_id, target_cats, groups).select(row_id, ratio(F.col("s"), n).alias("baseline"))


def correct_attribution(queries: DataFrame, data: DataFrame, row_id: str, key_cats: Sequence[str], key_radii: Mapping[str, float],
                        target_cats: Sequence[str], target_radii: Mapping[str, float]) -> DataFrame:
    """Mean target proximity of the data rows, weighted by their key proximity to each row.

    Zero when no categorical key matches, which includes having no categorical keys at all.
    """
    if not key_cats:
        return queries.select(row_id, F.lit(0.0).alias("cap"))
    keys = [[k] for k in key_radii.items()] or [[]]
    targets = [[t] for t in target_radii.items()] or [[]]
    den = _mean_sums(queries, data, row_id, key_cats, keys).withColumnRenamed("s", "den")
    num = _mean_sums(queries, data, row_id, [*key_cats, *target_cats], [k + t for k in keys for t in targets]).withColumnRenamed("s", "num")
    known = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in key_cats])
    return (queries.select(row_id, known.alias("__known")).join(den, row_id).join(num, row_id)
            .select(row_id, F.when(F.col("__known"), F.coalesce(ratio(F.col("num"), F.col("den")), F.lit(0.0))).otherwise(0.0).alias("cap")))


def attribution_rows(orig: DataFrame, new: DataFrame, row_id: str, key_cats: Sequence[str], key_radii: Mapping[str, float],
                     target_cats: Sequence[str], target_radii: Mapping[str, float], published: bool = False) -> DataFrame:
    """Per unique original row: baseline, attribution in both data sets and the clamped standardised value."""
    _check({**key_radii, **target_radii})
    cats = [*key_cats, *target_cats]
    radii = {**key_radii, **target_radii}
    unique = unique_rows(orig, row_id, cats, radii, published)
    queries = stable(orig.select(row_id, *cats, *radii).join(unique, row_id))
    base = attribution_baseline(queries, orig, row_id, target_cats, target_radii)
    o = correct_attribution(queries, orig, row_id, key_cats, key_radii, target_cats, target_radii).withColumnRenamed("cap", "cap_orig")
    s = correct_attribution(queries, new, row_id, key_cats, key_radii, target_cats, target_radii).withColumnRenamed("cap", "cap_new")
    b, co, cs = F.col("baseline"), F.col("cap_orig"), F.col("cap_new")
    value = (F.when(F.abs(co - b) <= TOLERANCE, F.lit(None).cast("double")).when((b - cs > TOLERANCE) | (b > co), 0.0)
             .when(cs - co > TOLERANCE, 1.0).otherwise((cs - b) / (co - b)))
    return queries.select(row_id, "times").join(base, row_id).join(o, row_id).join(s, row_id).withColumn("value", value)


def attribution_score(rows: DataFrame) -> DataFrame:
    """One row: number of unique rows, the three means and the standardised mean."""
    t = F.col("times")

    def mean(c):
        return ratio(F.sum(F.col(c) * t), F.sum(F.when(F.col(c).isNotNull(), t)))

    return rows.agg(F.sum(t).alias("n_unique"), mean("baseline").alias("mean_baseline"), mean("cap_orig").alias("mean_orig"),
                    mean("cap_new").alias("mean_new")).withColumn(
        "gtcap", ratio(F.col("mean_new") - F.col("mean_baseline"), F.col("mean_orig") - F.col("mean_baseline")))
