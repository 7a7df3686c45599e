"""Closed-form statistics as aggregates and windows."""

from __future__ import annotations

from math import comb, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.components import cut_lineage

#: The 97.5 % point of the standard normal distribution.
Z95 = 1.959963984540054


def counted_below(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Per group and distinct non-null value: its `ties_`, the `below_` rows of the group with smaller values, and the group's `n_`.

    Values are counted where they are, and the counts range-partitioned by group and value, so a group of any size is
    spread over tasks; each range adds its own counts to the sum of those before it."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("ties_"))
    cut = cut_lineage(counts.repartitionByRange(*keys, x).withColumn("range_", F.spark_partition_id()))
    of = Window.partitionBy(*[f"key{i}_" for i in range(len(keys))])
    sums = cut.groupBy(F.col("range_").alias("of_"), *[F.col(k).alias(f"key{i}_") for i, k in enumerate(keys)]).agg(F.sum("ties_").alias("sum_"))
    before = F.sum("sum_").over(of.orderBy("of_").rowsBetween(Window.unboundedPreceding, -1))  # a row a range that holds some of the group
    starts = sums.withColumn("start_", F.coalesce(before, F.lit(0))).withColumn("n_", F.sum("sum_").over(of)).drop("sum_")
    inside = F.sum("ties_").over(Window.partitionBy("range_", *keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    same = F.col("range_") == F.col("of_")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"key{i}_"))
    joined = cut.withColumn("in_", F.coalesce(inside, F.lit(0))).join(starts, same)
    return joined.select(*keys, x, "ties_", (F.col("in_") + F.col("start_")).alias("below_"), "n_")


def places(df: DataFrame, keys: list[str], order: list[str], out: str = "place") -> DataFrame:
    """(keys, order, out): each row's place, from 1, in its group's order; the order tells rows apart."""
    found = counted_below(df.select(*keys, F.struct(*order).alias("at_")), keys, "at_")
    return found.select(*keys, *[F.col(f"at_.{c}").alias(c) for c in order], (F.col("below_") + 1).alias(out))


def order_statistics(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], lower: tuple[str, ...] = ()) -> DataFrame:
    """(keys, names): exact quantiles, name -> (column, share), nulls skipped. Between two values they are interpolated; names in
    `lower` take the lower one, element floor(share (n - 1)) of the sorted values, counted from 0. Groups without values are left out."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)]))
    ranked = counted_below(df.select(*keys, each.alias("v_")).select(*keys, F.col("v_.m").alias("m_"), F.col("v_.x").alias("x_")), [*keys, "m_"], "x_")
    kinds, out = dict(df.dtypes), []
    for name, (column, share) in wanted.items():
        at = F.lit(share) * (F.col("n_") - 1)
        here = lambda rank: F.max(F.when((F.col("m_") == columns.index(column)) & (F.col("below_") <= rank) & (rank < F.col("below_") + F.col("ties_")), F.col("x_")))  # noqa: B023, E731
        low, high = here(F.floor(at)), here(F.ceil(at))
        if name in lower:
            out.append(low.cast(kinds[column]).alias(name))
            continue
        part = F.max(F.when(F.col("m_") == columns.index(column), at - F.floor(at)))
        out.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def lower_rank_frame(df: DataFrame, keys: list[str], x: str, share: float = 0.95) -> DataFrame:
    """Per group, element floor(share (n - 1)) of the sorted non-null values, counted from 0."""
    return order_statistics(df, keys, {"p95": (x, share)}, ("p95",))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % confidence limits of k successes in n."""
    p, z2 = k / n, Z95 * Z95
    middle = (p + z2 / (n * 2)) / (1 + z2 / n)
    half = F.sqrt(p * (1 - p) / n + z2 / (n * n * 4)) * Z95 / (1 + z2 / n)
    return F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))


def average_ranks(df: DataFrame, x: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ranks with ties averaged, from counts per distinct value; rows join back on their value."""
    counts = counted_below(df, list(keys), x)
    return df.join(counts.select(*keys, x, (F.col("below_") + (F.col("ties_") + 1) / 2).alias(out)), [*keys, x])


def auc(df: DataFrame, score: str, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by the Mann-Whitney statistic with averaged ties; label: a boolean."""
    ranked = average_ranks(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()), score, "rank_", keys)
    pos = F.col(label).cast("boolean")
    n1, n0 = F.count_if(pos), F.count_if(~pos)
    value = F.when((n1 > 0) & (n0 > 0), (F.sum(F.when(pos, F.col("rank_"))) - n1 * (n1 + 1) / 2) / (n1 * n0))
    return ranked.groupBy(*keys).agg(n1.alias("positives"), n0.alias("negatives"), value.alias("auc"))


def spearman(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_ranks(average_ranks(both, x, "rx_", keys), y, "ry_", keys)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rx_", "ry_").alias("rho"))


def robust_z(df: DataFrame, keys: list[str], ratio: str, out: str = "z") -> DataFrame:
    """0.6745 (x - median) / MAD within each group; a MAD of 0 counts as 1e-9. Every row stays: without a value it has no z."""
    middle = order_statistics(df, keys, {"median_": (ratio, 0.5)})
    off = with_group(df, middle, keys).withColumn("off_", F.abs(F.col(ratio) - F.col("median_")))
    spread = order_statistics(off, keys, {"mad_": ("off_", 0.5)})
    z = F.lit(0.6745) * (F.col(ratio) - F.col("median_")) / F.when(F.col("mad_") == 0, F.lit(1e-9)).otherwise(F.col("mad_"))
    return with_group(off, spread, keys).withColumn(out, z).drop("off_", "median_", "mad_")


def with_group(df: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with what `of` says of its group, null where it says nothing; a null key is a group like any other."""
    named = of.select(*[F.col(k).alias(f"key{i}_") for i, k in enumerate(keys)], *[c for c in of.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"key{i}_")) for i, k in enumerate(keys)]
    return df.join(named, same, "left").drop(*[f"key{i}_" for i in range(len(keys))])


def binomial_tail(k: int, n: int) -> float:
    """P(X >= k) for n fair coin flips."""
    return sum(comb(n, i) for i in range(k, n + 1)) / 2**n


def binomial_tail_of(k: Column, n: Column) -> Column:
    """P(X >= k) for n fair coin flips, of columns; null for null. Terms are kept as logarithms, so n may be large."""
    first = F.struct((n.cast("double") * -log(2)).alias("term"), F.lit(0.0).alias("sum"))

    def step(held: Column, i: Column) -> Column:
        to_next = F.log(i.cast("double") / (n - i + 1))  # from the term of i to that of i - 1
        return F.struct((held["term"] + to_next).alias("term"), (held["sum"] + F.exp(held["term"])).alias("sum"))

    from_the_top = F.sequence(n.cast("bigint"), F.greatest(k, F.lit(1)).cast("bigint"), F.lit(-1).cast("bigint"))
    return F.when(k.isNull() | n.isNull(), None).when(k <= 0, 1.0).when(k > n, 0.0).otherwise(F.aggregate(from_the_top, first, step, lambda held: held["sum"]))


def micro_rate(errors: Column, words: Column) -> Column:
    """Sum of errors over sum of words."""
    return F.try_divide(F.sum(errors), F.sum(words))
