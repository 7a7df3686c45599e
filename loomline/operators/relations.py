"""Joins, set operations, duplicates, samples and blinding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_transcripts(clips: DataFrame, transcripts: DataFrame, key: str = "stem") -> DataFrame:
    """Every clip with its text, null where there is none."""
    return clips.join(transcripts, key, "left")


def with_measures(clips: DataFrame, measures: DataFrame, key: str) -> DataFrame:
    """Measured clips with their measures: by key, as rows have no position. A clip that was measured twice ends whatever reads it."""
    twice = F.raise_error(F.lit("a clip was measured twice")).cast("boolean")
    once = measures.withColumn("n_", F.count("*").over(Window.partitionBy(key))).where((F.col("n_") == 1) | twice).drop("n_")
    return clips.join(once, key)


def differing_ids(a: DataFrame, b: DataFrame, id_col: str, split: str = "split") -> DataFrame:
    """(split, differing): of each split the ids that only one of two lists has there; 0 where they agree."""
    side = lambda df, name: df.select(id_col, split).distinct().withColumn(name, F.lit(True))
    both = side(a, "a_").join(side(b, "b_"), [id_col, split], "full_outer")
    return both.groupBy(split).agg(F.count_if(F.col("a_").isNull() | F.col("b_").isNull()).alias("differing"))


def only_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the left side without a partner; keys compare as values, nulls included."""
    r = right.select(*keys).distinct()
    return left.join(r, reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[k]) for k in keys]), "left_anti")


def reuse_saved(items: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """Items with their saved measurements; raises if one has none."""
    lost = items.join(saved, key, "left_anti").select(key).limit(1).collect()
    if lost:
        raise ValueError(f"{items.join(saved, key, 'left_anti').count()} items have no saved measurement, such as {lost[0][0]!r}")
    return items.join(saved, key)


def work_list(items: DataFrame, styles: list[str], seeds: list[int]) -> DataFrame:
    """Every item in every style with every seed; styles and seeds are short lists."""
    return items.withColumn("style", F.explode(F.array(*map(F.lit, styles)))).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))


def paired(df: DataFrame, keys: list[str], style: str, base: str, value: str, style_col: str = "style") -> DataFrame:
    """Keys that have both styles, with both values (the first by value where a style repeats)."""
    side = lambda s, name: F.min(F.when(F.col(style_col) == s, F.col(value))).alias(name)
    both = df.where(F.col(style_col).isin([style, base])).groupBy(*keys).agg(side(style, "value"), side(base, "base"))
    return both.where("value is not null and base is not null")


def overlapping_neighbours(df: DataFrame, source: str, start: str, end: str, id_col: str) -> DataFrame:
    """Adjacent segments of one source, by start, of which the first ends after the second starts."""
    w = Window.partitionBy(source).orderBy(start, id_col)
    nxt = df.withColumn("next_id", F.lead(id_col).over(w)).withColumn("next_start", F.lead(start).over(w))
    return nxt.where(F.col(end) > F.col("next_start")).select(source, id_col, "next_id")


def duplicate_groups(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Keys held by more than one row, with their number and first id. The members stay rows: join on the keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id")).where("copies > 1")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given total order; summed before the shuffle, so large groups are no hot spots."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first_"))
    return first.select(*keys, "first_.*").select(*df.columns)


def mark_duplicates(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """duplicate_of: the smallest id with the same key, null on that row itself. By aggregate and join, so a key with many
    rows is summed before it is shuffled."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias("first_"))
    marked = df.join(first, key, "left")
    return marked.withColumn("duplicate_of", F.when(F.col("first_") != F.col(id_col), F.col("first_"))).drop("first_")


def hash_order(seed: str, *columns: str) -> Column:
    """A seeded order that no partitioning changes."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def stratified_sample(df: DataFrame, strata: list[str], id_col: str, k: int, seed: str) -> DataFrame:
    """At most k rows a stratum, by seeded hash; strata don't influence each other."""
    w = Window.partitionBy(*strata).orderBy(hash_order(seed, *strata, id_col), id_col)
    return df.withColumn("nth_", F.row_number().over(w)).where(F.col("nth_") <= k).drop("nth_")


def shuffled_labels(df: DataFrame, id_col: str, secret: str, length: int = 8) -> DataFrame:
    """Opaque labels, and an order by them, that tell nothing about the rows. Ids whose hashes begin alike get the whole hash
    as their label, so no two ids share one; rows of one id do."""
    hashed = df.withColumn("hash_", F.sha2(F.concat_ws("|", F.lit(secret), F.col(id_col).cast("string")).cast("binary"), 256))
    hashed = hashed.withColumn("label", F.concat(F.lit("c"), F.substring("hash_", 1, length - 1)))
    shared = hashed.groupBy("label").agg(F.min("hash_").alias("a_"), F.max("hash_").alias("b_")).where("a_ <> b_").select("label", F.lit(True).alias("shared_"))
    whole = F.when(F.col("shared_"), F.concat(F.lit("c"), F.col("hash_"))).otherwise(F.col("label"))
    return hashed.join(shared, "label", "left").select(*[F.col(f"`{c}`") for c in df.columns if c != "label"], whole.alias("label"))


def label_clashes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")


def coin(seed: str, *columns: str) -> Column:
    """A or B by the parity of a seeded hash."""
    return F.when(F.conv(F.substring(hash_order(seed, *columns), 1, 1), 16, 10).cast("int") % 2 == 0, "A").otherwise("B")


def blinded(df: DataFrame, id_col: str, secret: str, shown: list[str]) -> tuple[DataFrame, DataFrame]:
    """Trials with a label and what may be shown, and the key that maps labels to rows; to be written apart."""
    labelled = shuffled_labels(df, id_col, secret)
    return labelled.select("label", *shown).orderBy("label"), labelled


def leaks(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Keys whose rows lie in more than one split."""
    found = []
    for k in keys:
        bad = df.where(F.col(k).isNotNull()).groupBy(F.col(k).cast("string").alias("value")).agg(F.min(split).alias("a"), F.max(split).alias("b"))
        found.append(bad.where("a <> b").select(F.lit(k).alias("key"), "value", F.lit(2).alias("least_splits")))
    return reduce(DataFrame.unionByName, found)


def added_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the old table that the new one lacks: empty if rows were only added."""
    return old.exceptAll(new.select(*old.columns))


def frozen_or_raise(old_ids: DataFrame, new_ids: DataFrame, refreeze: bool = False) -> None:
    """Raises unless both id sets agree or a new freeze is asked for."""
    gone, came = old_ids.exceptAll(new_ids), new_ids.exceptAll(old_ids)
    if not refreeze and not (gone.isEmpty() and came.isEmpty()):
        raise ValueError(f"the frozen test set would change: {gone.count()} ids gone, {came.count()} new")


def rediscovered(old_ids: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """The items of the old ids. Raises unless each old id is found again, once."""
    found = items.join(old_ids.select(key).distinct(), key, "left_semi")
    lost = old_ids.select(key).distinct().join(items.select(key), key, "left_anti")
    twice = found.groupBy(key).count().where("count > 1")
    if not (lost.isEmpty() and twice.isEmpty()):
        raise ValueError(f"{lost.count()} old ids are not found again, {twice.count()} are found more than once")
    return found


def fingerprint_or_raise(df: DataFrame, columns: list[str], recorded: str | None) -> str:
    """The table's digest. Raises if another one is recorded for it."""
    digest = fingerprint(df, columns).first()["digest"]
    if recorded is not None and recorded != digest:
        raise ValueError("the data are not those that were recorded: their digests differ")
    return digest


def missing_measures(clips: DataFrame, cache: DataFrame, measure: str) -> DataFrame:
    """Clips whose content has no cached value of a measure, one row a content."""
    have = cache.where(F.col("measure") == measure).select("sha256")
    return clips.select("sha256", "path").join(have, "sha256", "left_anti").groupBy("sha256").agg(F.min("path").alias("path"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a table's rows in any order: row digests are counted, and sums of their parts hashed, so no list of rows
    is gathered."""
    row = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]).cast("binary"), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = df.agg(F.count("*").cast("string").alias("n"), *[part(k).alias(f"p{k}") for k in range(8)])
    return sums.select(F.col("n").cast("bigint").alias("rows"), F.sha2(F.concat_ws("|", "n", *[F.coalesce(f"p{k}", F.lit("")) for k in range(8)]).cast("binary"), 256).alias("digest"))


def reference_last(run: str, reference: str) -> list[Column]:
    """Sort keys that put the reference's rows after all others."""
    return [(F.col(run) == reference).cast("int"), F.col(run)]
