"""Importance resampling towards a target: documents are drawn by how much more often their word runs occur in the target.

Texts become words, words become arrays of runs of one to three words, and these are exploded; a run's bucket is its checksum
modulo the number of buckets. Bucket counts of both sides give a table of gains with one row a bucket, which is broadcast (its
size is the parameter `buckets`, whatever the tables hold), joined to the runs of a second pass and summed by document. Noise
from a hash of the id is added and the highest scores are drawn: rows are range-sorted by score, and a row's rank is the count
of the ranges before its own plus its place there. DataFrame functions only; what is shuffled is a partial sum a bucket and
one slim row a document.

A document is its id and its text's digest here, with the number of rows that are equal in both: sums by that key are the
same whatever is computed anew, and any number of equal rows is one row until the end.

Cases: null and empty texts have no runs, weight 0, and take part in neither the count nor the draw; a null id is hashed as an
empty one and loses ties; repeated rows are drawn one by one and repeated ids with other texts are documents of their own; a
text of any length is read whole; an empty table gives an empty result, and an empty target has counts of 0; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import written

#: What ends a word; A-Z become a-z before.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of gains of up to so many rows is broadcast; beyond it Spark chooses.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


def runs(texts: DataFrame, words_col: str, buckets: int, longest: int = 3) -> DataFrame:
    """A row for each word and run length: at_ (the word's place, null if there is none), length_ (from 0), bucket_ (null beyond
    the text's end). Other columns are kept."""
    keep = [c for c in texts.columns if c != words_col]
    placed = texts.select(*keep, words_col, F.posexplode_outer(words_col).alias("at_", "word_"))
    run, each = F.col("word_"), []
    for n in range(longest):
        run = run if n == 0 else F.concat(run, F.lit(" "), F.get(words_col, F.col("at_") + n))
        each.append(F.crc32(run.cast("binary")) % buckets)
    return placed.select(*keep, "at_", F.posexplode(F.array(*each)).alias("length_", "bucket_"))


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, name: str) -> DataFrame:
    found = runs(texts.select(words(F.col(text_col)).alias("words_")), "words_", buckets).where("bucket_ is not null")
    return found.groupBy("bucket_").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, text_col: str, target_col: str, buckets: int, smooth: int) -> DataFrame:
    """(bucket_, gain_) of every bucket, in a written table."""
    counted = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket_")
    for side, column, name in ((docs, text_col, "s_"), (target, target_col, "t_")):
        counted = counted.join(bucket_counts(side, column, buckets, name), "bucket_", "left").fillna(0, [name])
    counted = written(counted, "bucket-counts")
    whole = counted.agg(F.sum("s_").alias("S"), F.sum("t_").alias("T")).first()
    wide = lambda c, more: F.col(c).cast("double") + float(more)
    odds = wide("t_", 1) * F.lit(float(whole["S"] + smooth)) / (wide("s_", 1) * F.lit(float(whole["T"] + smooth)))
    return counted.select("bucket_", F.floor(F.lit(1000.0) * F.log(odds)).cast("bigint").alias("gain_"))


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def weights(docs: DataFrame, gain: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """One row for all rows that are equal in id and text: rows_, n_words, n_features and weight of each of them."""
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).alias("id_"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("text_"), words(text).alias("words_"))
    small = F.broadcast(gain) if buckets <= BROADCAST_ROWS else gain
    single = (F.col("length_") == 0).cast("bigint")
    sums = (
        runs(keyed, "words_", buckets)
        .join(small, "bucket_", "left")
        .groupBy("id_", "text_")
        .agg(
            F.sum(F.when(F.coalesce("at_", F.lit(0)) == 0, single)).alias("rows_"),
            F.sum(F.when(F.col("bucket_").isNotNull(), single)).alias("words_"),
            F.count("bucket_").alias("features_"),
            F.coalesce(F.sum("gain_"), F.lit(0)).alias("weight_"),
        )
    )
    each = lambda c: F.expr(f"coalesce({c}, 0) div rows_")
    return sums.select("id_", "rows_", each("words_").alias("n_words"), each("features_").alias("n_features"), each("weight_").alias("weight"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = 5,
    least_words: int = 20,
    buckets: int = 10_000,
    smooth: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """Number of features, weight and score of every document, and the rank of those drawn: `percent` of the documents with at
    least `least_words` words, highest scores first, ties to the smaller id. smooth: added to the sums of both sides."""
    gain = gains(docs, target, text_col, target_col, buckets, smooth)
    scored = written(weights(docs, gain, id_col, text_col, buckets), "document-weights")
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("id_"), seed)).withColumn("counts_", F.when(F.col("n_words") >= least_words, F.col("rows_")).otherwise(F.lit(0)))
    order = [F.col("score").desc(), F.col("id_").asc_nulls_last()]
    ranged = written(scored.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "by-score")
    sizes = {r["part_"]: r["n"] for r in ranged.groupBy("part_").agg(F.sum("counts_").alias("n")).collect()}  # a row a range
    quota, run, before = sum(sizes.values()) * percent // 100, 0, []
    for part in sorted(sizes):
        if run < quota:
            before.append((part, run))
        run += sizes[part]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "part_ int, before_ bigint"))
    above = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(offsets, "part_").withColumn("above_", F.col("before_") + F.coalesce(F.sum("counts_").over(above), F.lit(0)))
    rest = ranged.join(offsets, "part_", "left_anti").select("*", F.lit(None).cast("bigint").alias("above_"))
    copies = placed.drop("before_").unionByName(rest).select("*", F.explode(F.sequence(F.lit(1), F.col("rows_"))).alias("copy_"))
    rank = F.col("above_") + F.col("copy_")
    drawn = (F.col("counts_") > 0) & (rank <= quota)
    return copies.select(F.col("id_").alias(id_col), "n_features", "weight", "score", F.when(drawn, rank).alias("rank"), "n_words")
