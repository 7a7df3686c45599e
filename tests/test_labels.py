"""Labels where short hashes meet."""

from pyspark.sql import functions as F

from loomline.operators import relations


def test_labels_of_many_rows_are_unique(spark):
    df = spark.range(200_000).withColumn("text", F.lit("t"))
    short = F.concat(F.lit("c"), F.substring(F.sha2(F.concat(F.lit("s|"), F.col("id").cast("string")).cast("binary"), 256), 1, 7))
    labelled = relations.shuffled_labels(df, "id", "s")
    assert labelled.columns == ["id", "text", "label"] and labelled.count() == 200_000
    assert relations.label_clashes(labelled).isEmpty()
    changed = labelled.withColumn("short", short).where("short <> label")
    alone = df.select(short.alias("short")).groupBy("short").count().where("count = 1")
    assert changed.count() > 0 and changed.join(alone, "short", "left_semi").isEmpty()
    assert changed.where("length(label) <> 65 or not startswith(label, short)").isEmpty()


def test_short_labels_and_rows_of_one_id(spark):
    df = spark.range(300).unionByName(spark.range(5))
    labelled = relations.shuffled_labels(df, "id", "s", 3)
    per = labelled.groupBy("label").agg(F.countDistinct("id").alias("ids"))
    assert labelled.count() == 305 and per.count() == 300 and per.where("ids > 1").isEmpty()
    trials, key = relations.blinded(df.withColumn("text", F.lit("t")), "id", "s", ["text"])
    assert trials.select("label").exceptAll(key.select("label")).isEmpty()
