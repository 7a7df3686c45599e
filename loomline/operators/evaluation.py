"""Scoring: confusion, cells, pairs, ratings, agreement, vectors and the style classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.stats import micro_rate, order_statistics, wilson
from loomline.operators.components import cut_lineage
from loomline.operators.relations import paired

#: What a style's cue is and in which direction it counts.
STYLE_CUES = {"sad": ("arousal", -1), "whisper": ("voicing", -1)}


def cue_score(style: Column) -> Column:
    """The style's own measure, signed; null for styles without one."""
    out = F.lit(None).cast("double")
    for name, (measure, sign) in STYLE_CUES.items():
        out = F.when(style == name, F.col(measure) * sign).otherwise(out)
    return out


def confusion(df: DataFrame, truth: str, found: str, classes: list) -> DataFrame:
    """Row-normalised confusion matrix: a row per true class, a column per found class."""
    shares = [F.avg((F.col(found) == c).cast("double")).alias(f"as_{c}") for c in classes]
    return df.groupBy(truth).agg(F.count("*").alias("n"), *[F.coalesce(s, F.lit(0.0)).alias(f"as_{c}") for s, c in zip(shares, classes)])


def cell_summary(df: DataFrame, keys: list[str], medians: list[str], errors: str, words: str) -> DataFrame:
    """Size, medians and the micro-averaged error rate of each cell."""
    middle = order_statistics(df, keys, {f"median_{m}": (m, 0.5) for m in medians})
    return df.groupBy(*keys).agg(F.count("*").alias("n"), micro_rate(F.col(errors), F.col(words)).alias("wer")).join(middle, keys, "left")


def paired_share(df: DataFrame, keys: list[str], style: str, base: str, value: str, run: str = "run") -> DataFrame:
    """Per run the pairs and the share in which the style's value is greater; ties don't count as greater."""
    both = paired(df, keys, style, base, value)
    return both.groupBy(run).agg(F.count("*").alias("pairs"), F.avg((F.col("value") > F.col("base")).cast("double")).alias("greater"))


def paired_ratio(df: DataFrame, keys: list[str], style: str, base: str, value: str, run: str = "run") -> DataFrame:
    """Per run the median and mean of value / base over pairs with a positive base."""
    both = paired(df, keys, style, base, value).where("base > 0").withColumn("ratio", F.col("value") / F.col("base"))
    middle = order_statistics(both, [run], {"median_ratio": ("ratio", 0.5)})
    return both.groupBy(run).agg(F.count("*").alias("pairs"), F.avg("ratio").alias("mean_ratio")).join(middle, run)


def answers_crosstab(df: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """Answers counted per key, a column for each answer that occurs, in order."""
    values = sorted(r[0] for r in df.select(answer).where(F.col(answer).isNotNull()).distinct().collect())
    return df.groupBy(*keys).agg(*[F.count_if(F.col(answer) == v).alias(str(v)) for v in values])


def ratings_summary(df: DataFrame, keys: list[str], answer: str, answers: list[str], scores: list[str]) -> DataFrame:
    """Share of each answer and mean of each score; scores are strings and are cast here."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.avg((F.col(answer) == a).cast("double")).alias(f"share_{a}") for a in answers],
        *[F.avg(F.col(s).cast("int")).alias(f"mean_{s}") for s in scores],
    )


def separation(df: DataFrame, run: str, style: str, answer: str, target: str, base: str) -> DataFrame:
    """Points by which the target answer is more frequent on target clips than on base clips, where a run has both."""
    share = lambda s: F.avg(F.when(F.col(style) == s, (F.col(answer) == target).cast("double")))
    both = df.groupBy(run).agg(share(target).alias("on_target"), share(base).alias("on_base"))
    return both.where("on_target is not null and on_base is not null").withColumn("points", (F.col("on_target") - F.col("on_base")) * 100)


def pair_answers(answers: DataFrame, key: DataFrame, reference: str = "reference") -> DataFrame:
    """Shares of right, wrong and same per run; unknown labels and empty answers are left out; the reference comes last."""
    known = answers.where(F.coalesce("answer", F.lit("")) != "").join(key.select("label", "run", "side"), "label")
    verdict = F.when(F.col("answer") == "same", "same").when(F.col("answer") == F.col("side"), "right").otherwise("wrong")
    share = lambda v: F.avg((F.col("verdict") == v).cast("double")).alias(v)
    per = known.withColumn("verdict", verdict).groupBy("run").agg(F.count("*").alias("pairs"), share("right"), share("wrong"), share("same"))
    return per.orderBy((F.col("run") == reference).cast("int"), "run")


def ratings_rows(doc: DataFrame, ratings: str = "ratings") -> DataFrame:
    """A map label -> answers as rows."""
    return doc.select(F.explode(ratings).alias("label", "answer"))


def completeness_table(df: DataFrame, order: tuple[str, ...] = ("short", "medium", "long")) -> DataFrame:
    """Clips, incomplete and to check per group and style, known groups first in their order."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("grp")), F.lit(0).cast("bigint")), F.lit(len(order) + 1).cast("bigint"))
    cells = df.groupBy("grp", "style").agg(F.count("*").alias("clips"), F.count_if(F.col("flag") == "incomplete").alias("incomplete"), F.count_if(F.col("flag") == "check").alias("to_check"))
    return cells.withColumn("place", place).orderBy("place", "grp", "style")


def rate_table(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """k of n with its 95 % Wilson interval."""
    counts = df.groupBy(*keys).agg(F.count_if(flag).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return counts.select(*keys, "k", "n", low.alias("low"), high.alias("high"))


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.withColumn("unit", F.transform(vector, lambda x: x.cast("double") / norm))


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean of the unit vectors of each group, itself of length 1; partial sums per dimension, no list of vectors."""
    each = unit_vectors(df, vector).select(*keys, F.posexplode("unit").alias("dim", "x"))
    means = each.groupBy(*keys, "dim").agg(F.avg("x").alias("m"))
    vectors = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("v"))  # as long as a vector
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["m"] * x["m"]))
    return vectors.select(*keys, F.transform("v", lambda x: x["m"] / norm).alias("centroid"))


def similarity(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def extend_eval_set(items: DataFrame, references: DataFrame, history: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """A frozen evaluation set with more styles: the same items (item_id, refs: style -> reference id), each with the references
    (item_id, style, ref) added, and the history (at, styles) with a row more. Raises if a style is there already, or if an item
    would lack a reference."""
    have = items.select(F.explode(F.map_keys("refs")).alias("style")).distinct()
    new = references.select("style").distinct()
    again = [r[0] for r in have.join(new, "style").collect()]  # a row a style
    if again:
        raise ValueError(f"the set has these styles already: {sorted(again)}")
    added = references.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("style", "ref")))).alias("added"))
    styles = new.count()
    short = items.join(added.where(F.size("added") == styles), "item_id", "left_anti")
    if not short.isEmpty():
        raise ValueError(f"{short.count()} items lack a reference of a new style")
    grown = items.join(added, "item_id").withColumn("refs", F.map_concat("refs", "added")).select(*items.columns)
    line = new.agg(F.array_join(F.sort_array(F.collect_list("style")), ",").alias("styles")).select(F.lit(at).alias("at"), "styles")
    return grown, history.unionByName(line)


def best_attempt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of a clip's attempts (attempt, severity, heard) the one to keep: the lowest severity among those made, the earliest of
    equals. Trying stops after a clean attempt, or when severity 1 hears the same text twice running."""
    w = Window.partitionBy(*keys).orderBy("attempt")
    same = (F.col("severity") == 1) & (F.lag("severity").over(w) == 1) & (F.col("heard") == F.lag("heard").over(w))
    stops = df.withColumn("stop_", ((F.col("severity") == 0) | F.coalesce(same, F.lit(False))).cast("int"))
    made = stops.withColumn("stopped_", F.coalesce(F.sum("stop_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("stopped_ = 0")
    return made.groupBy(*keys).agg(F.min(F.struct("severity", "attempt")).alias("best"), F.count("*").alias("tries")).select(*keys, "best.attempt", "best.severity", "tries")


def best_checkpoint(losses: DataFrame, weights: DataFrame) -> DataFrame:
    """The checkpoint with the lowest loss among those with weights, the first on ties; a step's last log line counts."""
    last = losses.groupBy("step").agg(F.max_by("loss", "line").alias("loss"), F.max("line").alias("line"))
    return last.join(weights.select("step"), "step").orderBy("loss", "line").limit(1).select("step", "loss")


def steps_per_epoch(rows: Column, batch: int, accumulate: int) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(rows / (batch * accumulate)).cast("bigint"))


def real_time_factor(df: DataFrame, keys: list[str], audio_s: str, wall_s: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(audio_s) / F.sum(wall_s)).alias("rtf"))


#: Rows of a partition, and fits that run side by side, while the classifier's strength is chosen.
FIT_ROWS, FITS_AT_ONCE = 50_000, 8


def style_classifier(train: DataFrame, held_out: DataFrame, vector: str, label: str, folds: int = 5, regs: tuple[float, ...] | None = None, seed: int = 0):
    """Standardised multinomial logistic regression, its regularisation chosen by stratified folds of the training rows only.
    Returns the model and the held-out rows with `probability` and `prediction`."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    as_rows = lambda d: d.withColumn("features_", array_to_vector(F.transform(vector, lambda x: x.cast("double")))).withColumn("label", F.col(label).cast("double"))
    order = Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(vector).cast("string"))))
    rows = as_rows(train).withColumn("fold", ((F.row_number().over(order) - 1) % folds).cast("int"))
    # Every fit reads the rows many times: they are computed once, and few rows lie in few partitions.
    rows = cut_lineage(rows.select("features_", "label", "fold"), "training-rows")
    n = rows.count()
    rows = rows.coalesce(n // FIT_ROWS + 1)
    lr = LogisticRegression(featuresCol="scaled_", labelCol="label", family="multinomial", standardization=False, maxIter=100)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(regs or [1 / (10 ** (-4 + 8 * k / 9) * n) for k in range(10)])).build()
    pipe = Pipeline(stages=[StandardScaler(inputCol="features_", outputCol="scaled_", withMean=True, withStd=True), lr])
    check = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    model = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=check, foldCol="fold", numFolds=folds, parallelism=FITS_AT_ONCE).fit(rows).bestModel
    return model, model.transform(as_rows(held_out))
