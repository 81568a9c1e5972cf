"""Document-type rules, evaluation, split, and the forest classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.sources.shared import written

from . import scan


def rule_type(aspect: Column, edges: Column) -> Column:
    return (
        F.when(aspect < 0.8, "receipt")
        .when(aspect <= 1.2, F.when(edges < 0.1, "id_card").otherwise("business_card"))
        .otherwise(F.when(edges > 0.15, "form").otherwise("text_document"))
    )


def rule_type_with_confidence(aspect: Column, text: Column, edges: Column) -> Column:
    out = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.lit(c).alias("confidence"))
    return F.when(aspect > 1.4, F.when(text > 0.15, out("letter", 0.8)).otherwise(out("receipt", 0.7))).otherwise(
        F.when(edges > 0.1, F.when(text > 0.2, out("form", 0.75)).otherwise(out("id_card", 0.85))).otherwise(out("photo", 0.9))
    )


def evaluate(rows: DataFrame, classes: list | None = None) -> DataFrame:
    """true, total, correct, accuracy of each true label (of the classes, if given)."""
    rows = rows.where(F.col("true").isin(classes)) if classes is not None else rows
    hit = (F.col("true") == F.col("pred")).cast("long")
    return rows.groupBy("true").agg(F.count("*").alias("total"), F.sum(hit).alias("correct"), F.avg(hit).alias("accuracy"))


def distribution(rows: DataFrame, key: str) -> DataFrame:
    """key, n, percent of all rows. The counts are one row a value, not a row of input."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(key, "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def _cut(rows: DataFrame, h: Column, want: int) -> tuple[int, int]:
    """The 32-bit bucket of h (the highest bits) in which the want-th smallest row lies, and how
    many rows lie in the buckets before it. Two counts of at most 65,536 rows reach the driver."""
    bucket, before = None, 0
    for shift in (48, 32):
        part = F.shiftright(h, shift)
        inside = rows if bucket is None else rows.where(F.shiftright(h, shift + 16) == bucket)
        for r in sorted(inside.groupBy(part.alias("b")).count().collect(), key=lambda r: r["b"]):
            if before + r["count"] > want:
                bucket = r["b"]
                break
            before += r["count"]
    return bucket, before


def exact_split(rows: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """rows with `is_test` for exactly int(n * share) rows, those of the smallest hash of the key (null
    keys too). The cut is an order statistic, found by counts of hash buckets; only rows of the
    bucket that it falls in, of one key as a rule, are numbered."""
    rows = written(rows, "split")  # it is read five times
    n = rows.count()
    want = int(n * share)
    if want <= 0 or want >= n:
        return rows.withColumn("is_test", F.lit(want > 0))
    h = F.xxhash64(key)
    bucket, before = _cut(rows, h, want)
    low = F.shiftright(h, 32)
    edge = rows.where(low == bucket).withColumn("__m", F.monotonically_increasing_id())
    counts = edge.groupBy(F.shiftright("__m", 33).alias("p")).count().collect()  # one row a partition
    left, last, within = want - before, -1, 0
    for r in sorted(counts, key=lambda r: r["p"]):
        last, within = r["p"], min(left, r["count"])
        left -= within
        if not left:
            break
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    cut = (part < last) | ((part == last) & (place < within))
    return rows.where(low != bucket).withColumn("is_test", low < bucket).unionByName(edge.withColumn("is_test", cut).drop("__m"))


def train(rows: DataFrame, features: str = "features", label: str = "label", trees: int = 100, depth: int = 10, seed: int = 42):
    """Standardised features into a random forest; a PipelineModel."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StandardScaler

    scale = StandardScaler(inputCol=features, outputCol="scaled", withMean=True, withStd=True)
    forest = RandomForestClassifier(featuresCol="scaled", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[scale, forest]).fit(rows)


def predict(model, rows: DataFrame) -> DataFrame:
    """rows with pred and confidence (the largest probability)."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows)
    return out.withColumns({"pred": F.col("prediction").cast("int"), "confidence": F.array_max(vector_to_array("probability"))}).drop("rawPrediction", "probability", "prediction", "scaled")


def save(model, path: str) -> bool:
    """Writes a fitted model over what is at path; False if there is no model."""
    if model is None:
        return False
    model.write().overwrite().save(path)
    return True


def load(path: str):
    """The model saved at path, None if there is none. One that is there but cannot be read is an error."""
    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return PipelineModel.load(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def predict_or_rules(model, rows: DataFrame, classes: list[str], features: str = "features") -> DataFrame:
    """rows with doc_type and confidence: the model's, or without a model the rules' (0.6), or
    where the model gives none the rules' (0.5). features: a vector whose first two numbers are aspect and edge density."""
    from pyspark.ml.functions import vector_to_array

    f = vector_to_array(features)
    rules = rule_type(F.get(f, F.lit(0)), F.get(f, F.lit(1)))
    if model is None:
        return rows.withColumns({"doc_type": rules, "confidence": F.lit(0.6)})
    names = F.array(*[F.lit(c) for c in classes])
    out = predict(model, rows)
    kind = F.get(names, F.col("pred"))
    return out.withColumns({"doc_type": F.coalesce(kind, rules), "confidence": F.when(kind.isNotNull(), F.col("confidence")).otherwise(0.5)}).drop("pred")


#: The first numbers of a feature vector.
NAMED = ("aspect_ratio", "edge_density", "contour_density", "texture", "text_lines", "brightness", "contrast")


def diagnosed(rows: DataFrame, truth: str | None = None, features: str = "features") -> DataFrame:
    """rows (with a feature array, prediction and confidence) with the named features and
    whether the prediction is right; null where the truth is unknown."""
    named = F.struct(*[F.get(features, F.lit(i)).alias(n) for i, n in enumerate(NAMED)])
    right = F.col("prediction") == F.col(truth) if truth else F.lit(None).cast("boolean")
    return rows.withColumns({"named_features": named, "correct": right})


def train_and_evaluate(rows: DataFrame, key: str, label: str = "label", features: str = "features", share: float = 0.2, trees: int = 100, depth: int = 10, seed: int = 42):
    """(model, classes, accuracy on the training rows, rows of the test set with pred and
    confidence, accuracy by class of the test set). Rows are split by `exact_split`; labels are strings, numbered in sorted order."""
    classes = [r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]  # one row a class
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    parts = exact_split(rows.where(F.col(label).isNotNull()).withColumn("__y", number.cast("double")), key, share)
    model = train(parts.where("not is_test"), features, "__y", trees, depth, seed)
    named = F.get(F.array(*[F.lit(c) for c in classes]), F.col("pred"))
    said = predict(model, parts).withColumns({"true": F.col(label), "pred": named}).drop("__y")
    hit = F.avg((F.col("true") == F.col("pred")).cast("double"))
    fitted = said.where("not is_test").agg(hit).first()[0]
    test = said.where("is_test")
    return model, classes, fitted, test, evaluate(test, classes)


def accuracy(rows: DataFrame) -> DataFrame:
    """One row: the share of rows (true, pred) that agree."""
    return rows.agg(F.avg((F.col("true") == F.col("pred")).cast("double")).alias("accuracy"))


def averages_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n and the average of value."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias(value))


def stage_times(rows: DataFrame, stages: list[str]) -> DataFrame:
    """One row: the average of each stage over the rows that have it."""
    return rows.agg(*[F.avg(s).alias(s) for s in stages])


#: Of the quantile sketch that brackets a median; its rank is off by one in so many rows at most.
ACCURACY = 10_000


def exact_median(rows: DataFrame, key: str, value: str, accuracy: int = ACCURACY) -> DataFrame:
    """key, median: the exact median of the values that are not null (of an even number the mean of the middle two); keys without
    a value have no row. A mergeable sketch brackets it, then one pass counts what lies below and sorts the few rows in
    the bracket; no key's values are held."""
    some = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    edge = 2.0 / accuracy
    sketch = F.percentile_approx("v", F.array(F.lit(max(0.0, 0.5 - edge)), F.lit(min(1.0, 0.5 + edge))), accuracy)
    bracket = some.groupBy("k").agg(sketch.alias("q"), F.count("*").alias("n")).select(F.col("k").alias("b"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n")
    met = some.join(bracket, F.col("k").eqNullSafe(F.col("b")))
    inside = F.when(F.col("v").between(F.col("low"), F.col("high")), F.col("v")).when(F.col("v") < F.col("low"), F.lit(float("-inf")))
    counts = met.withColumn("v", inside).where("v is not null").groupBy("k", "v", "n").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    middle = [F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1 + i) / 2), F.col("v"))) for i in (0, 1)]
    return counts.withColumn("upto", upto).groupBy("k").agg(((middle[0] + middle[1]) / 2).alias("median")).withColumnRenamed("k", key)


def median_angle(rows: DataFrame, key: str, angle: str) -> DataFrame:
    """key, raw, angle: the exact median of the angles, and of the angles that count from upright
    where they lie between 45 and 135 degrees."""
    folded = F.when(F.col(angle).between(45, 135), F.col(angle) - 90).otherwise(F.col(angle))
    both = rows.select(F.col(key).alias("__k"), F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col(angle).cast("double").alias("a")), F.struct(F.lit(1).alias("w"), folded.cast("double").alias("a")))).alias("x"))
    found = exact_median(both.select(F.struct("__k", "x.w").alias("kw"), "x.a"), "kw", "a")
    of = lambda w: F.max(F.when(F.col("kw.w") == w, F.col("median")))
    medians = found.groupBy(F.col("kw.__k").alias("__m")).agg(of(0).alias("raw"), of(1).alias("angle"))
    keys = rows.select(F.col(key).alias(key)).distinct()
    return keys.join(medians, F.col(key).eqNullSafe(F.col("__m")), "left").select(key, "raw", "angle")


def modes_in_turn(rows: DataFrame, at: Column, modes: tuple[str, ...], out: str = "mode") -> DataFrame:
    """rows with the mode that stands at place `at` of the modes, taken in turn."""
    return rows.withColumn(out, F.element_at(F.array(*[F.lit(m) for m in modes]), (F.pmod(at, F.lit(len(modes))) + 1).cast("int")))


def newest(rows: DataFrame, by: str | list[str], n: int) -> DataFrame:
    """The n rows of the largest `by`."""
    return rows.orderBy(*[F.desc(b) for b in ([by] if isinstance(by, str) else by)]).limit(n)


def running_count(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the number of the key's rows so far."""
    return scan.running_sum(rows, [key], [order], F.lit(1).cast("long"), "n")
