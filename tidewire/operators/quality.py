"""How good decisions are against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least figures that a classifier must reach.
MINIMUMS = {"accuracy": 0.80, "precision": 0.75, "recall": 0.75, "f1": 0.75, "geocoding_coverage": 0.80}
BUCKETS = (("lt_0_50", None, 0.50), ("ge_0_50_lt_0_75", 0.50, 0.75), ("ge_0_75_lt_0_90", 0.75, 0.90), ("ge_0_90", 0.90, None))


def expected_valid(expected: Column, label: Column, valid: Column) -> Column:
    """The label of a record: its `expected` object (JSON), else its label's name, else its flag."""
    return F.coalesce(F.get_json_object(expected, "$.valid").cast("boolean"), F.when(label.isNotNull(), label.isin("accepted", "provisional", "valid")), valid, F.lit(False))


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def report(items: DataFrame) -> DataFrame:
    """One row of figures over items (expected_valid, predicted_valid, decision, provider); a rate of nothing is 0."""
    e, p = F.col("expected_valid"), F.col("predicted_valid")
    counts = items.agg(F.count("*").alias("total"), F.count_if(e & p).alias("tp"), F.count_if(~e & ~p).alias("tn"), F.count_if(~e & p).alias("false_positives"), F.count_if(e & ~p).alias("false_negatives"), F.count_if(F.col("decision") == "manual_review").alias("reviews"), F.count_if(F.col("provider").isNotNull()).alias("covered"))
    tp, fp, fn = F.col("tp"), F.col("false_positives"), F.col("false_negatives")
    rows = counts.withColumn("precision", _rate(tp, tp + fp)).withColumn("recall", _rate(tp, tp + fn))
    return rows.select("total", _rate(tp + F.col("tn"), F.col("total")).alias("accuracy"), "precision", "recall", _rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), _rate(F.col("reviews"), F.col("total")).alias("review_rate"), "false_positives", "false_negatives", _rate(F.col("covered"), F.col("total")).alias("geocoding_coverage"))


def bucket(confidence: Column) -> Column:
    return F.when(confidence < 0.50, "lt_0_50").when(confidence < 0.75, "ge_0_50_lt_0_75").when(confidence < 0.90, "ge_0_75_lt_0_90").otherwise("ge_0_90")


def histogram(items: DataFrame) -> DataFrame:
    """All four buckets with their counts, empty ones too."""
    return items.agg(*[F.count_if(bucket(F.col("confidence")) == b[0]).alias(b[0]) for b in BUCKETS])


def by_provider(items: DataFrame) -> DataFrame:
    right = F.col("expected_valid") == F.col("predicted_valid")
    return items.groupBy(F.coalesce("provider", F.lit("unresolved")).alias("provider")).agg(F.count("*").alias("total"), F.count_if(right).alias("correct")).withColumn("accuracy", F.col("correct") / F.col("total"))


def failures(figures: DataFrame, minimums: dict[str, float] | None = None) -> DataFrame:
    """Figures below their minimum: metric, value, minimum, message."""
    least = MINIMUMS | (minimums or {})
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("minimum")) for k, v in least.items()])
    out = figures.select(F.explode(rows).alias("x")).select("x.*").filter("value < minimum")
    return out.withColumn("message", F.format_string("%s=%.3f < %.3f", "metric", "value", "minimum"))


def as_json(figures: DataFrame) -> DataFrame:
    return figures.select(F.to_json(F.struct("*")).alias("report"))


def as_markdown(figures: DataFrame) -> DataFrame:
    line = lambda k, form: F.format_string(f"- {k}: {form}", k)
    rates = ("accuracy", "precision", "recall", "f1", "review_rate", "geocoding_coverage")
    return figures.select(F.concat_ws("\n", F.lit("# Location quality"), line("total", "%d"), *[line(k, "%.3f") for k in rates]).alias("report"))


def duplicate_cases(cases: DataFrame) -> DataFrame:
    """Whether decisions on labelled pairs are as expected: ok holds if the decision matches and the score suffices, where given."""
    ok = F.coalesce(F.col("decision") == F.col("expected_decision"), F.lit(True)) & F.coalesce(F.col("score") >= F.col("score_min"), F.lit(True))
    return cases.withColumn("ok", ok)
