"""Analysis of a quality model trained on the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitspark.functions.mathfn import rnd
from pitspark.operators import analysis as A
from pitspark.plans.registry import query
from pitspark.session import materialise
from pitspark.sources.views import Tables

C = F.col
FEATURES = ["chars", "words", "lines", "digits", "upper"]
GROUPS = {"size": ["chars", "words", "lines"], "shape": ["digits", "upper"], "all": FEATURES}


def quality_rows(t: Tables):
    """Text shape features of documents with a quality label."""
    d = t.read("documents")
    text = C("text")
    feats = d.select(
        "doc_id",
        "lang",
        F.ln(F.length(text) + F.lit(1.0)).alias("chars"),
        F.ln(F.size(F.split(text, " ")) + F.lit(1.0)).alias("words"),
        F.ln(F.size(F.split(text, "\n")) + F.lit(1.0)).alias("lines"),
        (F.regexp_count(text, F.lit("[0-9]")) / F.greatest(F.length(text), F.lit(1))).alias("digits"),
        (F.regexp_count(text, F.lit("[A-Z]")) / F.greatest(F.length(text), F.lit(1))).alias("upper"),
    )
    labels = t.read("labels").select("doc_id", C("quality").cast("double").alias("label"))
    return feats.join(labels, "doc_id").withColumn("is_en", C("lang") == "en")


def quality_model(rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        LogisticRegression(featuresCol="scaled", labelCol="label", regParam=1e-3, maxIter=30),
    ]
    return Pipeline(stages=stages).fit(rows)


@query("permutation_importance")
def permutation_importance(t: Tables):
    """Loss increase when a feature is shuffled."""
    rows = materialise(quality_rows(t))
    out = A.permutation_importance(rows, quality_model(rows), features=FEATURES, label="label", row_id="doc_id")
    return out.select("feature", *[rnd(C(c), 4).alias(c) for c in ("delta_mean", "delta_std", "base_loss")])


@query("group_ablation")
def group_ablation(t: Tables):
    """Loss with a feature group zeroed, per language bucket."""
    rows = materialise(quality_rows(t))
    out = A.group_ablation(rows, quality_model(rows), groups=GROUPS, label="label", bucket="is_en")
    return out.select("ablation", "bucket", rnd(C("loss"), 4).alias("loss"), rnd(C("accuracy"), 4).alias("accuracy"), "n")
