"""Model choice for a target column."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.model import select_model
from millrace.workload.registry import query, table


@query()
def model_select(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.length("text").alias("length"))
    rows = documents.join(table(spark, sf_dir, "labels"), "doc_id")
    choices = select_model(rows, "doc_id", "quality", ["n_chars", "length"], ["lang"])
    ranked = [(i + 1, c.name, round(c.score, 4)) for i, c in enumerate(choices)]
    return spark.createDataFrame(ranked, "place int, model string, area_under_roc double")
