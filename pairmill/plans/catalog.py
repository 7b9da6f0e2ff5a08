"""All queries over the driver tables, by name, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.operators import similarity, splits
from pairmill.plans import evaluation, graph, sampling, scalars, tables  # noqa: F401  they register
from pairmill.plans.fixtures import Views
from pairmill.plans.registry import QUERIES, SQL  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures -> duplicate components -> closure over held content -> eligible figures,
    counted per component size class."""
    v = Views(spark, sf_dir)
    return graph.eligible(v).groupBy("doi").agg(F.count("*").alias("figures"), F.min("uuid").alias("first_uuid"))
