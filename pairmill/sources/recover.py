"""Selected objects from a table of encoded cells: all of them and whole, or an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.functions.imaging import decoded


def recover(selected: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """(key, md5, bytes) for each selected key, from `raw` (key, cell in base64, md5). A key that
    is selected twice, that `raw` lacks or has twice, a cell that isn't base64 and bytes that don't
    fit their md5 are errors that name the key; only selected cells are decoded."""
    twice = selected.groupBy(key).count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"{key} {twice[0]} is selected twice")
    own = raw.join(selected.select(key), key, "left_semi")
    met = selected.select(key).join(own.withColumn("__there", F.lit(True)), key, "left")
    per = met.groupBy(key).agg(F.count("*").alias("__n"), F.first("__there").alias("__there"), F.first("cell").alias("cell"), F.first("md5").alias("md5"))
    data = decoded(F.col("cell"))
    said = lambda what: F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(f": {what}"))
    wrong = (
        F.when(F.col("__there").isNull(), said("no such row"))
        .when(F.col("__n") > 1, said("more rows than one"))
        .when(data.isNull(), said("no base64"))
        .when(~F.md5(data).eqNullSafe(F.col("md5")), said("bytes of another md5"))
    )
    return per.select(key, "md5", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("binary")).otherwise(data).alias("bytes"))
