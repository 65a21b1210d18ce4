"""Small helpers shared by the corpus operators: inputs and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text handed to a Python worker at a time; keeps a batch at a few MB.
TEXT_ROWS_PER_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The two columns that text operators read: the key and the text, null text as empty.

    Rows without a key have no identity to report and are left out. All other columns
    are left behind here, so their names cannot clash with those an operator adds.
    """
    return docs.select(F.col(key), F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.col(key).isNotNull())


def small_batches(spark: SparkSession) -> None:
    """Bound the rows in an Arrow batch, unless the session already asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > TEXT_ROWS_PER_BATCH:
        spark.conf.set(name, str(TEXT_ROWS_PER_BATCH))


def rows_by(docs: DataFrame, keys: dict[str, Column], listed: DataFrame, how: str = "left_semi", once: bool = True) -> DataFrame:
    """The rows of docs whose `keys` are listed (left_anti: are not), all columns kept; of rows with equal keys one, if `once`.

    A row travels as one struct, so no name of its columns can clash with those of the keys.
    """
    rows = docs.select(F.struct("*").alias("_row"), *[c.alias(k) for k, c in keys.items()]).join(listed, list(keys), how)
    return (rows.dropDuplicates(list(keys)) if once else rows).select("_row.*")
