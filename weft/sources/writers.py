"""Sinks. Spark's committer makes each write whole; a manifest, where asked for, is written last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.integrity import row_fingerprint


def write_delimited(df: DataFrame, path: str, sep: str = "\t", na: str = "NA", gzip: bool = False, one_file: bool = False) -> None:
    """Delimited text; one_file only for results that are small."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("errorifexists").option("sep", sep).option("header", True).option("nullValue", na).option("compression", "gzip" if gzip else "none").csv(path)


def copy_lines(spark: SparkSession, source: str, path: str) -> None:
    """Text lines of any compression that Spark reads, written plainly; readers see the copy when it is whole."""
    spark.read.text(source).write.mode("errorifexists").text(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def wrapped(sequence: Column, width: int = 80) -> Column:
    return F.rtrim(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def write_fasta(df: DataFrame, path: str, record_id: str = "record_id", sequence: str = "sequence", width: int = 80) -> None:
    df.select(F.concat(F.lit(">"), F.col(record_id), F.lit("\n"), wrapped(F.col(sequence), width))).write.mode("errorifexists").text(path)


def write_with_manifest(df: DataFrame, path: str, columns: Sequence[str], **settings: str) -> None:
    """Parquet at path/data, then path/manifest with row count, an order-free fingerprint and the settings; a reader that finds the manifest finds whole data."""
    write_parquet(df, f"{path}/data")
    done = row_fingerprint(df.sparkSession.read.parquet(f"{path}/data"), *columns)
    done.select("*", *[F.lit(v).alias(k) for k, v in settings.items()]).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def reusable(spark, path: str, **settings: str) -> bool:
    """Whether a manifest with these settings is there."""
    try:
        rows = spark.read.json(f"{path}/manifest").limit(2).collect()
    except Exception as e:  # no such path, or not yet written
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    return len(rows) == 1 and all(rows[0].asDict().get(k) == v for k, v in settings.items())


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A report table of a small result; refuses more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"
