"""Writers: tables, JSON, conversations, errors, todos, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS, PRIORITY = ("pending", "in_progress", "completed"), ("high", "medium", "low")


def table(df: DataFrame, path: str) -> None:
    """By the path's end: .csv with a header, .txt for one text column, .json, else Parquet."""
    writer = df.write.mode("overwrite")
    end = path.rstrip("/").rpartition(".")[2].lower()
    if end == "csv":
        writer.option("header", "true").csv(path)
    elif end == "txt":
        writer.text(path)
    elif end == "json":
        writer.json(path)
    elif end in ("parquet", "pq"):
        writer.parquet(path)
    else:
        raise TypeError(f"no writer for .{end}")


def conversation(messages: DataFrame, path: str) -> None:
    """Append to the log, a folder a user and mode."""
    messages.write.mode("append").partitionBy("user_id", "mode").parquet(path)


def clear_conversation(messages: DataFrame, path: str) -> None:
    """Overwrite just the partitions that messages has."""
    messages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_id", "mode").parquet(path)


def errors(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("component").parquet(path)


def todos(df: DataFrame, path: str) -> None:
    """Replace the list; a status or priority that is none of the known fails."""
    checked = df.where(F.assert_true(F.col("status").isin(*STATUS) & F.col("priority").isin(*PRIORITY)).isNull())
    checked.write.mode("overwrite").json(path)


def vectors(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def code_tree(tables: dict[str, DataFrame], path: str, as_json: bool = False) -> None:
    """Every table of a code tree below one folder."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        writer.json(f"{path}/{name}") if as_json else writer.parquet(f"{path}/{name}")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a stored table (a vector store) with its folder; nothing happens where none is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
