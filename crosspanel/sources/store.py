"""Tables of results: append, replace, replace by key, insert-ignore, upsert, purge and ledgers.

Tables are Parquet folders, partitioned by a key column where rows are replaced by key, so that a
run touches only the partitions it brings. Nothing is updated in place; a rewritten table goes to
a new folder first and takes the old one's place by rename. The old folder is set aside until then:
a table that a crash left without its folder is found there and put back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Table:
    """One table at a path any Spark file system can reach."""

    def __init__(self, spark: SparkSession, path: str, partition: str | None = None) -> None:
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition

    def _fs(self):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _aside(self):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}.before")

    def exists(self) -> bool:
        path, fs = self._fs()
        if not fs.exists(path) and fs.exists(self._aside()):  # a replacement that did not get to its end
            fs.rename(self._aside(), path)
        return fs.exists(path)

    def read(self) -> DataFrame:
        self.exists()
        return self.spark.read.parquet(self.path)

    def columns(self) -> list[tuple[str, str]]:
        """Names and types of the columns, from the schema alone; none if there is no table."""
        return self.read().dtypes if self.exists() else []

    def _write(self, df: DataFrame, mode: str, path: str | None = None) -> None:
        writer = df.write.mode(mode)
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(path or self.path)

    def append(self, df: DataFrame) -> None:
        self._write(df, "append")

    def replace(self, df: DataFrame) -> None:
        """All rows; df may read this table."""
        path, fs = self._fs()
        fresh = f"{self.path}.{uuid.uuid4().hex}"
        self._write(df, "error", fresh)
        if self.exists():
            fs.delete(self._aside(), True)
            fs.rename(path, self._aside())
        fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(fresh), path)
        fs.delete(self._aside(), True)

    def replace_partitions(self, df: DataFrame) -> None:
        """Only the partitions that df brings (dynamic overwrite)."""
        if not self.partition:
            raise ValueError("the table has no partition column")
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(self.path)

    def insert_ignore(self, df: DataFrame, keys: list[str]) -> None:
        """Rows whose keys are not there yet."""
        new = df.dropDuplicates(keys)
        self.append(new.join(self.read().select(*keys), keys, "left_anti") if self.exists() else new)

    def upsert(self, df: DataFrame, keys: list[str]) -> None:
        """df's rows in place of those with their keys."""
        if not self.exists():
            return self.append(df)
        both = self.read().withColumn("_new", F.lit(0)).unionByName(df.withColumn("_new", F.lit(1)))
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new")))
        self.replace(both.withColumn("_k", last).where("_k = 1").drop("_k", "_new"))

    def purge(self, condition: str) -> None:
        """Without the rows that meet the condition."""
        self.replace(self.read().where(f"not coalesce({condition}, false)"))

    def last(self, column: str):  # noqa: ANN201
        """Largest value of a column, or None."""
        return self.read().agg(F.max(column)).first()[0] if self.exists() else None

    def missing(self, wanted: DataFrame, key: str) -> DataFrame:
        """Keys of wanted that the table lacks or holds last (the last one is provisional)."""
        if not self.exists():
            return wanted.select(key).distinct()
        held = self.read().select(key).distinct()
        return wanted.select(key).distinct().join(held.where(F.col(key) < F.lit(self.last(key))), key, "left_anti")


def tail(df: DataFrame, column: str, days: int) -> DataFrame:
    """Rows of the last days before the column's largest value."""
    last = df.agg(F.max(column)).first()[0]
    return df.where(F.col(column) >= F.date_sub(F.lit(last), days))


def changed(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, old, new) where the value is not the same, nulls equal to nulls."""
    both = old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), keys, "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_state(df: DataFrame, *columns: str) -> DataFrame:
    """df with the columns as one JSON text, `state`."""
    return df.select(*(c for c in df.columns if c not in columns), F.to_json(F.struct(*columns)).alias("state"))


def from_state(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a JSON text again."""
    return df.select(*(c for c in df.columns if c != "state"), F.from_json("state", schema).alias("_s")).select("*", "_s.*").drop("_s")
