"""Named datasets, kept as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PREFIX = "dataset_"


class Catalog:
    """Add, list, select and remove named datasets of one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._names: dict[str, str] = {}

    def add(self, name: str, df: DataFrame) -> None:
        view = _PREFIX + "".join(c if c.isalnum() else "_" for c in name).lower()
        taken = {v: n for n, v in self._names.items()}
        while taken.get(view, name) != name:
            view += "_"
        df.createOrReplaceTempView(view)
        self._names[name] = view

    def get(self, name: str) -> DataFrame:
        if name not in self._names:
            raise ValueError(f"Dataset '{name}' not found")
        return self.spark.table(self._names[name])

    def remove(self, name: str) -> None:
        self.get(name)
        self.spark.catalog.dropTempView(self._names.pop(name))

    def names(self) -> list[str]:
        return list(self._names)

    def listing(self) -> DataFrame:
        """One row per dataset: name, rows, columns."""
        parts = [
            self.get(n).agg(
                F.lit(n).alias("dataset"),
                F.count(F.lit(1)).alias("rows"),
                F.lit(len(self.get(n).columns)).cast("long").alias("columns"),
            )
            for n in self._names
        ]
        if not parts:
            return self.spark.createDataFrame([], "dataset string, rows long, columns long")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
