"""Reading the five tables with their fixed schemas, from parquet or JDBC."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.schema import SCHEMAS, Tables


def read_parquet(spark: SparkSession, name: str, *paths: str) -> DataFrame:
    """One table from parquet; the schema is stated, never inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(*paths)


@dataclass(frozen=True)
class JdbcSource:
    """A relational source read in `partitions` id ranges at once.

    The ranges lie between the lowest and highest id, which the source is asked for first.
    `project` and `projectstage` names are those of the source; only columns of the schema
    are selected.
    """

    url: str
    partitions: int = 16
    properties: dict = field(default_factory=dict)

    @staticmethod
    def key(name: str) -> str:
        return "projectId" if name == "projectstage" else "id"

    def bounds_options(self, name: str) -> dict[str, str]:
        ends = f"SELECT min({self.key(name)}) AS low, max({self.key(name)}) AS high FROM {name}"
        return {"url": self.url, "dbtable": f"({ends}) AS {name}_ends", **self.properties}

    def options(self, name: str, low: int, high: int) -> dict[str, str]:
        columns = ", ".join(SCHEMAS[name].fieldNames())
        return {
            "url": self.url,
            "dbtable": f"(SELECT {columns} FROM {name}) AS {name}_rows",
            "partitionColumn": self.key(name),
            "lowerBound": str(low),
            "upperBound": str(high + 1),
            "numPartitions": str(self.partitions),
            **self.properties,
        }

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        ends = spark.read.format("jdbc").options(**self.bounds_options(name)).load().first()
        low, high = (int(v or 0) for v in ends)
        rows = spark.read.format("jdbc").options(**self.options(name, low, high)).load()
        return conform(rows, name)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the table's schema, column by column."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])


def load_tables(spark: SparkSession, root: str) -> Tables:
    """Tables stored as `<root>/<table name>` parquet folders."""
    return Tables(
        fact=read_parquet(spark, "main", f"{root}/main"),
        project=read_parquet(spark, "project", f"{root}/project"),
        deadline=read_parquet(spark, "projectstage", f"{root}/projectstage"),
        stage=read_parquet(spark, "stage", f"{root}/stage"),
        user=read_parquet(spark, "user", f"{root}/user"),
    )


def load_jdbc_tables(spark: SparkSession, source: JdbcSource) -> Tables:
    return Tables(
        fact=source.read(spark, "main"),
        project=source.read(spark, "project"),
        deadline=source.read(spark, "projectstage"),
        stage=source.read(spark, "stage"),
        user=source.read(spark, "user"),
    )
