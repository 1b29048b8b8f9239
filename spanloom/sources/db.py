"""Options for the public genome databases over JDBC (the MySQL driver must be on the class path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Public read-only servers.
UCSC = {"host": "genome-mysql.soe.ucsc.edu", "user": "genomep", "password": "password", "port": 3306}
ENSEMBL = {"host": "ensembldb.ensembl.org", "user": "anonymous", "password": "", "port": 3306}


def jdbc_options(dbname: str, host: str, user: str, password: str, port: int) -> dict[str, str]:
    return {"url": f"jdbc:mysql://{host}:{port}/{dbname}", "user": user, "password": password, "driver": "com.mysql.cj.jdbc.Driver"}


def db_ucsc(dbname: str, **server) -> dict[str, str]:
    return jdbc_options(dbname, **{**UCSC, **server})


def db_ensembl(dbname: str, **server) -> dict[str, str]:
    return jdbc_options(dbname, **{**ENSEMBL, **server})


def read_table(spark: SparkSession, options: dict[str, str], table: str, partition: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 1) -> DataFrame:
    """A table of a database; with ``partition``, a numeric column, it is read in parallel ranges. Filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition:
        reader = reader.options(partitionColumn=partition, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()
