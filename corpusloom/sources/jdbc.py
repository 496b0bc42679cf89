"""Tables of a database: scans in even parts, whatever the keys, and writes that can be sent again."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")


@dataclass(frozen=True)
class Database:
    """A JDBC address with the options of Spark's reader, such as user, password or driver."""

    url: str
    options: tuple[tuple[str, str], ...] = ()

    def reader(self, spark: SparkSession):
        return spark.read.format("jdbc").option("url", self.url).options(**dict(self.options))

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return self.reader(spark).option("query", sql).load()


def _checked(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no plain name of a table or column")
    return name


def bounds(spark: SparkSession, database: Database, table: str, key: str, parts: int) -> list[tuple[int, int]]:
    """Ranges [low, high) of a whole-number key with about equal numbers of rows, as the data has them.

    Ranges of too many rows are halved, all those of a round counted by one
    query, until there are enough or none can be halved; so keys that lie close
    together far from the others are in ranges of their own.
    """
    table, key = _checked(table), _checked(key)
    row = database.query(spark, f"SELECT MIN({key}) AS a, MAX({key}) AS b, COUNT({key}) AS n FROM {table}").first()
    if not row[2]:
        return []
    done, open_, share = [], [(int(row[0]), int(row[1]) + 1, int(row[2]))], max(1, -(-int(row[2]) // parts))
    while open_:
        halves = []
        for low, high, n in open_:
            if n <= share or high - low < 2:
                done.append((low, high, n))
            else:
                halves += [(low, (low + high) // 2), ((low + high) // 2, high)]
        open_ = []
        for a in range(0, len(halves), 500):
            some = halves[a : a + 500]
            sums = ", ".join(f"SUM(CASE WHEN {key} >= {low} AND {key} < {high} THEN 1 ELSE 0 END) AS c{i}" for i, (low, high) in enumerate(some))
            counts = database.query(spark, f"SELECT {sums} FROM {table}").first()
            open_ += [(low, high, int(n)) for (low, high), n in zip(some, counts, strict=True) if n]
    merged: list[tuple[int, int, int]] = []
    for low, high, n in sorted(done):
        if merged and merged[-1][2] + n <= share:
            merged[-1] = (merged[-1][0], high, merged[-1][2] + n)
        else:
            merged.append((low, high, n))
    return [(low, high) for low, high, _ in merged]


def scan(spark: SparkSession, database: Database, table: str, key: str, parts: int) -> DataFrame:
    """A table in about ``parts`` partitions of like size by a whole-number key; rows without a key are one more.

    Filters and columns that are asked of the result go to the database.
    """
    ranges = bounds(spark, database, table, key, parts)
    predicates = [f"{key} >= {low} AND {key} < {high}" for low, high in ranges] + [f"{key} IS NULL"]
    return spark.read.jdbc(database.url, _checked(table), predicates=predicates, properties=dict(database.options))


def write(rows: DataFrame, database: Database, table: str, batch: str, batch_size: int = 10_000) -> bool:
    """Append ``rows`` once for each ``batch``, an id of letters, digits and ``_-``; whether this call did.

    Tasks insert into a table of this attempt, as often as they have to.  One
    transaction on the driver then copies it and notes the batch, so a job that died at
    any point can be run again, and a batch that was noted changes nothing.  The table must have the columns of ``rows``.
    """
    if not re.fullmatch(r"[\w-]{1,100}", batch):
        raise ValueError(f"{batch!r} is no id of a batch")
    spark, table = rows.sparkSession, _checked(table)
    staging, log = f"{table}_s{uuid.uuid4().hex[:12]}", f"{table}_batches"
    columns = ", ".join(f'"{c}"' for c in rows.columns)
    properties = spark._jvm.java.util.Properties()
    for name, value in database.options:
        properties.setProperty(name, value)

    def noted(statement) -> bool:
        found = statement.executeQuery(f"SELECT COUNT(*) FROM {log} WHERE batch = '{batch}'")
        found.next()
        return found.getInt(1) > 0

    spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(spark._jvm.java.sql.DriverManager.getDriver(database.url).getClass().getName())
    connection = spark._jvm.java.sql.DriverManager.getConnection(database.url, properties)
    try:
        statement = connection.createStatement()
        if not connection.getMetaData().getTables(None, None, log.upper(), None).next():
            statement.executeUpdate(f"CREATE TABLE {log} (batch VARCHAR(100) PRIMARY KEY)")
        if noted(statement):
            return False
        rows.write.format("jdbc").option("url", database.url).options(**dict(database.options)).option("dbtable", staging).option("batchsize", batch_size).mode("overwrite").save()
        connection.setAutoCommit(False)
        try:
            statement.executeUpdate(f"INSERT INTO {log} VALUES ('{batch}')")  # fails if another run has noted it meanwhile
            statement.executeUpdate(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staging}")
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.setAutoCommit(True)
            statement.executeUpdate(f"DROP TABLE {staging}")
        return True
    finally:
        connection.close()
