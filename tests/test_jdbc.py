"""Scans and writes against the Derby that comes with Spark."""

import random

import pytest

from corpusloom.sources import jdbc


@pytest.fixture
def database(spark, tmp_path):
    return jdbc.Database(f"jdbc:derby:{tmp_path}/db;create=true", (("driver", "org.apache.derby.jdbc.EmbeddedDriver"),))


def run(spark, database, *statements):
    spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    connection = spark._jvm.java.sql.DriverManager.getConnection(database.url)
    for s in statements:
        connection.createStatement().executeUpdate(s)
    connection.close()


def test_even_parts_of_skewed_keys(spark, database):
    rng = random.Random(1)
    keys = [rng.randint(0, 100) for _ in range(300)] + [10**12 + rng.randint(0, 10**9) for _ in range(300)] + [None] * 5 + [7] * 100
    run(spark, database, 'CREATE TABLE t ("id" BIGINT, "v" VARCHAR(10))')
    spark.createDataFrame([(k, str(i)) for i, k in enumerate(keys)], "id long, v string").write.jdbc(database.url, "t", "append", dict(database.options))
    run(spark, database, 'CREATE VIEW named AS SELECT "id" AS k, "v" AS v FROM t')
    ranges = jdbc.bounds(spark, database, "named", "k", 8)
    counts = [sum(k is not None and a <= k < b for k in keys) for a, b in ranges]
    assert sum(counts) == 700 and all(b == c for (_, b), (c, _) in zip(ranges, ranges[1:]) if b == c) and len(ranges) >= 8 and max(counts) <= 115
    read = jdbc.scan(spark, database, "named", "k", 8)
    assert read.count() == len(keys) and read.rdd.getNumPartitions() == len(ranges) + 1
    filtered = read.where("V = '3'").select("K")
    assert "PushedFilters: [*IsNotNull(V), *EqualTo(V,3)]" in filtered._jdf.queryExecution().toString() and [r.K for r in filtered.collect()] == [keys[3]]
    run(spark, database, "CREATE TABLE empty (k BIGINT)")
    assert jdbc.bounds(spark, database, "empty", "k", 4) == [] and jdbc.scan(spark, database, "empty", "k", 4).count() == 0
    with pytest.raises(ValueError):
        jdbc.scan(spark, database, "t; DROP TABLE t", "k", 2)


def test_a_batch_counts_once(spark, database):
    run(spark, database, 'CREATE TABLE answers ("id" BIGINT NOT NULL PRIMARY KEY, "v" VARCHAR(10))')
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id long, v string").repartition(3)
    assert jdbc.write(rows(1, 2, 3), database, "answers", "b-1") and not jdbc.write(rows(1, 2, 3), database, "answers", "b-1")
    with pytest.raises(Exception):
        jdbc.write(rows(4, 3), database, "answers", "b-2")  # one row can't go in, so none does, nor is the batch noted
    assert jdbc.write(rows(4), database, "answers", "b-2") and jdbc.write(rows(), database, "answers", "b-3")
    found = database.query(spark, 'SELECT "id" FROM answers').collect()
    assert sorted(r[0] for r in found) == [1, 2, 3, 4]
    left = database.query(spark, "SELECT tablename FROM sys.systables WHERE tabletype = 'T'").collect()
    assert sorted(r[0] for r in left) == ["ANSWERS", "ANSWERS_BATCHES"]
