"""Base URLs of services, and the query that gives them with the other defaults of a response."""

import duckdb

from corpusloom import providers
from corpusloom.plans import catalogue
from tests.test_policy import many


def plain(base):
    if "/compatible-mode" in base:
        return base
    return base.replace("/v1", "/compatible-mode/v1") if base.endswith("/v1") else base.rstrip("/") + "/compatible-mode/v1"


def test_base_urls(spark):
    bases = ["https://h/v1", "https://h/v1/", "https://h/api/", "https://h/api", "https://h//", "https://h//v1", "https://h/compatible-mode/x", "https://h/compatible-mode/v1", "https://h/v1/api/v1", "https://h/v1/api", "https://h/v10", "/v1", "/", ""]
    assert many(spark, providers.compatible_url, bases) == [plain(x) for x in bases]
    assert many(spark, providers.compatible_url, [None]) == [None]


def test_responses_have_their_urls(spark, sf_dir):
    got = catalogue.response_defaults(spark, sf_dir)
    assert got.columns == ["request_id", "answer", "confidence", "success", "latency_ms", "url"]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = duck.execute(catalogue.ORACLE_SQL["response_defaults"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({r[-1] for r in want}) == 3
