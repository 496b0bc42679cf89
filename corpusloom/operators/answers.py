"""Answers: context, citations, calculations, fan-out of rewrites and statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.config import DEFAULT
from corpusloom.functions import policy, replies
from corpusloom.functions.text import let, preview, strip


def merge_adjacent(chunks: DataFrame, by: tuple[str, ...] = ("document_id",), window: int = DEFAULT.policy.page_window) -> DataFrame:
    """by, island, chunk_ids and content: chunks of a document whose pages are at most ``window`` apart, joined in order.

    Without a page a chunk starts on page 0; without an end it ends where it starts.
    """
    paged = chunks.withColumn("page_start", F.coalesce("page_start", F.lit(0))).withColumn("page_end", F.coalesce(F.when(F.col("page_end") != 0, F.col("page_end")), F.col("page_start")))
    order = Window.partitionBy(*by).orderBy("page_start", "chunk_id")
    before = F.max("page_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = paged.withColumn("opens", F.coalesce((F.col("page_start") > before + window).cast("int"), F.lit(1)))
    islands = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("page_start", "chunk_id", "content")))
    return islands.groupBy(*by, "island").agg(ordered.alias("all")).select(*by, F.col("island").cast("int"), F.col("all.chunk_id").alias("chunk_ids"), F.array_join(F.col("all.content"), "\n\n").alias("content"))


def contexts(merged: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One context text for each request: labelled passages by document and page."""
    parts = F.array_sort(F.collect_list(F.struct("document_id", "island", policy.labelled(F.col("chunk_ids"), F.col("content")).alias("t"))))
    return merged.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("context"))


def cited(answers: DataFrame, chunks: DataFrame, key: str = "request_id", answer: str = "answer") -> DataFrame:
    """key, rank_no, chunk_id, quote: what an answer cites and the store has; rank_no is the place among all citations, repeats kept."""
    placed = answers.select(key, F.posexplode(policy.citations(F.col(answer))).alias("pos", "chunk_id"))
    return placed.join(chunks.select("chunk_id", "content"), "chunk_id").select(key, (F.col("pos") + 1).alias("rank_no"), "chunk_id", preview(F.col("content")).alias("quote"))


def fan_out(requests: DataFrame, query: str = "query", given: str = "given") -> DataFrame:
    """One row for each rewrite: the columns of ``requests``, route (from 0) and route_query."""
    return requests.select("*", F.posexplode(policy.rewrites(F.col(query), F.col(given))).alias("route", "route_query"))


@F.pandas_udf(StringType())
def large_whole(x: pd.Series) -> pd.Series:
    """All digits of whole numbers that a double has beyond 2^53, which decimals of Spark can't hold."""
    return pd.Series([str(int(v)) if v is not None and 2.0**53 <= abs(v) < float("inf") else None for v in x], dtype=object)


def number_text(x: Column) -> Column:
    """A number in its shortest form: whole ones without decimals, very small ones with an exponent of two digits."""
    plain = F.regexp_replace(x.cast("string").try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    small = F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.0)?E", "e"), r"e-(\p{Nd})$", "e-0$1")
    return F.when(F.abs(x) >= 2.0**53, large_whole(x)).when(F.rint(x) == x, x.try_cast("decimal(38,0)").cast("string")).when(F.abs(x) < 1e-4, small).otherwise(plain)


@F.pandas_udf(StringType())
def percent(ratio: pd.Series) -> pd.Series:
    """Two decimals, rounded from the exact binary value, which the JVM's formatting doesn't do."""
    return pd.Series(np.char.mod("%.2f%%", ratio.to_numpy(float) * 100)).where(ratio.notna().to_numpy(), None)


def formulas(df: DataFrame, op: str = "op", a: str = "a", b: str = "b") -> DataFrame:
    """``df`` with result and formula; without a result the formula says what is wrong, or is null for numbers that aren't finite."""
    result = policy.calculate(F.col(op), F.col(a), F.col(b))
    x, y = (number_text(F.col(c).cast("double")) for c in (a, b))
    growth = F.concat(F.lit("("), x, F.lit(" - "), y, F.lit(") / "), y, F.lit(" = "), percent(result))
    ratio = F.concat(x, F.lit(" / "), y, F.lit(" = "), percent(result))
    diff = F.concat(x, F.lit(" - "), y, F.lit(" = "), number_text(result))
    text = F.when(F.col(op) == "growth", growth).when(F.col(op) == "ratio", ratio).otherwise(diff)
    return df.withColumn("result", result).withColumn("formula", F.coalesce(F.when(result.isNotNull(), text), policy.calculation_problem(F.col(op), F.col(b))))


def with_formula(answer: Column, formula: Column) -> Column:
    """The formula goes below an answer that doesn't have it."""
    return F.when(F.contains(answer, formula), answer).otherwise(F.concat(answer, F.lit("\n\n"), formula))


def calc_payload(raw: Column) -> Column:
    """op_type, val1, val2 of a model's JSON, fenced or not, and whether to fall back to a plain answer; a value that isn't named is 0."""

    def judged(value: Column) -> Column:
        op = F.lower(strip(replies.text_at(value, "$.op_type")))
        val1, val2 = (F.when(replies.is_object(value), replies.number_at(value, f"$.{x}", 0.0)) for x in ("val1", "val2"))
        good = op.isin("growth", "diff", "ratio") & val1.isNotNull() & val2.isNotNull()
        return F.struct(op.alias("op_type"), val1.alias("val1"), val2.alias("val2"), (~F.coalesce(good, F.lit(False))).alias("fallback"))

    return let(replies.parsed(raw), judged)


def history_tail(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n turns of each conversation, in order."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)


def score_distribution(hits: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return hits.groupBy(*by).agg(F.count("*").alias("hits"), F.round(F.min("score"), 6).alias("min_score"), F.round(F.max("score"), 6).alias("max_score"), F.round(F.avg("score"), 6).alias("avg_score"))


def stream_events(requests: DataFrame) -> DataFrame:
    """Rows (request_id, seq, event, payload) of an answer that is streamed: what is missing, or the citations and then the tokens."""
    events = F.when(
        F.size("missing") > 0, F.array(F.struct(F.lit("slot_asking").alias("event"), F.to_json(F.struct("missing")).alias("payload")))
    ).otherwise(
        F.concat(
            F.array(F.struct(F.lit("citations").alias("event"), F.to_json(F.struct("citations")).alias("payload"))),
            F.transform(F.split("answer", ""), lambda c: F.struct(F.lit("answer").alias("event"), F.to_json(F.struct(c.alias("token"))).alias("payload"))),
        )
    )
    return requests.select("request_id", F.posexplode(F.concat(F.array(F.struct(F.lit("connected").alias("event"), F.lit("{}").alias("payload"))), events)).alias("seq", "e")).select("request_id", "seq", "e.event", "e.payload")



def with_response_defaults(responses: DataFrame) -> DataFrame:
    """Responses with every field of an answer: what is missing or null takes its default."""
    have = set(responses.columns)
    field = lambda name, default: (F.coalesce(F.col(name), default) if name in have else default).alias(name)
    defaults = {"success": F.lit(False), "answer": F.lit(""), "confidence": F.lit(0.0), "is_refused": F.lit(False), "citations": F.array().cast("array<bigint>"), "retrieved_chunks_count": F.lit(0), "cited_chunks_count": F.lit(0), "latency_ms": F.lit(0)}
    optional = [(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in ("model_name", "error")]
    return responses.select(*[c for c in responses.columns if c not in defaults and c not in ("model_name", "error")], *[field(k, v) for k, v in defaults.items()], *optional)
