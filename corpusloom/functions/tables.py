"""Table functions for SQL, whose result has the columns of the table that they are given.

    register(spark)
    SELECT * FROM chunk_text(TABLE(docs), text => 'body', size => 800)
    SELECT * FROM breaker_states(TABLE(calls) PARTITION BY model ORDER BY at)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

from corpusloom.config import DEFAULT
from corpusloom.operators.chunking import placed_by_paragraphs
from corpusloom.operators.state import Breaker


def _table(rows: AnalyzeArgument) -> StructType:
    if not rows.isTable:
        raise ValueError("the first argument is a table: TABLE(name)")
    return rows.dataType


def _constant(argument: AnalyzeArgument | None, default):
    if argument is None:
        return default
    if not argument.isConstantExpression:
        raise ValueError("options are constants")
    return argument.value


class ChunkText:
    """The other columns of each row with piece (from 1), content, start and end of every chunk of its text."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument | None = None, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        name, fields = _constant(text, "text"), _table(rows)
        if name not in fields.names:
            raise ValueError(f"the table has no column {name}")
        if _constant(size, 1) < 1 or _constant(overlap, 0) < 0:
            raise ValueError("a chunk has a positive size, and an overlap that isn't negative")
        made = StructType([f for f in fields.fields if f.name != name])
        return AnalyzeResult(made.add("piece", IntegerType()).add("content", StringType()).add("start", IntegerType()).add("end", IntegerType()))

    def eval(self, rows: Row, text: str = "text", size: int = DEFAULT.chunking.size, overlap: int = DEFAULT.chunking.overlap) -> Iterator[tuple]:
        others = [v for k, v in rows.asDict(recursive=False).items() if k != text]
        for n, (chunk, start, end) in enumerate(placed_by_paragraphs(rows[text] or "", size, overlap), 1):
            yield (*others, n, chunk, start, end)


class BreakerStates:
    """Each call (at: seconds, failed) with allowed and state; the rows of a partition go through one breaker in their order."""

    def __init__(self) -> None:
        self.breaker = Breaker()

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        fields = _table(rows)
        for name in ("at", "failed"):
            if name not in fields.names:
                raise ValueError(f"the table has no column {name}")
        return AnalyzeResult(StructType([*fields.fields]).add("allowed", BooleanType()).add("state", StringType()))

    def eval(self, rows: Row) -> Iterator[tuple]:
        yield (*rows, *self.breaker.call(rows["at"], bool(rows["failed"])))


def register(spark: SparkSession) -> None:
    """Make ``chunk_text`` and ``breaker_states`` known to the session's SQL."""
    spark.udtf.register("chunk_text", udtf(ChunkText))
    spark.udtf.register("breaker_states", udtf(BreakerStates))
