"""What needs a model or a parser, behind small protocols with deterministic offline defaults."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from string import Formatter
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.config import DEFAULT, Resilience
from corpusloom.functions import policy, replies
from corpusloom.functions.text import drop_page_noise, let, preview, strip, tokens, years
from corpusloom.operators.state import Breaker


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with vector: array<float>, null where there is none."""


class Generator(Protocol):
    def answer(self, df: DataFrame, question: str, passages: str) -> DataFrame:
        """``df`` with answer; passages: array<struct<chunk_id, content>>."""


class PdfParser(Protocol):
    def pages(self, content: bytes) -> list[str]: ...


class HashingEmbedder:
    """Unit vectors of hashed token counts."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        dim = self.dim

        @F.pandas_udf("array<float>")
        def run(column: pd.Series) -> pd.Series:
            out = []
            for terms in column:
                v = np.zeros(dim, np.float32)
                for t in () if terms is None else terms:
                    h = zlib.crc32(t.encode())
                    v[h % dim] += 1 if h >> 31 else -1
                norm = np.linalg.norm(v)
                out.append(v / norm if norm else None)
            return pd.Series(out)

        return df.withColumn("vector", run(tokens(F.col(text))))


class ExtractiveGenerator:
    """The start of each passage with its citation."""

    def answer(self, df: DataFrame, question: str, passages: str) -> DataFrame:
        cited = F.transform(passages, lambda p: F.concat(preview(p["content"]), F.lit(" [Chunk "), p["chunk_id"].cast("string"), F.lit("]")))
        return df.withColumn("answer", F.array_join(cited, "\n"))


class ExtractiveSummary:
    """The first sentence of each passage that has one, with its citation."""

    def answer(self, df: DataFrame, question: str, passages: str) -> DataFrame:
        first = lambda p: strip(F.regexp_extract(strip(p["content"]), r"^[^。.！？!?\n]*[。.！？!?]?", 0))
        said = F.transform(passages, lambda p: F.when(first(p) != "", F.concat(first(p), F.lit(" [Chunk "), p["chunk_id"].cast("string"), F.lit("]"))))
        return df.withColumn("answer", F.array_join(said, "\n"))


class FormFeedParser:
    """Pages of plain text parted by form feeds."""

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8", "replace").split("\f")


# Where a model's text that isn't JSON has its main query.
QUOTED = r"""["']([^"']+)["']"""
NAMED = r"""(?i)primary[_\s]*query[:\s]+["']?([^"'\n]+)"""


def rewrite(df: DataFrame, query: str = "query") -> DataFrame:
    """``df`` with rewritten_queries and years, as without a model: the query itself, and the years it names."""
    return df.withColumn("rewritten_queries", policy.rewrites(F.col(query), F.array(F.col(query)))).withColumn("years", years(F.col(query)))


def parsed_rewrite(raw: Column, query: Column) -> Column:
    """primary_query, rewritten_queries and extracted_years of a model's text, JSON or not; the query stands in for what is missing."""

    def taken(raw: Column, value: Column) -> Column:
        quoted = F.regexp_extract(raw, QUOTED, 1)
        named = strip(F.regexp_extract(raw, NAMED, 1))
        plain = F.when(((F.length(raw) < 200) & F.contains(raw, F.lit("?"))) | F.contains(raw, F.lit("？")), F.trim(raw))
        said = F.coalesce(F.when(quoted != "", quoted), F.when(named != "", named), plain, query)
        primary = F.when(replies.is_object(value), F.coalesce(replies.text_at(value, "$.primary_query"), query)).otherwise(said)
        given = replies.texts_at(value, "$.rewritten_queries")
        given = F.when(F.size(given) > 0, given).when(replies.is_object(value), F.array(primary))
        return F.struct(primary.alias("primary_query"), policy.rewrites(query, given).alias("rewritten_queries"), replies.whole_numbers_at(value, "$.extracted_years").alias("extracted_years"))

    return let(raw, lambda r: let(replies.parsed(r), lambda value: taken(r, value)))


def parse_files(files: DataFrame, parser: PdfParser) -> DataFrame:
    """path, page_no, text and failed of each page of the files (path, content); a file that can't be read gives one page that says so, and failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    pages, failed = parser.pages(bytes(content)), False
                except Exception as error:  # a page of its own stands for what a parser can't read
                    pages, failed = [f"[页面解析失败: {error}]"], True
                rows += [(path, n, text, failed) for n, text in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "failed"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, text string, failed boolean").withColumn("text", drop_page_noise(F.col("text")))


class ModelError(Exception):
    """What a model's service answers instead of a reply, with its HTTP status."""

    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


def failure(error: Exception) -> tuple[str, bool]:
    """The kind of a model's error, and whether to try again: after timeouts, lost connections, too many requests and the service's own faults."""
    status = getattr(error, "status", None)
    if isinstance(error, TimeoutError):
        return "timeout", True
    if isinstance(error, ConnectionError):
        return "fallback", True
    if status == 429:
        return "rate_limit", True
    if status is not None and 500 <= status < 600:
        return "5xx", True
    return ("parse_error" if isinstance(error, ValueError) else "fallback"), False


# The path of a service's compatible mode, and what of a base URL without it makes way: each version where it ends with one, else the slashes at its end.
MODE = "/compatible-mode"
MODELESS = r"(?s)/v1(?=(?:.*/v1)?\z)|(?<!/)/+\z|(?<!/v1|/)\z"


def compatible_url(base: Column) -> Column:
    """A service's base URL with the path of its compatible mode; one that names the mode stays as it is."""
    return F.when(F.contains(base, F.lit(MODE)), base).otherwise(F.regexp_replace(base, MODELESS, f"{MODE}/v1"))


def with_retries(
    call: Callable[[], str], wait: Callable[[float], None], settings: Resilience = DEFAULT.resilience, clock: Callable[[], float] = time.monotonic
) -> tuple[str | None, list[dict]]:
    """The result of ``call`` after up to so many attempts, and one event for each failure.

    Waits double between attempts; none is made that would go beyond the
    seconds allowed in all, nor after an error that another try won't mend.
    """
    events: list[dict] = []
    began = clock()
    for attempt in range(1, settings.max_attempts + 1):
        try:
            return call(), events
        except Exception as error:  # whatever a model raises, the next one is asked
            kind, again = failure(error)
            events.append({"attempt": attempt, "event_type": kind, "http_status": getattr(error, "status", None), "error_msg": str(error)})
            pause = min(settings.backoff_multiplier * 2 ** (attempt - 1), settings.backoff_max)
            if not again or attempt == settings.max_attempts or clock() - began + pause > settings.total_seconds:
                break
            wait(pause)
    return None, events


@dataclass
class Fallback:
    """A primary model behind a circuit breaker, and a second one for when it fails or isn't to be asked."""

    primary: Callable[[], str]
    secondary: Callable[[], str]
    settings: Resilience = DEFAULT.resilience
    breaker: Breaker = field(default_factory=Breaker)

    def answer(self, wait: Callable[[float], None], clock: Callable[[], float] = time.monotonic) -> tuple[str | None, str, list[dict]]:
        """The answer, which model gave it (or none), and the events; each use of the second model is an event."""
        events: list[dict] = []
        now = clock()
        if self.breaker.may_call(now, self.settings):
            said, events = with_retries(self.primary, wait, self.settings, clock)
            events = [e | {"model": "primary"} for e in events]
            self.breaker.call(now, said is None, self.settings)
            if said is not None:
                return said, "primary", events
        events.append({"attempt": 1, "event_type": "fallback", "http_status": None, "error_msg": "the primary model gave no answer" if events else "the circuit is open", "model": "secondary"})
        said, more = with_retries(self.secondary, wait, self.settings, clock)
        return said, "secondary" if said is not None else "none", events + [e | {"model": "secondary"} for e in more]


MODEL_EVENTS = "array<struct<model:string,attempt:int,event_type:string,http_status:int,error_msg:string>>"


def ask_models(
    prompts: DataFrame, prompt: str, primary: Callable[[str], str], secondary: Callable[[str], str], settings: Resilience = DEFAULT.resilience, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic
) -> DataFrame:
    """``prompts`` with answer, model (primary, secondary or none) and events, asked in the tasks.

    Each task has a breaker of its own for the primary model, as each process of
    a service has.  Any error of a model leads to the next try or the next model, never
    to the end of the job; without an answer from either, answer is null.  A null prompt asks nobody.
    """
    names = list(prompts.columns)
    fields = StructType([*prompts.schema.fields, *StructType.fromDDL(f"answer string, model string, events {MODEL_EVENTS}").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breaker = Breaker()
        for pdf in batches:
            said = []
            for text in pdf[prompt]:
                asked = Fallback(lambda t=text: primary(t), lambda t=text: secondary(t), settings, breaker)
                said.append((None, None, []) if text is None else asked.answer(wait, clock))
            yield pdf[names].assign(answer=[x[0] for x in said], model=[x[1] for x in said], events=[x[2] for x in said])

    return prompts.mapInPandas(run, fields)


def model_events(asked: DataFrame, key: str = "request_id") -> DataFrame:
    """The log of ``ask_models``: a row for each failed try and each use of the second model."""
    return asked.select(F.col(key), F.posexplode("events").alias("seq", "e")).select(key, "seq", "e.*")


# What a model is given.
SLOT_PROMPT = "槽位名列表：{slots}\n\n用户输入：{query}"
SUMMARY_PROMPT = "【参考资料】\n{context}\n\n【用户问题】\n{query}"


def filled_prompt(template: str | None, **values: Column) -> Column:
    """A template with its ``{names}`` replaced by columns, for each row; a name without a value, or no template, is an error."""
    if template is None:
        raise ValueError("there is no such template")
    parts = [F.lit(before) if name is None else F.concat(F.lit(before), values[name]) for before, name, _, _ in Formatter().parse(template)]
    return F.concat(*parts)


def slot_prompt(query: Column, names: Column) -> Column:
    """What asks a model for the values of slots (an array of names); null where none is wanted."""
    return F.when(F.size(names) > 0, filled_prompt(SLOT_PROMPT, slots=F.array_join(names, "、"), query=F.trim(query)))


def parsed_slots(raw: Column, names: Column) -> Column:
    """Values by slot of a model's JSON, fenced or not: those of wanted names that aren't blank; none of what isn't an object."""
    known = sorted({s[1] for s in policy.SLOTS})

    def taken(value: Column) -> Column:
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), strip(replies.text_at(value, f"$.{k}")).alias("value")) for k in known])
        return F.map_from_entries(F.filter(pairs, lambda p: F.array_contains(names, p["key"]) & p["value"].isNotNull() & (p["value"] != "")))

    return let(replies.parsed(raw), taken)
