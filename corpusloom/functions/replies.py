"""What models reply in JSON, fenced or not, as VARIANT: one tolerant parser, and typed values by path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import ascii_digits, strip

#: Fixed value: JSON within a fence.
FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"


def parsed(raw: Column) -> Column:
    """A reply as VARIANT: what its first fence holds, or else all of it; null where that isn't JSON."""
    fenced = F.regexp_extract(raw, FENCE, 1)
    return F.try_parse_json(F.when(fenced != "", fenced).otherwise(strip(raw)))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def problem(raw: Column) -> Column:
    """Why a reply has no fields: empty, no_json or not_an_object; null if it has."""
    value = parsed(raw)
    return F.when(strip(F.coalesce(raw, F.lit(""))) == "", "empty").when(value.isNull(), "no_json").when(~is_object(value), "not_an_object")


def text_at(value: Column, path: str) -> Column:
    """The value at a path as text; null where there is none, or null."""
    return F.try_variant_get(value, path, "string")


def has(value: Column, path: str) -> Column:
    """Whether there is anything at a path, a null included."""
    return F.try_variant_get(value, path, "variant").isNotNull()


def number_at(value: Column, path: str, missing: float | None = None) -> Column:
    """The number at a path, or a text's that is one; ``missing`` where there is nothing."""
    return F.when(has(value, path), text_at(value, path).try_cast("double")).otherwise(F.lit(missing).cast("double"))


def texts_at(value: Column, path: str) -> Column:
    """A list of texts at a path; null where that isn't a list, or has what can't be a text."""
    return F.try_variant_get(value, path, "array<string>")


def whole_numbers_at(value: Column, path: str) -> Column:
    """The whole numbers of a list: numbers without their fraction and texts of digits only; none of what isn't a list."""
    items = F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))

    def whole(item: Column) -> Column:
        said = F.try_variant_get(item, "$", "string")
        digits = F.when(said.rlike(r"^\p{Nd}+$"), ascii_digits(said).try_cast("int"))
        return F.when(F.schema_of_variant(item) == "STRING", digits).otherwise(said.try_cast("double").try_cast("int"))

    return F.filter(F.transform(items, whole), lambda y: y.isNotNull())
