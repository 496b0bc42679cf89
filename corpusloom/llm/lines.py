"""Line dedup by winnowing over line hashes.

Lines with a word are hashed.  Of every window of ``RUN`` consecutive ones the
smallest hash (the last one of equals) is a fingerprint, so two equal runs of
``RUN`` lines are sure to share a fingerprint at the same place.  Fingerprints
that stand once in the corpus are dropped.  Each other position is joined with
the first position whose lines match around the fingerprint, over a window that
chose it, and the match is extended both ways for as long as the two positions
go on alike.  The first run stays and the later ones are deleted.

On request (``passages``) single lines and pairs of lines take part as well, in
documents of any number of lines: those of many words wherever they repeat,
and shorter lines that stand in many documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, join_few, slices

RUN = 3
LONG_WORDS = 50  # a line, or two lines together, with as many words is a passage by itself
FREQUENT_DOCS = 10  # a shorter line goes if it stands in as many documents
FREQUENT_WORDS = 4  # and has as many words; shorter ones are marks and headings


def hashed_lines(text: Column) -> Column:
    """Number and hash of each ``\\n``-split line that has a word."""
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    return F.transform(F.filter(numbered, lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]")), lambda s: F.struct(s["line"].alias("line"), F.xxhash64(s["x"]).alias("h")))


def repeated_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Runs of lines to delete: doc_id, text_hash, start, n_lines, first_doc, first_start and ``numbers``.

    ``start`` and ``first_start`` count lines with a word; ``numbers`` are the
    run's lines in the text.  A line can lie in several runs, each with another
    first place.  Lines are equal if their 64-bit hashes are, and a run has
    ``run`` of them at least.  ``docs`` has doc_id, text_hash and text.  Rows
    without doc_id or text take no part.
    """
    source = docs.where("doc_id is not null and text is not null").select("doc_id", "text_hash", hashed_lines(F.col("text")).alias("lines"))
    source = source.where(F.size("lines") >= run).select("doc_id", "text_hash", F.col("lines.h").alias("h"), F.col("lines.line").alias("numbers"))

    def last_smallest(w: Column) -> Column:
        """Place in a window of its smallest hash, the last one of equals."""
        return (F.lit(run) - F.array_position(F.reverse(w), F.array_min(w))).cast("int")

    def context(pos: Column) -> Column:
        """A fingerprint with the lines that any window over it can reach."""
        begin = F.greatest(pos - run + 1, F.lit(0))
        reach = lambda c: F.slice(F.col(c), begin + 1, pos - begin + run)
        return F.struct(F.element_at(F.col("h"), pos + 1).alias("value"), (pos - begin).alias("at"), begin.alias("from"), reach("h").alias("h"), reach("numbers").alias("numbers"))

    starts = F.sequence(F.lit(0), F.size("h") - run)
    chosen = F.array_distinct(F.transform(starts, lambda i: i + last_smallest(F.slice(F.col("h"), i + 1, run))))
    places = source.select("doc_id", "text_hash", F.explode(F.transform(chosen, context)).alias("c")).select("doc_id", "text_hash", "c.*")
    shared = cut(places.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "line-fingerprints")
    met = join_few(places, shared, ["value"], ["doc_id", "from"])

    around = F.transform(F.sequence(F.lit(0), F.size("h") - run), lambda i: F.struct(i.alias("start"), F.slice(F.col("h"), i + 1, run).alias("w")))
    own = F.filter(around, lambda s: last_smallest(s["w"]) + s["start"] == F.col("at"))
    windows = met.select("doc_id", "text_hash", "from", "numbers", F.explode(own).alias("m")).select(
        "doc_id", "text_hash", (F.col("from") + F.col("m.start")).alias("start"), F.col("m.w").alias("w"), F.slice("numbers", F.col("m.start") + 1, run).alias("numbers")
    )
    windows = cut(windows, "line-windows")
    first = cut(windows.groupBy("w").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-first-windows")
    later = join_few(windows, first, ["w"], ["doc_id", "start"]).where(F.struct("doc_id", "start") > F.col("first"))

    pairs = later.select("doc_id", "text_hash", "start", "numbers", F.col("first.doc_id").alias("first_doc"), (F.col("start") - F.col("first.start")).alias("apart"))
    side_by_side = Window.partitionBy("doc_id", "text_hash", "first_doc", "apart").orderBy("start")
    runs = pairs.withColumn("island", F.col("start") - F.dense_rank().over(side_by_side)).groupBy("doc_id", "text_hash", "first_doc", "apart", "island")
    found = runs.agg(F.min("start").alias("start"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("numbers"))
    return found.select("doc_id", "text_hash", "start", F.size("numbers").alias("n_lines"), "first_doc", (F.col("start") - F.col("apart")).alias("first_start"), "numbers")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and line of the later places of single lines and pairs of lines that are passages or frequent.

    Lines are equal if two 64-bit hashes of theirs are, and their numbers of words.
    """
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("x"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")))
    hashed = F.transform(
        F.filter(numbered, lambda s: s["words"] > 0), lambda s: F.struct(s["line"].alias("line"), F.xxhash64(s["x"]).alias("h"), F.xxhash64(F.lit(1), s["x"]).alias("g"), s["words"].alias("words"))
    )
    source = docs.where("doc_id is not null and text is not null").select("doc_id", "text_hash", hashed.alias("lines"))

    def unit(a: Column, b: Column | None = None) -> Column:
        both = [a] if b is None else [a, b]
        h, g = (a[k] if b is None else F.xxhash64(a[k], b[k], F.lit(k)) for k in ("h", "g"))
        words = a["words"] if b is None else a["words"] + b["words"]
        return F.struct(h.alias("h"), g.alias("g"), words.alias("words"), F.lit(len(both)).alias("size"), F.array(*[x["line"] for x in both]).alias("numbers"))

    one = F.filter(F.transform("lines", lambda a: unit(a)), lambda u: u["words"] >= FREQUENT_WORDS)
    two = F.filter(F.zip_with(F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0))), F.slice("lines", 2, F.size("lines")), lambda a, b: unit(a, b)), lambda u: u["words"] >= LONG_WORDS)
    units = source.select("doc_id", "text_hash", F.explode(F.concat(one, two)).alias("u")).select("doc_id", "text_hash", "u.*").withColumn("start", F.col("numbers")[0])
    key = ["h", "g", "words", "size"]
    in_doc = units.groupBy(*key, "doc_id").agg(F.min("start").alias("start"), F.count("*").alias("n"))
    shared = in_doc.groupBy(*key).agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("docs"), F.sum("n").alias("n"))
    shared = cut(shared.where((F.col("n") > 1) & ((F.col("words") >= LONG_WORDS) | (F.col("docs") >= FREQUENT_DOCS))).drop("docs"), "line-passages")
    later = join_few(units, shared, key, ["doc_id", "start"]).where(F.struct("doc_id", "start") > F.col("first"))
    return later.select("doc_id", "text_hash", F.explode("numbers").alias("line"))


def dedup(docs: DataFrame, text: str = "text", id_column: str = "doc_id", run: int | None = RUN, passages: bool = False) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text``, then n_lines and n_removed.

    A line with a word is deleted if a window of ``run`` such lines covers it
    whose lines, in order, also stand at an earlier place: in a smaller doc_id,
    or further up in the same one.  With ``passages`` so are later places of a
    line or two neighbouring lines of ``LONG_WORDS`` words in all, and of a line of
    ``FREQUENT_WORDS`` words in ``FREQUENT_DOCS`` documents; without ``run`` only
    those.  All is judged on the input.  Lines
    without a word count as no line and stay.  Null texts stay null with no
    lines.  Rows without doc_id are left alone; equal rows, which have equal
    places, get equal results.  Other columns pass through, whatever their
    names; n_lines and n_removed are the last two.
    """
    n = len(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(n)])
    doc, body = (F.col(f"c{docs.columns.index(x)}") for x in (id_column, text))
    keyed = plain.select("*", doc.cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    found = ([repeated_runs(keyed, run).select("doc_id", "text_hash", F.explode("numbers").alias("line"))] if run else []) + ([repeated_passages(keyed)] if passages else [])
    gone = reduce(DataFrame.union, found).groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("gone"))
    joined = keyed.join(gone, ["doc_id", "text_hash"], "left").select(*plain.columns, "gone")
    at = docs.columns.index(text)

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            texts, n_lines, n_removed = batch.column(at).to_pylist(), [], []
            for i, (value, cuts) in enumerate(zip(texts, batch.column(n), strict=True)):
                lines = [] if value is None else value.split("\n")
                n_lines.append(sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in lines))
                if cuts.is_valid:
                    keep = np.ones(len(lines), bool)
                    keep[cuts.values.to_numpy()] = False
                    texts[i] = "\n".join([lines[k] for k in np.flatnonzero(keep).tolist()])
                n_removed.append(len(cuts.values) if cuts.is_valid else 0)
            columns = [pa.array(texts, pa.string()) if k == at else x for k, x in enumerate(batch.columns[:n])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*[f"c{k}" for k in range(n)], "n_lines", "n_removed"])

    fields = plain.schema.add("n_lines", "long").add("n_removed", "long")
    return joined.mapInArrow(leave, fields).toDF(*docs.columns, "n_lines", "n_removed")
