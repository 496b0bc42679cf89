"""A mix of sources by weight, as weighted fair queueing orders it.

Each source queues its documents, shuffled, as often as it may repeat them.  A
document's virtual finish time is how many tokens its source has sent when it
has been sent, divided by the source's target.  All copies are sorted by that
time, which mixes the sources evenly at every point, and the mix ends when its
running tokens reach the budget.  As the targets share the budget, it runs out
for all sources at virtual time 1: the copy that a source sends then is cut there.

Only DataFrame functions are used.  Running sums are taken within slots, ranges
of shuffle keys or of virtual time that are even by construction, and the sums
of whole slots come on top; so no task has a whole source or the whole mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, numbered, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
HASHED = 1 << 16  # different values of the part of the shuffle key that names a slot


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, budget: int, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``sources`` (key, source_size) with target: shares of the budget by weight, at most ``repeats`` times the size.

    Sources in the order of key weigh ``weights`` in turn.  What a source can't
    take is shared among the others until none is above its limit; that the
    tokens for a weight of one only rise makes it a loop over one number.
    """
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    weighed = cut(numbered(sources, ["key"], "mix-sources").withColumns({"weight": weight, "most": repeats * F.col("source_size")}), "mix-weights")
    unit, known = 0.0, -1
    while True:
        full = F.col("most") <= unit * F.col("weight") if known >= 0 else F.lit(False)
        row = weighed.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("most"))).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if row["n"] == known or not row["weight"]:
            break
        unit, known = (budget - (row["taken"] or 0)) / row["weight"], row["n"]
    return weighed.select("key", "source_size", F.least(F.col("most").cast("double"), unit * F.col("weight")).alias("target"))


def queue(docs: DataFrame, budget: int | None = None, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, text: str = "text", id_column: str = "doc_id", source: str = "source") -> tuple[DataFrame, int]:
    """The documents as their sources queue them, and the budget: all tokens, if none is given.

    A row each: row (a number), doc_id, source, size, source_size, target, shuffle (what orders a source) and
    before, the tokens of the source's documents before it.  A null text has no tokens.
    """
    spark = docs.sparkSession
    slots = min(HASHED, 4 * shuffle_partitions(spark))
    mixed = F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))))
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(">"))  # sorts as the sources do, null last
    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), key.alias("key"), word_count(F.col(text)).alias("size"), mixed.alias("shuffle"))
    slot = F.floor(F.conv(F.substring("shuffle", 1, 4), 16, 10).cast("long") * slots / HASHED)
    sized = cut(plain.withColumns({"slot": slot, "row": F.monotonically_increasing_id()}), "mix-sizes")
    by_slot = cut(sized.groupBy("key", "slot").agg(F.sum("size").alias("slot_size")), "mix-slots")
    sources = by_slot.groupBy("key").agg(F.sum("slot_size").alias("source_size"))
    total = by_slot.agg(F.sum("slot_size")).first()[0] or 0
    budget = total if budget is None else budget
    earlier = F.sum("slot_size").over(Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_slot.select("key", "slot", F.coalesce(earlier, F.lit(0)).alias("start")).join(targets(sources, budget, weights, repeats), "key")
    in_slot = F.sum("size").over(Window.partitionBy("key", "slot").orderBy("shuffle", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1))
    queued = sized.withColumn("in_slot", F.coalesce(in_slot, F.lit(0))).join(starts, ["key", "slot"])
    columns = ["row", "doc_id", "source", "key", "size", "source_size", "target", "shuffle"]
    return cut(queued.select(*columns, (F.col("start") + F.col("in_slot")).alias("before")), "mix-queue"), budget


def stream(queued: DataFrame, budget: int, repeats: int = REPEATS) -> DataFrame:
    """The mix in parts: row, doc_id, source, copy (from 0), words, finish and position, the words of the mix before it.

    ``words`` is the whole document, or what the budget leaves of it; copies that
    get none aren't in it.  Rows are range-partitioned by virtual time and sorted by it.
    """
    slots = 4 * shuffle_partitions(queued.sparkSession)
    copies = queued.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy"))
    sent = copies.withColumn("sent", F.col("before") + F.col("copy") * F.col("source_size"))
    sent = sent.withColumn("words", F.least(F.col("size"), F.floor("target") - F.col("sent"))).where("words > 0")
    timed = sent.withColumn("finish", (F.col("sent") + F.col("words")) / F.col("target"))
    timed = cut(timed.withColumn("tick", F.least(F.floor(F.col("finish") * slots), F.lit(slots - 1))), "mix-copies")
    ticks = timed.groupBy("tick").agg(F.sum("words").alias("n"))  # a row for each slot of time
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = Window.partitionBy("tick").orderBy("finish", "key", "shuffle", "doc_id", "size", "row", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = timed.repartitionByRange("tick").withColumn("position", F.coalesce(F.sum("words").over(ordered), F.lit(0)))
    placed = placed.join(F.broadcast(ticks.select("tick", earlier.alias("earlier"))), "tick").withColumn("position", F.col("position") + F.col("earlier"))
    kept = placed.where(F.col("position") < budget).withColumn("words", F.least(F.col("words"), F.lit(budget) - F.col("position")))
    return kept.select("row", "doc_id", "source", "copy", "words", "finish", "position")


def mix(docs: DataFrame, budget: int | None = None, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, text: str = "text", id_column: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes of a document, for every row.

    Sizes count words, 0 for a null or empty text, of which nothing is taken.
    Sources ascend by code point, null last, and weigh ``weights`` in turn; a target
    is a source's share of ``budget``, by default the words of all documents, and at
    most ``repeats`` times what the source has, the rest being shared by the
    others.  A source's words are its target, rounded down.  The order within a source is that of a hash of id
    and text, so reruns agree; rows with an equal id and text take turns, and
    each is a row of its own.  Other columns, whatever their names, aren't looked at; an
    empty table gives no rows.
    """
    queued, limit = queue(docs, budget, weights, repeats, text, id_column, source)
    taken = stream(queued, limit, repeats).groupBy("row").agg(F.sum("words").alias("taken"))
    return queued.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
