"""Chunkers.  Each is a fold over one text's sentences, lines or windows, so a row becomes rows in one Arrow pass."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from corpusloom.config import DEFAULT
from corpusloom.functions.text import heading_level, strip

_SENTENCE = re.compile(r"[^。.]*[。.]|[^。.]+")


def _tail(chunk: str, overlap: int) -> str:
    """What the next chunk repeats; no overlap, like one longer than the chunk, repeats all of it."""
    return chunk[-overlap:] if 0 < overlap < len(chunk) else chunk


def _packed(paragraph: str, size: int, overlap: int) -> Iterator[tuple[str, int]]:
    """Chunks of a long paragraph as they are put together, and where each begins in it."""
    current, begin = "", 0
    for sentence in filter(None, (m[0].strip() for m in _SENTENCE.finditer(paragraph))):
        if current and len(current) + len(sentence) + 1 > size:
            yield current, begin
            tail = _tail(current, overlap)
            begin = max(0, paragraph.find(tail, max(0, paragraph.find(current))))
            current = f"{tail} {sentence}"
        elif current:
            current = f"{current} {sentence}"
        else:
            current, begin = sentence, max(0, paragraph.find(sentence))
    if current:
        yield current, begin


def placed_by_paragraphs(text: str, size: int = DEFAULT.chunking.size, overlap: int = DEFAULT.chunking.overlap) -> Iterator[tuple[str, int, int]]:
    """Chunks of whole sentences of about ``size`` characters, with their first place in the text and the place after the last.

    A longer sentence is a chunk by itself.  A chunk that is put together of
    sentences without the white space between them ends where it would if that were one space each.
    """
    at = 0
    for part in (text or "").split("\n\n"):
        if paragraph := part.strip():
            start = at + part.index(paragraph)
            for chunk, begin in [(paragraph, 0)] if len(paragraph) <= size else _packed(paragraph, size, overlap):
                if chunk.strip():
                    yield chunk.strip(), start + begin, start + begin + len(chunk)
        at += len(part) + 2


def pack_sentences(paragraph: str, size: int, overlap: int) -> Iterator[str]:
    """Chunks of one paragraph."""
    if len(paragraph) <= size:
        yield paragraph
    else:
        yield from filter(None, (chunk.strip() for chunk, _ in _packed(paragraph, size, overlap)))


def by_paragraphs(text: str, size: int = DEFAULT.chunking.size, overlap: int = DEFAULT.chunking.overlap) -> Iterator[str]:
    return (chunk for chunk, _, _ in placed_by_paragraphs(text, size, overlap))


def by_table_rows(markdown: str, size: int = DEFAULT.chunking.size) -> Iterator[str]:
    """A table of up to twice ``size`` stays whole; a longer one is cut between rows."""
    if len(markdown) <= 2 * size:
        yield markdown
        return
    rows: list[str] = []
    used = 0
    for row in markdown.split("\n"):
        if rows and used + len(row) + 1 > size:
            yield "\n".join(rows)
            rows, used = [], 0
        rows.append(row)
        used += len(row) + 1
    if rows:
        yield "\n".join(rows)


def _after_sentence(text: str, low: int, high: int) -> int:
    """The place after the last sentence that ends in [low, high), else ``low``."""
    return max((text.rfind(c, low, high) for c in "。！？.!?\n"), default=-1) + 1 or low


def by_window(text: str, size: int = DEFAULT.chunking.window_size, overlap: int = DEFAULT.chunking.window_overlap) -> Iterator[str]:
    """Windows that end after a sentence in their last quarter, or at three quarters where none ends there.

    The next one starts after a sentence too, up to twice ``overlap`` before the last one's end.
    """
    text, begin = text or "", 0
    while begin < len(text):
        end = begin + size
        end = len(text) if end >= len(text) else max(_after_sentence(text, end - size // 4, end), begin + 1)
        if piece := text[begin:end].strip():
            yield piece
        if end >= len(text):
            return
        back = end - overlap
        begin = max(begin + 1, _after_sentence(text, max(0, back - overlap), back)) if back > begin else end


def explode_chunks(df: DataFrame, split: Callable[..., Iterator], text: str = "text", keep: tuple[str, ...] = ("doc_id",), placed: bool = False, **options: int) -> DataFrame:
    """``keep`` columns with piece (from 1) and content for each chunk of ``text``; a null or blank text has none.

    With ``placed``, ``split`` gives places too: start and end, which follow the content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, pieces = [], [], []
            for i, value in enumerate(batch.column(len(keep))):
                for n, piece in enumerate(split(value.as_py() or "", **options), 1):
                    rows.append(i)
                    numbers.append(n)
                    pieces.append(piece if placed else (piece,))
            index = pa.array(rows, pa.int64())
            kept = [batch.column(k).take(index) for k in range(len(keep))]
            made = [pa.array([x[c] for x in pieces], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int32())[: 3 if placed else 1])]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int32()), *made], [*keep, "piece", *names])

    names = ["content", "start", "end"] if placed else ["content"]
    source = df.select(*keep, F.col(text).alias("_text"))
    schema = source.drop("_text").schema.add("piece", IntegerType()).add("content", StringType())
    if placed:
        schema = schema.add("start", IntegerType()).add("end", IntegerType())
    return source.mapInArrow(run, schema)


def chunk_elements(elements: DataFrame, size: int = DEFAULT.chunking.size, overlap: int = DEFAULT.chunking.overlap) -> DataFrame:
    """Chunks of mixed elements (doc_id, page_no, elem_no, kind, content): text by sentences, tables by rows; chunk_no counts a document's."""
    keep = ("doc_id", "page_no", "elem_no", "kind")
    text = explode_chunks(elements.where("kind <> 'table'"), by_paragraphs, "content", keep, size=size, overlap=overlap)
    tables = explode_chunks(elements.where("kind = 'table'"), by_table_rows, "content", keep, size=size)
    return number_chunks(text.unionByName(tables))


def number_chunks(pieces: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(*[c for c in ("page_no", "elem_no", "piece") if c in pieces.columns])
    return pieces.withColumn("chunk_no", F.row_number().over(order))


def section_outline(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, section_no, level, title, content: each numbered heading with the lines below it; lines before the first one are left out.

    Done in a row's own arrays, so a document's lines are never shuffled.
    """
    placed = F.transform(F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != ""), lambda x: F.struct(x.alias("line"), heading_level(x).alias("level")))
    numbered = docs.select(key, placed.alias("all")).where(F.exists("all", lambda s: s["level"] > 0))
    heads = F.filter(F.transform("all", lambda s, i: F.struct(i.alias("at"), s["level"].alias("level"), s["line"].alias("title"))), lambda s: s["level"] > 0)
    sections = numbered.select(key, "all", heads.alias("heads")).select(key, "all", "heads", F.posexplode("heads").alias("n", "h"))
    end = F.coalesce(F.get("heads", F.col("n") + 1)["at"], F.size("all"))
    body = F.transform(F.slice("all", F.col("h.at") + 2, end - F.col("h.at") - 1), lambda s: F.concat(s["line"], F.lit("\n")))
    return sections.select(key, (F.col("n") + 1).alias("section_no"), "h.level", "h.title", F.array_join(body, "").alias("content"))
