"""Column expressions that clean, type and tokenise text."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
# Digits are those of any script, full-width ones included.
HEADER_FOOTER = (r"第\s*\p{Nd}+\s*页\s*共\s*\p{Nd}+\s*页", r"Page\s+\p{Nd}+\s+of\s+\p{Nd}+", r"\p{Nd}{4}\s*年\s*\p{Nd}{1,2}\s*月\s*\p{Nd}{1,2}\s*日")
NUMBERING = (r"^第[一二三四五六七八九十\p{Nd}]+[章节部分]", r"^[一二三四五六七八九十]+、", r"^\p{Nd}+[.、]", r"^[（(]\p{Nd}+[）)]")
SENTENCE_END = r"[。.；;]$"
TITLE_WORDS = ("报告", "公告", "说明", "摘要", "目录", "概述", "总结")
DOCUMENT_TITLE_WORDS = ("报告", "公告", "说明", "摘要", "目录")
TOKEN = r"[一-龥]+|[a-zA-Z]+|\p{Nd}+"

_SPACE = r"[\s\x{3000}\x{A0}\x{85}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}]"


#: The decimal digits of all scripts but ASCII.
DIGITS = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")


def ascii_digits(c: Column) -> Column:
    """Decimal digits of any script as those of ASCII."""
    return F.translate(c, DIGITS, "".join(str(unicodedata.digit(d)) for d in DIGITS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end, the ideographic space included."""
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


def any_of(c: Column, found: tuple[str, ...]) -> Column:
    return F.array_contains(F.transform(F.array(*[F.lit(x) for x in found]), lambda w: F.contains(c, w)), True)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def is_page_noise(line: Column) -> Column:
    """A page number, a page label, or a short run of digits and separators."""

    def judged(s: Column) -> Column:
        return s.rlike(r"^\p{Nd}{1,5}$") | s.rlike(r"(?i)^(第\s*\p{Nd}+\s*页|Page\s*\p{Nd}+)$") | ((F.length(s) <= 10) & s.rlike(r"^[\p{Nd}\s./\-]+$"))

    return let(strip(line), judged)


def drop_page_noise(text: Column) -> Column:
    return F.when(strip(text) == "", text).otherwise(F.array_join(F.filter(lines(text), lambda x: ~is_page_noise(x)), "\n"))


def is_header_footer(line: Column, repeated: Column | None = None) -> Column:
    """``repeated``: the raw lines that stand at least three times in the element."""

    def judged(s: Column) -> Column:
        fixed = s.rlike("|".join(HEADER_FOOTER)) | (s.rlike(r"^\p{Nd}+$") & (F.length(s) < 5)) | s.rlike(r"^\p{Nd}{4}[-/]\p{Nd}{1,2}[-/]\p{Nd}{1,2}$")
        return (s != "") & (fixed if repeated is None else F.array_contains(repeated, s) | fixed)

    return let(strip(line), judged)


def repeated_lines(text: Column, threshold: int = 3) -> Column:
    """Raw lines that stand ``threshold`` times or more in the text and aren't blank, without a quadratic search.

    In the sorted lines, one that equals the line ``threshold - 1`` places on stands that often.
    """

    def found(ordered: Column) -> Column:
        return F.array_distinct(F.filter(ordered, lambda x, i: (F.get(ordered, i + (threshold - 1)) == x) & (strip(x) != "")))

    return let(F.array_sort(lines(text)), found)


def clean_text(text: Column, keep_blank: bool = True) -> Column:
    """Without headers and footers; at most one blank line in a row; stripped.

    Split and repeated lines are bound once for each text, as the value of a
    lambda, rather than worked out again for each line.
    """

    def kept(t: Column) -> Column:
        return F.filter(t["lines"], lambda x: ~is_header_footer(x, t["repeated"]) & (F.lit(keep_blank) | (strip(x) != "")))

    left = let(F.struct(lines(text).alias("lines"), repeated_lines(text).alias("repeated")), kept)
    return strip(F.regexp_replace(F.array_join(left, "\n"), r"\n{3,}", "\n\n"))


def is_numbered(line: Column) -> Column:
    return line.rlike("|".join(NUMBERING))


def is_title_line(line: Column) -> Column:
    s = strip(line)
    worded = F.length(s).between(5, 100) & ~s.rlike(SENTENCE_END) & any_of(s, TITLE_WORDS)
    return (s != "") & (is_numbered(s) | worded)


def heading_level(line: Column) -> Column:
    """1 to 4 by kind of numbering, 0 for a body line."""
    out = F.lit(0)
    for level in (4, 3, 2, 1):
        out = F.when(line.rlike(NUMBERING[level - 1]), level).otherwise(out)
    return out


def paragraphs(text: Column) -> Column:
    """Stripped paragraphs that aren't empty."""
    return F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda p: p != "")


def element_type(paragraph: Column) -> Column:
    """Title or NarrativeText."""
    split = lines(paragraph)
    first = F.element_at(split, 1)
    fits = (F.length(first) < 100) & ~first.rlike(SENTENCE_END)
    return F.when(fits & (is_numbered(first) | ((F.length(first) < 50) & (F.size(split) == 1))), "Title").otherwise("NarrativeText")


def document_title(text: Column) -> Column:
    """The first of ten lines that is under 200 characters with a title word, or one of the first three with 11 to 99 characters."""

    def first_good(top: Column) -> Column:
        def good(x: Column) -> Column:
            worded = (F.length(x) < 200) & any_of(x, DOCUMENT_TITLE_WORDS)
            return (x != "") & (worded | ((F.array_position(top, x) <= 3) & (F.length(x) > 10) & (F.length(x) < 100)))

        return F.get(F.filter(top, good), F.lit(0))

    return let(F.transform(F.slice(lines(strip(text)), 1, 10), strip), first_good)


def tokens(text: Column) -> Column:
    """Keyword-search tokens: runs of ideographs, of letters or of digits, of two characters or more; case is kept."""
    return F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) > 1)


def years(text: Column) -> Column:
    """Distinct four-digit years of 1900 to 2099, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?:19|20)[0-9]{2}"), F.lit(0)), lambda y: y.cast("int")))


def preview(text: Column, length: int = 200) -> Column:
    return F.substring(text, 1, length)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)
