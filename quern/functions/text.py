"""Text functions: tokens, sections, filters.  All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \b knows letters beyond ASCII; a word boundary here is one between ASCII word characters and the rest.
ASCII_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
WORD = ASCII_BOUNDARY + r"[a-z']+" + ASCII_BOUNDARY

SECTION_WEIGHTS = (0.34, 0.528, 0.132)  # title, first section, rest


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters and inner apostrophes; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def fields(text: Column) -> Column:
    """Pieces between runs of white space, case and punctuation kept."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def sections(text: Column, delimiter: str = "\n\n") -> Column:
    """(intro, rest): up to the first delimiter, and what follows with delimiters as blanks."""
    parts = F.split(text, delimiter, -1)
    return F.struct(F.element_at(parts, 1).alias("intro"), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " ").alias("rest"))


def plain_title(title: Column) -> Column:
    """Whether a title has nothing but ASCII word characters and white space."""
    return ~title.rlike(r"[^\w\s]")


def leading_int(text: Column) -> Column:
    """The whole number that a text starts with, null if there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def attribute_links(html: Column) -> Column:
    """Targets of all href attributes in order, repeats kept."""
    return F.coalesce(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)), F.array().cast("array<string>"))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)
