"""Cutting eligibility prose into criteria and recovering the section of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.functions.binding import let

# Headings, inline headings and bullets as they occur in the registry (fixed values).
HEADING = r"(?iuU)^\s*(?:key\s+|main\s+|patient\s+|subject\s+)?(inclusion|exclusion)\s*(?:criteria)?\s*[:\-–]?\s*$"
INLINE = r"(?iuU)(?:key\s+|main\s+)?(inclusion|exclusion)\s+criteria\s*[:\-–]"
BULLET = r"(?iuU)^\s*(?:[-*•–]|\(?\d{1,2}[.)]|\(?[a-z][.)])\s+"
SHORTEST = 15
NO_SECTION = "UNKNOWN"

# Marks of sections and criteria while a text is cut. A line holds no line feed, so no line holds a mark.
_SECTION, _CRITERION = "\nS", "\nC"


def criteria(text: Column) -> Column:
    """Array of (criterion_section, chunk_text) in reading order.

    A heading line opens a section, a bullet opens a criterion and any other line
    continues the open criterion; criteria under 15 characters are dropped. Lines
    are marked, joined again and split at the marks, so a text is cut in one pass
    inside its own row, without a shuffle.
    """
    spread = F.regexp_replace(text, F.lit(INLINE), F.lit("\n$1 Criteria:\n"))
    lines = F.filter(F.split(spread, "\n", -1), lambda line: line.rlike(r"(?U)\S"))
    marked = F.transform(
        lines,
        lambda line: F.when(
            line.rlike(HEADING), F.concat(F.lit(_SECTION), F.upper(F.regexp_extract(line, HEADING, 1)), F.lit(_CRITERION))
        )
        .when(line.rlike(BULLET), F.concat(F.lit(_CRITERION), F.regexp_replace(line, F.lit(BULLET), F.lit(""))))
        .otherwise(F.concat(F.lit(" "), line)),
    )
    whole = F.concat(F.lit(NO_SECTION + _CRITERION), F.array_join(marked, ""))

    def cut(section: Column) -> Column:
        return let(F.split(section, _CRITERION, -1), criteria_of)

    def criteria_of(parts: Column) -> Column:
        texts = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " ")))
        kept = F.filter(texts, lambda t: F.length(t) >= SHORTEST)
        return F.transform(kept, lambda t: F.struct(parts[0].alias("criterion_section"), t.alias("chunk_text")))

    return F.coalesce(F.flatten(F.transform(F.split(whole, _SECTION, -1), cut)), F.array().cast("array<struct<criterion_section:string,chunk_text:string>>"))


def chunk_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per criterion, numbered from 0 within its document."""
    return df.select(key, F.posexplode(criteria(F.col(text))).alias("chunk_id", "c")).select(
        key, "chunk_id", F.col("c.criterion_section").alias("criterion_section"), F.col("c.chunk_text").alias("chunk_text")
    )
