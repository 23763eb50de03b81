"""Column functions for text: white space, letters and case of any script, where \\s and \\w of the engine's patterns know ASCII alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of character classes: white space, and letters, digits and the underscore.
SPACE, WORD = r"\s\x0B\x1C-\x1F\x85\p{Z}", r"\p{L}\p{N}_"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(text: Column) -> Column:
    """Single spaces for white space of any kind, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def spoken(text: Column) -> Column:
    """Folded case, a space for each mark, single spaces."""
    return squeeze(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), f"[^{WORD}{SPACE}]", " "))


def once(rows: DataFrame) -> DataFrame:
    """The same rows with each column worked out once: filters and expressions above are not written out again in terms of what stands below the generator."""
    return rows.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))


def spread(rows: DataFrame) -> DataFrame:
    """The same rows over all cores: a small file of short rows is a task or two, however long the work on each row is."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, 1))
