"""Small text expressions: header clean-up, sentinel handling, yes/no flags, joined flag labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings read as missing, and strings read as 1.
MISSING_WORDS = ("NULL", "NA", "None")
TRUE_WORDS = ("Yes", "Male")


def sanitize_header(name: str) -> str:
    """Trim a header and turn inner spaces into underscores."""
    return name.strip().replace(" ", "_")


def sentinel_to_null(c: Column, words: Sequence[str] = MISSING_WORDS) -> Column:
    return F.when(~c.isin(*words), c)


def yes_no_flag(c: Column, true_words: Sequence[str] = TRUE_WORDS) -> Column:
    """1 for a true word, else 0; null gives 0."""
    return F.when(c.isin(*true_words), F.lit(1)).otherwise(F.lit(0))


def joined_flags(labels: Mapping[str, str], separator: str = " + ") -> Column:
    """Labels of the set 0/1 columns, sorted and joined; an empty string when none is set."""
    marks = F.array(*[F.when(F.col(c) == 1, F.lit(text)) for c, text in labels.items()])
    return F.array_join(F.array_sort(F.array_compact(marks)), separator)
