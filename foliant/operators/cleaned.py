"""Documents through the whole cleaner, hard or gently by a flag of each: DataFrame -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.cleaning import sanitize
from foliant.functions.tables import flatten
from foliant.functions.text import normalize_markdown


def cleaned(text: Column, hard: Column, flat: bool = True) -> Column:
    """A text normalized, cleaned (hard where the flag says so) and without tables that are none, inside its row."""
    done = sanitize(normalize_markdown(text), F.coalesce(hard, F.lit(False)))
    return flatten(done) if flat else done


def sanitized(docs: DataFrame, key: str, text: str, hard: str, flatten: bool = True) -> DataFrame:
    """key, markdown: the texts through `cleaned`."""
    return docs.select(key, cleaned(F.col(text), F.col(hard), flatten).alias("markdown"))
