"""What the corpus operators share: word rules, tables in between, row keys."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.tables import cut, discard, scratch, shared_dir  # noqa: F401  for the operators

#: ASCII white space; everything else belongs to a word.
GAP = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Maps the bytes A-Z to a-z and leaves every other byte.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_file_order(df: DataFrame) -> list[Column]:
    """Columns that sort the rows of a table just as they were written, none where df isn't read from files."""
    order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        df.select(*order).schema  # noqa: B018  fails where there are no files
    except AnalysisException:
        return []
    return order


def spaced(text: Column) -> Column:
    """The words of a text joined by one space; null and blank texts give the empty string."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " "), F.lit(" "))


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null. Counts the blanks between words, which is cheaper
    than building the array of words."""
    flat = spaced(text)
    return F.when(flat == "", F.lit(0)).otherwise(
        F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1
    ).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))
