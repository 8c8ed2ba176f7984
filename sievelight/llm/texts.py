"""What several text operators share: the definition of a word, and reading tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six (SQL form, Java and RE2 alike).
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: lower-cases A-Z and nothing else.
LOWER_BYTES = bytes(range(256)).lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_column(text: Column) -> Column:
    """The words of a text in order, as array<string>; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased, as UTF-8. bytes.split() cuts at exactly the six spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


def column_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
