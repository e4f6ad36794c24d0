"""Column expressions over whole texts that several operators use; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that part words: blank, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text without nulls."""
    return F.array_remove(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " "), "")


def with_word_hashes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: a 64-bit hash per word."""
    return df.withColumn(out, F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))


def shingle_hashes(word_hashes: str, size: int) -> Column:
    """64-bit hashes of the windows of `size` words, in order and with repeats. Fewer words: the whole
    sequence as one; no words: none."""
    h = F.col(word_hashes)
    window = lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(size)])
    return (
        F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(0), F.size(h) - size), window))
        .when(F.size(h) > 0, F.array(F.xxhash64(h)))
        .otherwise(F.array().cast("array<bigint>"))
    )
