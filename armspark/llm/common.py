"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

# The contract's white space, and the letters that lower-casing touches.
SPACE = r"\x20\x09-\x0D"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; a NULL key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text (NULL: empty). Python's ``bytes.lower`` and ``bytes.split`` touch exactly
    A-Z and the six ASCII spaces of the contract, and need no decoding."""
    return whole_text(column).cast("binary").alias(column)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as keep it apart from the columns of a table (names there differ by more than case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def row_key(df: DataFrame, name: str) -> DataFrame:
    """A key unique per row of one scan: rows whose own ids repeat or are NULL stay apart."""
    return df.withColumn(name, F.monotonically_increasing_id())


def hash_sample(df: DataFrame, key: Column, size: int) -> DataFrame:
    """About ``size`` rows by a hash of their key (all, if fewer): one filter, no row is sent anywhere to be ranked."""
    total = df.count()
    if total <= size:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * size / total))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, held_out: int, sample: int, name: str) -> DataFrame:
    """(label, text) of about ``sample`` labelled rows outside a fold, stored.

    The ids of the labels are sampled first, so that a bounded broadcast finds their rows and no text is shuffled for it. Then the
    distinct rows are sampled once more: an id that many rows repeat brings no more than the bound
    either, and copies of a text weigh once.
    """
    usable = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != held_out)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("long").alias("label")
    )
    chosen = materialize(hash_sample(usable.distinct(), F.struct("doc_id", "label"), sample), f"{name}-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = materialize(texts.join(F.broadcast(chosen), "doc_id").select("label", "text").distinct(), f"{name}-found")
    return hash_sample(found, F.struct("label", "text"), sample)
