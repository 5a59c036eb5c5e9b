"""Bounded samples of labelled rows, for fitting."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod))


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """True for rows that no fit may see; a null id is never held out, and never in a fit either."""
    return F.coalesce(bucket(id_col, mod) == rest, F.lit(False))


def sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """Up to ``most`` rows, first by a hash of the id: the same rows whatever the partitions."""
    return rows.orderBy(F.xxhash64(id_col), id_col).limit(most)
