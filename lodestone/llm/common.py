"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import broadcast_if_small, release, written

__all__ = ["broadcast_if_small", "fold", "fresh", "materialize", "release", "slices", "table", "whole", "WORD"]

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Narrow rows to a file.
FILE_ROWS = 100_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread, not a recomputation,
    and what was drawn or numbered stays as it is. If about how many narrow
    rows there will be is known, there are no more files than they need.
    """
    return written(df if rows is None else df.coalesce(2 + rows // FILE_ROWS), name)


def slices(batch: pa.RecordBatch, at: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, without copies, whose texts in column ``at`` have about ``size`` bytes.

    A text of more bytes is in a slice with what precedes it, so the memory for a slice follows
    from ``size`` and the longest text. Spark itself bounds the bytes of a batch.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        done = int(ends[first - 1]) if first else 0
        behind = max(first, int(np.searchsorted(ends, done + size))) + 1
        yield batch.slice(first, behind - first)
        first = behind


def whole(text: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as ''."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")
