"""Code sequences of documents: strings, prefixes, tokens and packed bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_string(codes: Column, length: int | None = None, skip: int = 0) -> Column:
    """``c0_c1_...`` of the codes behind ``skip`` start tokens."""
    size = F.size(codes) - skip if length is None else F.lit(length)
    return F.array_join(F.slice(codes, F.lit(skip + 1), F.greatest(size, F.lit(0))).cast("array<string>"), "_")


def from_string(text: Column) -> Column:
    return F.transform(F.split(text, "_"), lambda x: x.cast("int"))


def append_last(prefix: Column, last: Column) -> Column:
    return F.concat(prefix, F.array(last))


def prefix(codes: Column, length: int) -> Column:
    """The first ``length`` codes, or all of fewer."""
    return F.slice(codes, 1, length)


def edges(codes: Column) -> Column:
    """Array of (prefix, next) for each position of the codes."""
    steps = F.sequence(F.lit(0), F.size(codes) - 1)
    return F.when(F.size(codes) > 0, F.transform(steps, lambda i: F.struct(F.slice(codes, F.lit(1), i).alias("prefix"), F.get(codes, i).alias("next")))).otherwise(F.array())


def shift_right(codes: Column, pad: int = 0) -> Column:
    """Decoder input: a pad, then all codes but the last."""
    return F.concat(F.array(F.lit(pad)), F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))))


def token_of(position: Column, code: Column, size: int, base: int = 32000) -> Column:
    return (F.lit(base) + position * size + code).cast("int")


def position_of(token: Column, size: int, base: int = 32000) -> Column:
    return F.floor((token - base) / size).cast("int")


def code_of(token: Column, size: int, base: int = 32000) -> Column:
    return F.pmod(token - base, F.lit(size)).cast("int")


def token_grid(spark: SparkSession, positions: int, size: int) -> DataFrame:
    """All ``<docid_i_j>`` tokens; a plan constant of positions times size rows."""
    grid = spark.range(positions * size)
    i, j = F.floor(F.col("id") / size).cast("int"), (F.col("id") % size).cast("int")
    return grid.select(i.alias("position"), j.alias("code"), F.format_string("<docid_%d_%d>", i, j).alias("token"))


def unpack_bits(word: Column, count: int, bits: int) -> Column:
    """``count`` codes of ``bits`` bits, the first in the lowest bits; 63 bits in all."""
    mask = (1 << bits) - 1
    return F.array(*(F.shiftright(word, m * bits).bitwiseAND(F.lit(mask)).cast("int") for m in range(count)))


def pack_bits(codes: Column, bits: int) -> Column:
    return F.aggregate(F.reverse(codes), F.lit(0).cast("long"), lambda a, x: a * (1 << bits) + x)


def valid_codes(codes: Column, lengths: tuple[int, ...] = (4, 8, 16, 32), least: int = 0) -> Column:
    """Whether the length is allowed, the first code is no start token and all are at least ``least``."""
    first = F.get(codes, F.lit(0))
    return F.size(codes).isin(*lengths) & ~first.isin(-1) & F.forall(codes, lambda c: c >= least)


def split_equal(position: Column, total: Column, parts: int) -> Column:
    """Contiguous parts of floor(total / parts); the last takes the remainder. Fewer rows than parts are an error."""
    total = F.when(total >= parts, total).otherwise(F.raise_error(F.lit("fewer rows than parts")).cast("bigint"))
    return F.least(F.floor(position / F.floor(total / parts)), F.lit(parts - 1)).cast("int")
