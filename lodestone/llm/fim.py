"""Fill-in-the-middle by bit-parallelism over big integers.

A text is its UTF-8 bytes, and a set of places in it is one integer whose bit i
stands for byte i. ``bytes.translate`` turns a text into the digits of the masks
of its byte classes, shifted boolean operations on the masks mark where units
begin, ``bit_count`` gives their number, and the byte at which the unit of a rank
begins is found by halving the mask again and again. No unit is visited alone.

Two draws from a hash of the key cut the units into prefix, middle and suffix,
two more choose the form: ``psm`` and ``spm`` put the parts behind the marks
``<P>``, ``<S>`` and ``<M>``; ``plain`` is the text as it was. A text that holds
a mark stays plain, so the parts can be told apart and :func:`restore` gives the
exact text back.

A null text counts as empty and comes back as an empty one; an empty text is
plain and has no units. A null key is drawn for as an empty one. Rows that repeat
key and text are cut alike. An empty table gives no rows. Texts of any length are
cut whole; a mask takes a bit of memory for a byte of text, its digits a byte.
Bytes that are no UTF-8 are kept; those that no character begins with join the
unit before them or stand alone. Other columns, whatever their names, are
returned as they came.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices, table, whole

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20


def _digits(member: Callable[[int], bool]) -> bytes:
    """The table of ``bytes.translate`` from a byte to the digit 1 if it is in a class, else 0."""
    return bytes(49 if member(b) else 48 for b in range(256))


_LEADS = [_digits(lambda b, least=least: b >= least) for least in (0xC0, 0xE0, 0xF0)]
_DARK = _digits(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
_NEWLINE = _digits(lambda b: b == 0x0A)


def mask(backwards: bytes, digits: bytes) -> int:
    """The bytes of a class, from the text's bytes in reverse; bit i stands for byte i of the text."""
    return int(backwards.translate(digits), 2) if backwards else 0


def code_points(text: bytes) -> int:
    """Where code points begin: at bytes that no leading byte of two, three or four claims."""
    back = text[::-1]
    claimed = 0
    for k, digits in enumerate(_LEADS, 1):
        claimed |= mask(back, digits) << k
    return ((1 << len(text)) - 1) & ~claimed


def words(text: bytes) -> int:
    """Where words begin, each with the white space behind it; white space at the start is a unit."""
    dark = mask(text[::-1], _DARK)
    return (dark & ~(dark << 1)) | (1 if text else 0)


def lines(text: bytes) -> int:
    """Where lines begin, each with its newline."""
    return (mask(text[::-1], _NEWLINE) << 1 | 1) & ((1 << len(text)) - 1)


UNITS = {"code_points": code_points, "words": words, "lines": lines}


def select(bits: int, rank: int, width: int) -> int:
    """The place of the set bit with ``rank`` set bits below it; ``width`` if there is none."""
    if rank >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        ones = low.bit_count()
        if rank < ones:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - ones, at + half
    return at


def transform(text: bytes, key: str, seed: str, units: str, plain_percent: int, spm_percent: int) -> tuple[bytes, str, int, int | None, int | None]:
    """(output, form, units of the text, of its prefix, of its middle)."""
    begins = UNITS[units](text)
    n = begins.bit_count()
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= 100 - plain_percent:
        return text, "plain", n, None, None
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = select(begins, low, len(text)), select(begins, high, len(text))
    prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    if h[3] % 100 < spm_percent:
        return suffix + prefix + middle, "spm", n, low, high - low
    return prefix + suffix + middle, "psm", n, low, high - low


def fill_in_middle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "1",
    units: str = "code_points",
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """The rows of ``df`` with the text transformed, and a last column ``fim``: form, n, prefix, middle (units).

    If ``df`` has a column ``fim``, the new one gets a name with an underscore
    behind it. Each part of the scan is one task's; nothing is shuffled.
    """
    if units not in UNITS:
        raise ValueError(f"units are one of {', '.join(UNITS)}")
    others = [c for c in df.columns if c != text_col]
    # one column holds all others, so that any name will do
    row = F.struct(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("key"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("others"))
    rows = df.select(row.alias("row"), whole(F.col(f"`{text_col}`")).cast("binary").alias("data"))
    fim = pa.struct([("form", pa.string()), ("n", pa.int64()), ("prefix", pa.int64()), ("middle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, 1)):
            given, keys = part.column(0), part.column(0).field("key").to_pylist()
            done = [transform(t, k, seed, units, plain_percent, spm_percent) for t, k in zip(part.column(1).to_pylist(), keys, strict=True)]
            facts = pa.array([{"form": f, "n": n, "prefix": p, "middle": m} for _, f, n, p, m in done], fim)
            yield pa.RecordBatch.from_arrays([given, pa.array([d[0] for d in done], pa.binary()), facts], ["row", "data", "fim"])

    kind = T.StructType([rows.schema["row"], T.StructField("data", T.BinaryType()), T.StructField("fim", T._parse_datatype_string("form string, n bigint, prefix bigint, middle bigint"))])
    out, name = rows.mapInArrow(run, kind), fresh(df, "fim")
    back = [F.col("data").cast("string").alias(c) if c == text_col else F.col(f"row.others.c{others.index(c)}").alias(c) for c in df.columns]
    return out.select(*back, F.col("fim").alias(name))


def restore(text: Column, form: Column) -> Column:
    """The text that was transformed, from the output and its form; no mark straddles the parts."""
    mark = {m: F.lit(m.decode()) for m in (PREFIX, SUFFIX, MIDDLE)}
    behind = lambda t, m: F.split_part(t, mark[m], F.lit(2))
    before = lambda t, m: F.split_part(t, mark[m], F.lit(1))
    middle = behind(text, MIDDLE)
    psm = F.concat(before(behind(text, PREFIX), SUFFIX), middle, before(behind(text, SUFFIX), MIDDLE))
    spm = F.concat(before(behind(text, PREFIX), MIDDLE), middle, before(behind(text, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into code points; digests of the outputs and of what they restore to."""
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda t: F.sha2(t.cast("binary"), 256)
    return out.select(
        "doc_id",
        "fim.n",
        "fim.form",
        F.col("fim.prefix").alias("prefix_chars"),
        F.col("fim.middle").alias("middle_chars"),
        digest(F.col("text")).alias("output_sha256"),
        digest(restore(F.col("text"), F.col("fim.form"))).alias("restored_sha256"),
    )


OP11_SQL = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
drawn AS (SELECT *, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (n + 1) AS b,
                 CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 AS d FROM hashed),
formed AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS q FROM formed)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || q END) AS restored_sha256
FROM cut"""
