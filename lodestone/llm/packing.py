"""Packing documents into token windows by multiway differencing.

A document is its token ids and a final 0. It is cut into full windows, which
need no padding, and a rest, which is cut again into near-equal pieces of at
most ``grain`` ids. A task packs its rests block by block: each block asks for
as few windows as its ids need, and Karmarkar-Karp differencing partitions the
pieces among them. It starts with one partial partition for each piece and
always merges the two with the largest imbalance, the fullest windows of one
onto the emptiest of the other, until one partition of near-equal windows is
left. If a window is over its capacity, the block is partitioned again with one
window more. Blocks bound the memory; nothing is shuffled.

A null text counts as empty and is the one id 0. A text that holds an added
token of the vocabulary, such as ``<|endoftext|>``, has that token's id there. Equal texts and repeated rows
are packed each for itself. Texts are read whole at any length. An empty table
gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole

CAPACITY, GRAIN, BLOCK = 1024, 256, 1024


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """The place of a public vocabulary, without the endings .json and .tiktoken of its two files."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json").removesuffix(".json")


@lru_cache(2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """The ids of a text under the tokenizer ``path``.json, without special tokens around it.

    Its vocabulary is read as the ranks in ``path``.tiktoken, which takes a
    quarter of the tokenizers library's time; its added tokens are matched in
    the text first, as that library does, so the ids are the same.
    """
    import public_tokenizers
    import tiktoken

    with open(f"{path}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(f"{path}.json", "rb") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    made = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return partial(made.encode, allowed_special="all")


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, next, heads) of a partition of ``sizes`` into ``windows``.

    Each window is a chain of pieces, ``heads`` and then ``next``, up to -1.
    """
    after = np.full(len(sizes), -1)
    heap = []
    for i, x in enumerate(sizes):
        sums, heads = np.zeros(windows, np.int64), np.full(windows, -1)
        sums[0], heads[0] = x, i
        heap.append((-int(x), i, sums, heads, heads.copy()))
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a, a_head, a_tail = heapq.heappop(heap)  # fullest window first
        _, _, b, b_head, b_tail = heap[0]
        b, b_head, b_tail = b[::-1], b_head[::-1], b_tail[::-1]
        both = (a_head >= 0) & (b_head >= 0)
        after[a_tail[both]] = b_head[both]
        sums, heads, tails = a + b, np.where(a_head >= 0, a_head, b_head), np.where(b_head >= 0, b_tail, a_tail)
        order = np.argsort(-sums, kind="stable")
        sums, heads, tails = sums[order], heads[order], tails[order]
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), number, sums, heads, tails))
        number += 1
    _, _, sums, heads, _ = heap[0]
    return sums, after, heads


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of piece numbers; no window is over its capacity."""
    if not sizes:
        return []
    sizes_ = np.asarray(sizes, np.int64)
    windows = -(-int(sizes_.sum()) // capacity)
    while True:
        sums, after, heads = differencing(sizes_, windows)
        if sums[0] <= capacity:
            break
        windows += 1
    packed = []
    for head in heads.tolist():
        window = []
        while head >= 0:
            window.append(head)
            head = int(after[head])
        packed.append(window)
    return [w for w in packed if w]


def cut(tokens: int, capacity: int, grain: int) -> tuple[list[int], list[int]]:
    """Lengths of the full windows and of the rest's pieces."""
    full, rest = divmod(tokens, capacity)
    parts = -(-rest // grain)
    return [capacity] * full, [rest * (i + 1) // parts - rest * i // parts for i in range(parts)]


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` adds the ids. A sequence id is the task's number and a count.
    """
    path = path or vocabulary()
    grain = max(1, capacity * GRAIN // CAPACITY)
    rows = df.select(F.col(id_col).alias("id"), whole(text_col).cast("binary").alias("data"))
    id_type = rows.schema["id"].dataType
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task, sequence = TaskContext.get().partitionId() << 33, 0
        out: list[tuple] = []
        waiting: list[tuple] = []
        arrow_id = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = [arrow_id, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_ids]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            out.clear()
            return batch

        def settle() -> None:
            nonlocal sequence
            for window in pack_block([p[2] for p in waiting], capacity):
                offset = 0
                for i in window:
                    out.append((*waiting[i][:5], task + sequence, offset, *waiting[i][5:]))
                    offset += waiting[i][2]
                sequence += 1
            waiting.clear()

        for batch in batches:
            arrow_id = batch.schema.field(0).type
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(data.as_py().decode("utf-8", "replace")), 0], "<u4")
                full, rest = cut(len(ids), capacity, grain)
                start = 0
                for length in full + rest:
                    own = ids[start : start + length]
                    piece = (key, start, length, zlib.crc32(own.tobytes()), len(ids), *[own.tolist()] * with_ids)
                    start += length
                    if length == capacity:
                        out.append((*piece[:5], task + sequence, 0, *piece[5:]))
                        sequence += 1
                    else:
                        waiting.append(piece)
                if len(waiting) >= BLOCK:
                    settle()
                if len(out) >= 20_000:
                    yield flush()
        settle()
        if out:
            yield flush()

    fields = f"id {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    packed = rows.mapInArrow(run, fields)
    return packed.withColumnRenamed("id", id_col)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
