"""Media columns in baseline JPEG: payloads, dimensions and thumbnail hashes.

The reader parses markers, Huffman-decodes the scan and rebuilds thumbnails of
the luminance from the DC coefficients alone, one pixel for each 8x8 block. All
restart intervals of a batch of images decode side by side in numpy, one symbol
of each at a time; a scan without restarts is one interval.

The writer stores bytes losslessly in the format's unit, the quantised
coefficient: byte b is the coefficient b - 128, in zigzag order, so a block
holds 64 bytes and its DC coefficient, quantised by 8, is a pixel of brightness
b. Every block is a restart interval. A comment segment has the payload's
length, as the grid of blocks may be larger.

A null text counts as empty; empty bytes are stored as one block of zeros.
Equal texts have equal values, repeated rows too. Texts are stored whole at any
length up to 2**32 bytes. What is no baseline JPEG raises an error in
:func:`read_jpeg`. An empty table gives no rows. Other columns are neither read
nor returned.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, whole

UNIT = 64
MOST_BLOCKS = 8191  # 65,528 pixels to a side
_BATCH = 1 << 19
#: Blocks and restart intervals of a long image that are coded and decoded at a time.
SLAB = 1 << 13

# Huffman codes of the writer: (bits, symbols) in order. Sizes 0 to 8 of a DC
# coefficient have four bits; so have the AC sizes 1 to 8 without a run and the
# end of a block, and all other AC symbols nine.
_DC = [(4, list(range(9)))]
_AC = [(4, [0, *range(1, 9)]), (9, [0xF0, *(run << 4 | size for run in range(1, 16) for size in range(1, 9))])]


def codes_of(spec: list[tuple[int, list[int]]]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol to (code, bits)."""
    found, code, before = {}, 0, 0
    for bits, symbols in spec:
        code <<= bits - before
        before = bits
        for s in symbols:
            found[s] = (code, bits)
            code += 1
    return found


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, spec: list[tuple[int, list[int]]]) -> bytes:
    counts = bytearray(16)
    for bits, symbols in spec:
        counts[bits - 1] = len(symbols)
    return _segment(0xC4, bytes([kind]) + bytes(counts) + bytes(s for _, symbols in spec for s in symbols))


# A DC step of 8 makes the pixel of a block its DC coefficient plus 128.
_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0, 8] + [1] * 63))
_TABLES = _dht(0x00, _DC) + _dht(0x10, _AC) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _value_bits(v: int) -> tuple[int, int]:
    """(size, bits) of a coefficient."""
    size = abs(v).bit_length()
    return size, v if v >= 0 else v + (1 << size) - 1


def _symbol_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and lengths of each DC byte, AC byte and end padding, 12 wide."""
    dc, ac = codes_of(_DC), codes_of(_AC)
    rows = []
    for codes in (dc, ac):
        for b in range(256):
            size, bits = _value_bits(b - 128)
            code, n = codes[size]
            rows.append((code << size | bits, n + size))
    rows += [((1 << n) - 1, n) for n in range(8)]
    bits = np.zeros((len(rows), 12), np.uint8)
    lengths = np.array([n for _, n in rows])
    for row, (value, n) in zip(bits, rows, strict=True):
        row[:n] = [value >> (n - 1 - i) & 1 for i in range(n)]
    return bits, lengths


_BITS, _LENGTHS = _symbol_table()
_USED = np.arange(12) < _LENGTHS[:, None]


def _block_with_runs(block: np.ndarray) -> bytes:
    """A block that has zero coefficients behind the first, bit by bit."""
    dc, ac = codes_of(_DC), codes_of(_AC)
    value, n = 1, 0

    def put(code: int, bits: int) -> None:
        nonlocal value, n
        value, n = value << bits | code, n + bits

    size, bits = _value_bits(int(block[0]) - 128)
    put(*dc[size])
    put(bits, size)
    run = 0
    for b in block[1:].tolist():
        if b == 128:
            run += 1
            continue
        while run > 15:
            put(*ac[0xF0])
            run -= 16
        size, bits = _value_bits(b - 128)
        put(*ac[run << 4 | size])
        put(bits, size)
        run = 0
    if run:
        put(*ac[0])
    rest = -n % 8
    put((1 << rest) - 1, rest)
    return (value ^ (1 << n)).to_bytes(n // 8, "big")


def entropy_code(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length for each block) of whole-byte block codes, not yet stuffed."""
    symbols = np.empty((len(blocks), UNIT + 1), np.int64)
    symbols[:, :UNIT] = blocks
    symbols[:, 1:UNIT] += 256
    bits = _LENGTHS[symbols[:, :UNIT]].sum(axis=1)
    symbols[:, UNIT] = 512 + (-bits % 8)
    lengths = (bits + 7) // 8
    flat = symbols.ravel()
    coded = np.packbits(_BITS[flat][_USED[flat]])
    odd = np.flatnonzero((blocks[:, 1:] == 128).any(axis=1))
    if len(odd):
        parts, ends, at = [], np.cumsum(lengths), 0
        for i in odd.tolist():
            own = _block_with_runs(blocks[i])
            parts += [coded[at : ends[i] - lengths[i]], np.frombuffer(own, np.uint8)]
            at, lengths[i] = ends[i], len(own)
        coded = np.concatenate([*parts, coded[at:]])
    return coded, lengths


def grid(blocks: int) -> tuple[int, int]:
    """(columns, rows) of at least ``blocks`` blocks."""
    side = max(1, int(blocks**0.5))
    columns = min(MOST_BLOCKS, side if side * side == blocks else side + 1)
    return columns, -(-blocks // columns)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


def _scan(blocks: np.ndarray, in_image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each block) of a scan, with a restart marker before every block that is not an image's first."""
    coded, lengths = entropy_code(blocks)
    # stuff a zero behind every FF and put the markers before blocks
    room = 1 + (coded == 0xFF).astype(np.int64)
    heads = np.cumsum(lengths) - lengths
    marked = in_image > 0
    room[heads] += 2 * marked
    ends = np.cumsum(room)
    out = np.zeros(ends[-1], np.uint8)
    place = ends - 1 - (coded == 0xFF)
    out[place] = coded
    marks = place[heads[marked]]
    out[marks - 2] = 0xFF
    out[marks - 1] = 0xD0 + (in_image[marked] - 1) % 8
    return out, ends[heads + lengths - 1]


def _blocks_of(payload: bytes, first: int, last: int) -> np.ndarray:
    """Some blocks of a payload, with zeros behind its end."""
    part = payload[UNIT * first : UNIT * last]
    return np.frombuffer(part + bytes(UNIT * (last - first) - len(part)), np.uint8).reshape(-1, UNIT)


def write_jpegs(payloads: list[bytes]) -> list[bytes]:
    """The payloads, of a multiple of 64 bytes, as JPEG files; those of a slab or less go together."""
    grids = [grid(len(p) // UNIT) for p in payloads]
    sizes = [c * r for c, r in grids]
    scans: dict[int, bytes] = {}
    small = [i for i, n in enumerate(sizes) if n <= SLAB]
    if small:
        per_image = np.array([sizes[i] for i in small])
        first = np.cumsum(per_image) - per_image
        in_image = np.arange(per_image.sum()) - np.repeat(first, per_image)
        out, ends = _scan(np.concatenate([_blocks_of(payloads[i], 0, sizes[i]) for i in small]), in_image)
        at = 0
        for i, end in zip(small, ends[first + per_image - 1].tolist(), strict=True):
            scans[i], at = out[at:end].tobytes(), end
    for i in (i for i, n in enumerate(sizes) if n > SLAB):
        slabs = [(lo, min(lo + SLAB, sizes[i])) for lo in range(0, sizes[i], SLAB)]
        scans[i] = b"".join(_scan(_blocks_of(payloads[i], lo, hi), np.arange(lo, hi))[0].tobytes() for lo, hi in slabs)
    files = []
    for i, (p, (c, r)) in enumerate(zip(payloads, grids, strict=True)):
        comment = _segment(0xFE, struct.pack(">I", len(p)))
        frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * r, 8 * c, 1) + bytes([1, 0x11, 0]))
        files.append(b"".join((_HEAD, comment, frame, _TABLES, scans[i], b"\xff\xd9")))
    return files


@dataclass
class Frame:
    """What the markers of a file say, and its scan."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, list[int]] = field(default_factory=dict)
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)  # kind: counts, symbols
    restart: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC and AC table
    comment: bytes = b""
    data: bytes = b""
    part: int = 0  # MCUs, if the scan is a part of an image's

    def mcus(self) -> int:
        across, down, _ = self.blocks()
        return self.part or across * down

    def slabs(self) -> list[Frame]:
        """The frame, or parts of it that begin at restart markers, if there are many."""
        if not self.restart or -(-self.mcus() // self.restart) <= SLAB:
            return [self]
        raw = np.frombuffer(self.data, np.uint8)
        marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
        if len(marks) != -(-self.mcus() // self.restart) - 1:
            raise ValueError("restart markers are missing")
        starts = [0, *(marks[SLAB - 1 :: SLAB] + 2).tolist()]
        ends = [*marks[SLAB - 1 :: SLAB].tolist(), len(self.data)]
        sizes = [SLAB * self.restart] * (len(starts) - 1)
        return [replace(self, data=self.data[a:b], part=n) for a, b, n in zip(starts, ends, [*sizes, self.mcus() - sum(sizes)], strict=True)]

    def blocks(self) -> tuple[int, int, list[tuple[int, int, int]]]:
        """(MCUs across, MCUs down, the (component, DC, AC) of each block of an MCU)."""
        if len(self.components) == 1:
            return -(-self.width // 8), -(-self.height // 8), [(0, *self.scan[0][1:])]
        h, v = (max(c[i] for c in self.components) for i in (1, 2))
        order = {c[0]: k for k, c in enumerate(self.components)}
        pattern = [(order[i], dc, ac) for i, dc, ac in self.scan for _ in range(self.components[order[i]][1] * self.components[order[i]][2])]
        return -(-self.width // (8 * h)), -(-self.height // (8 * v)), pattern


def parse(data: bytes) -> Frame:
    """The markers of a baseline JPEG up to the end of its first scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    f, at = Frame(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                f.quantisers[body[0] & 15] = list(struct.unpack_from(">64H" if wide else ">64B", body, 1))
                body = body[1 + 64 * (1 + bool(wide)) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                f.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            _, f.height, f.width, n = struct.unpack_from(">BHHB", body)
            f.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            (f.restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            f.comment = body
        elif marker == 0xDA:
            f.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = at
            while True:  # a marker other than a restart ends the scan
                end = data.find(b"\xff", end)
                if end < 0:
                    end = len(data)
                elif end + 1 < len(data) and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                    end += 2
                    continue
                break
            f.data = data[at:end]
            return f
    raise ValueError("no scan")


def look_up_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits ahead: length of the code << 8 | symbol; 0 if there is none."""
    table_, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            first = code << (16 - bits)
            table_[first : first + (1 << (16 - bits))] = bits << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table_


def decode(frames: list[Frame]) -> list[np.ndarray]:
    """The quantised coefficients of each frame: blocks x 64, in scan and zigzag order.

    The frames must agree in tables, restart interval and MCU pattern.
    """
    head = frames[0]
    pattern = head.blocks()[2]
    mcus = np.array([f.mcus() for f in frames])
    per = head.restart or int(mcus.max())
    lanes_of = -(-mcus // per)
    raw = np.frombuffer(b"".join(f.data for f in frames) + b"\0" * 8, np.uint8)
    frame_starts = np.cumsum([0] + [len(f.data) for f in frames])
    ff = raw[:-1] == 0xFF
    behind = np.concatenate([[0], np.where(ff, raw[1:], 1)])
    is_mark = (behind >= 0xD0) & (behind <= 0xD7)
    drop = (behind == 0) & np.concatenate([[False], ff])
    drop |= is_mark
    drop[:-1] |= is_mark[1:]
    kept = np.cumsum(~drop) - 1
    clean = raw[~drop].astype(np.uint32)
    marks = np.flatnonzero(is_mark)
    starts = np.sort(np.concatenate([frame_starts[:-1], marks + 1]))
    starts = kept[np.minimum(starts, len(kept) - 1)]
    if len(starts) != lanes_of.sum():
        raise ValueError("restart markers are missing")
    word = np.zeros(len(clean), np.uint32)  # four bytes from each place on
    for i in range(4):
        word[: len(clean) - i] |= clean[i:] << np.uint32(24 - 8 * i)
    word = word.astype(np.int64)
    lane_mcus = np.full(len(starts), per)
    last = np.cumsum(lanes_of) - 1
    lane_mcus[last] = mcus - per * (lanes_of - 1)
    first_block = (np.cumsum(lane_mcus) - lane_mcus) * len(pattern)
    out = np.zeros((int(mcus.sum()) * len(pattern), 64), np.int16)
    tables = {k: look_up_table(*t) for k, t in head.tables.items()}
    bit = starts.astype(np.int64) * 8
    predicted = np.zeros((len(starts), max(c for c, _, _ in pattern) + 1), np.int64)

    def symbol(at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, value, bits read) at the bit places ``at``."""
        ahead = word[np.minimum(at >> 3, len(word) - 1)] << (at & 7) & 0xFFFFFFFF
        entry = code[ahead >> 16]
        n, s = entry >> 8, entry & 255
        if not n.all():
            raise ValueError("no such code")
        size = s & 15
        # up to 16 + 11 bits can pass 25 that a shifted word surely has
        far = n + size > 25
        value = (ahead << n & 0xFFFFFFFF) >> (32 - size)
        if far.any():
            at2 = at + n
            value = np.where(far, (word[np.minimum(at2 >> 3, len(word) - 1)] << (at2 & 7) & 0xFFFFFFFF) >> (32 - size), value)
        value = np.where((size > 0) & (value < 1 << np.maximum(size - 1, 0)), value - (1 << size) + 1, value)
        return s, np.where(size > 0, value, 0), n + size

    for j in range(int(lane_mcus.max()) * len(pattern)):
        component, dc, ac = pattern[j % len(pattern)]
        live = np.flatnonzero(lane_mcus * len(pattern) > j)
        at = bit[live]
        _, value, used = symbol(at, tables[dc])
        at += used
        predicted[live, component] += value
        block = first_block[live] + j
        out[block, 0] = predicted[live, component]
        k = np.ones(len(live), np.int64)
        todo = np.arange(len(live))
        code = tables[16 + ac]
        while len(todo):
            s, value, used = symbol(at[todo], code)
            at[todo] += used
            run, size = s >> 4, s & 15
            k[todo] += run
            put = size > 0
            where = todo[put]
            if (k[where] > 63).any():
                raise ValueError("a block is too long")
            out[block[where], k[where]] = value[put]
            k[todo] += 1
            k[todo[s == 0]] = 64
            todo = todo[k[todo] < 64]
        bit[live] = at
    ends = np.cumsum(mcus * len(pattern))
    return np.split(out, ends[:-1])


def decode_all(frames: list[Frame]) -> list[np.ndarray]:
    """The same of any number of restart intervals; long frames are decoded slab by slab."""
    small = [f for f in frames if len(f.slabs()) == 1]
    found = iter(decode(small) if small else [])
    return [next(found) if len(parts) == 1 else np.concatenate([decode([p])[0] for p in parts]) for parts in (f.slabs() for f in frames)]


def luminance(f: Frame, coefficients: np.ndarray) -> np.ndarray:
    """One pixel for each block of the first component, from its DC alone."""
    across, down, pattern = f.blocks()
    if len(f.components) == 1:
        dc = coefficients[:, 0].reshape(down, across)
    else:
        _, h, v, _ = f.components[0]
        own = [k for k, (c, _, _) in enumerate(pattern) if c == 0]
        dc = coefficients[:, 0].reshape(down, across, len(pattern))[:, :, own].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        dc = dc[: -(-f.height // 8), : -(-f.width // 8)]
    step = f.quantisers[f.components[0][3]][0]
    return np.clip(np.rint(dc * (step / 8)) + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: which of 8x8 areas are brighter than the mean of the thumbnail."""
    rows, columns = (np.minimum(np.arange(8) * n // 8, n - 1) for n in pixels.shape)
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), np.unique(rows), axis=0), np.unique(columns), axis=1)
    sizes = np.outer(np.diff([*np.unique(rows), pixels.shape[0]]), np.diff([*np.unique(columns), pixels.shape[1]]))
    small = (sums / sizes)[np.searchsorted(np.unique(rows), rows)][:, np.searchsorted(np.unique(columns), columns)]
    return np.packbits(small > pixels.mean()).tobytes().hex()


def read_jpeg(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, thumbnail) of any baseline JPEG."""
    f = parse(data)
    return f.width, f.height, luminance(f, decode_all([f])[0])


def feature(f: Frame, thumbnail: np.ndarray) -> str:
    return f"{f.width}x{f.height}:{thumbnail_hash(thumbnail)}:{zlib.crc32(thumbnail.tobytes()):08x}"


def store(texts: list[bytes]) -> Iterator[tuple[int, bytes, bytes, str]]:
    """(length, JPEG file, payload read back, feature) of each text."""
    part: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size < _BATCH and i + 1 < len(texts):
            continue
        files = write_jpegs([padded(x) for x in part])
        frames = [parse(x) for x in files]
        for x, file, f, c in zip(part, files, frames, decode_all(frames), strict=True):
            (n,) = struct.unpack(">I", f.comment)
            yield len(x), file, (c.astype(np.uint8) + np.uint8(128)).tobytes()[:n], feature(f, luminance(f, c))
        part, size = [], 0


_OUT = [("id", None), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary())]


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """The stored form of each text with its digests and feature; nothing is shuffled."""
    rows = df.select(F.col(id_col).alias("id"), whole(text_col).cast("binary").alias("data"))
    names = [n for n, _ in _OUT if with_media or n != "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, 1)):
            found = [
                (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), what, *[file] * with_media)
                for n, file, payload, what in store(part.column(1).to_pylist())
            ]
            columns = list(zip(*found, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, _OUT[1:], strict=False))], names)

    kinds = {"n_bytes": "long", "payload_bytes": "long", "tail_crc32": "long", "media_bytes": "long", "media": "binary"}
    fields = ", ".join(f"{n} {kinds.get(n, 'string') if n != 'id' else rows.schema['id'].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a JPEG and read back."""
    return media_column(table(spark, sf_dir, "documents"), with_media=False)
