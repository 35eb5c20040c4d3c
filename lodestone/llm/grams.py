"""Words of texts and CRC-32 codes of their runs, many texts at a time in numpy.

Letters A-Z are lowered, and words are maximal runs of digits, letters a-z and
anything beyond ASCII. All other bytes become spaces, so a run of words is the
first word's bytes and then, for each further word, the space before it and its
bytes, whatever stood between; its code goes on from the code of the run before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a word that are coded for all words at a time; longer words are coded alone.
TOGETHER = 48
#: Words that are coded at a time.
SEGMENT = 1 << 16
NONE = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    code = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        code = np.where(code & 1, np.uint32(0xEDB88320) ^ (code >> np.uint32(1)), code >> np.uint32(1))
    return code.astype(np.uint32)


_CRC = _crc_table()


@dataclass
class Words:
    """Words of several texts: the texts' bytes, where words begin, their lengths, the first word of each text and behind the last."""

    data: bytes
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: list[bytes]) -> Words:
    data = b" ".join(texts).translate(_WORD)
    dark = np.frombuffer(data, np.uint8) != 32
    step = np.flatnonzero(np.diff(np.concatenate([[False], dark, [False]]).view(np.int8)))
    starts, ends = step[::2], step[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(data, starts, ends - starts, np.searchsorted(starts, begins))


def advance(data: bytes, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> np.ndarray:
    """CRC-32 states (codes before the last inversion) after ``lengths`` bytes from ``starts``."""
    order = np.argsort(-np.minimum(lengths, TOGETHER + 1).astype(np.int16), kind="stable")
    states, at, size = states[order], starts[order], lengths[order]
    long = int(np.searchsorted(-size, -TOGETHER, "left"))  # those of more bytes come first
    for i in range(long):
        begin = int(at[i])
        states[i] = zlib.crc32(data[begin : begin + int(size[i])], int(states[i] ^ NONE)) ^ 0xFFFFFFFF
    array, size = np.frombuffer(data, np.uint8), size[long:]
    live, at = states[long:], at[long:]
    for k in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -k, "left"))  # words of more than k bytes
        now = live[:m]
        live[:m] = _CRC[(now ^ array[at[:m] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty_like(states)
    out[order] = states
    return out


def runs(found: Words, longest: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For segments of the words: (number of the first word, codes of the runs of 1, 2 and so on words that begin at each).

    Runs go on into the next text; it is for the caller to leave those out. Those
    that no words are left for have the code of the run before.
    """
    total = len(found.starts)
    for low in range(0, total, SEGMENT):
        high = min(low + SEGMENT, total)
        state = advance(found.data, found.starts[low:high], found.lengths[low:high], np.full(high - low, NONE))
        out = [state ^ NONE]
        for k in range(1, longest):
            n = max(0, min(high, total - k) - low)
            more = slice(low + k, low + k + n)
            state = np.concatenate([advance(found.data, found.starts[more] - 1, found.lengths[more] + 1, state[:n]), state[n:]])
            out.append(state ^ NONE)
        yield low, out
