"""Simple-8b: whole numbers packed into 64-bit words, several to a word.

The top four bits of a word select how many values its other 60 bits hold.
Numbers are cut into blocks of ``BLOCK`` values; every block begins a new word,
and the offset of that word is kept, so blocks are packed and unpacked side by
side with array operations. A value of more than 60 bits is an escape: its word
holds the place of the value in a list that follows the words.
"""

from __future__ import annotations

import struct

import numpy as np

# How many numbers of how many bits each selector stands for.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15

BLOCK = 256
_HEAD = "<4sIQQQ"  # magic, block size, values, words, escapes
_MAGIC = b"S8B1"


_COUNTS = np.array([count for count, _ in SELECTORS] + [0, 1])


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, at least 1."""
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    bits = np.frexp(low)[1]
    if high.any():
        bits = np.where(high > 0, np.frexp(high)[1] + 32, bits)
    return np.maximum(bits, 1).astype(np.uint8)


def _layout(bits: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its selector: the first one that fits.

    A selector fits when its next ``count`` values, or those left in the block,
    are narrow enough. The widest of the next values is found for all places
    together, then all blocks are walked at once, one word of each a step.
    """
    n = len(bits)
    lanes = -(-n // block)
    ahead = max(count for count, _ in SELECTORS)
    padded = np.zeros((lanes, block + ahead), np.uint8)
    whole = np.zeros(lanes * block, np.uint8)
    whole[:n] = bits
    padded[:, :block] = whole.reshape(lanes, block)
    widest = {1: padded}
    for count in sorted(count for count, _ in SELECTORS):
        if count not in widest:
            half = min(c for c in widest if 2 * c >= count)
            back = widest[half]
            moved = np.zeros_like(back)
            moved[:, : half - count] = back[:, count - half :]
            widest[count] = np.maximum(back, moved)
    choice = np.full((lanes, block), ESCAPE, np.uint8)
    for k, (count, width) in reversed(list(enumerate(SELECTORS))):
        choice[widest[count][:, :block] <= width] = k
    choice = choice.reshape(-1)
    at = np.arange(0, n, block)
    end = np.minimum(at + block, n)
    places = []
    while len(at):
        places.append(at)
        at = at + _COUNTS[choice[at]]
        more = at < end
        at, end = at[more], end[more]
    place = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    return place, choice[place].astype(np.int64)


def pack(values: np.ndarray, block: int = BLOCK) -> bytes:
    """The values as one self-contained piece of bytes."""
    n = len(values)
    padded = np.zeros(n + 60, np.uint64)
    padded[:n] = values
    values = padded[:n]
    place, picked = _layout(_widths(values), block)
    left = np.minimum((place // block + 1) * block, n) - place
    packed = picked.astype(np.uint64) << np.uint64(60)
    for selector, (count, width) in enumerate(SELECTORS):
        rows = np.flatnonzero(picked == selector)
        if not len(rows):
            continue
        begin, word, have = place[rows], packed[rows], left[rows]
        short = have.min() < count
        for i in range(count):
            held = padded[begin + i]
            if short:
                held = held * (have > i)
            word |= held << np.uint64(i * width)
        packed[rows] = word
    rows = np.flatnonzero(picked == ESCAPE)
    escapes = values[place[rows]]
    packed[rows] |= np.arange(len(rows), dtype=np.uint64)
    offsets = np.searchsorted(place, np.arange(0, n, block)).astype("<u8")
    head = struct.pack(_HEAD, _MAGIC, block, n, len(packed), len(escapes))
    return head + offsets.tobytes() + packed.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def unpack(piece: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The values of a piece, or of its blocks ``first_block`` to ``last_block - 1``."""
    magic, block, n, n_words, n_escapes = struct.unpack_from(_HEAD, piece)
    if magic != _MAGIC:
        raise ValueError("not a packed piece")
    blocks = -(-n // block)
    body = np.frombuffer(piece, "<u8", offset=struct.calcsize(_HEAD))
    offsets = np.append(body[:blocks], n_words).astype(np.int64)
    packed = body[blocks : blocks + n_words]
    escapes = body[blocks + n_words : blocks + n_words + n_escapes]
    last_block = blocks if last_block is None else min(last_block, blocks)
    if first_block >= last_block:
        return np.zeros(0, np.uint64)
    packed = packed[offsets[first_block] : offsets[last_block]]
    offsets = offsets[first_block : last_block + 1] - offsets[first_block]
    selector = (packed >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selector]
    before = np.cumsum(counts) - counts
    size = min(last_block * block, n) - first_block * block
    lane = np.repeat(np.arange(last_block - first_block), np.diff(offsets))
    # where each word's values go: counted from the first word of its block
    start = lane * block + before - before[offsets[:-1]][lane]
    have = np.minimum((lane + 1) * block, size) - start
    out = np.zeros(size, np.uint64)
    for number, (count, width) in enumerate(SELECTORS):
        rows = np.flatnonzero(selector == number)
        if not len(rows):
            continue
        mask = np.uint64((1 << width) - 1)
        to, words, room = start[rows], packed[rows], have[rows]
        for i in range(count):
            if room.min() <= i:
                inside = room > i
                to, words, room = to[inside], words[inside], room[inside]
                if not len(room):
                    break
            out[to + i] = words >> np.uint64(i * width) & mask
    rows = np.flatnonzero(selector == ESCAPE)
    out[start[rows]] = escapes[(packed[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out
