"""Hashes of words and of runs of consecutive words, as numpy arrays over many texts at once.

A word's hash is a polynomial in its bytes, through a table of random values; prefix sums give those of all words of a
buffer together, with no object for a single word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters of texts that are hashed together; a longer text is hashed alone, in pieces cut at white space.
GROUP = 1 << 19
#: Texts of an Arrow column that are unpacked at a time.
SLICE = 256
#: Odd multipliers: one for bytes and one for words of each independent hash, and two for the final mixing.
STEP = {0: 0xC6A4A7935BD1E995, 1: 0xFF51AFD7ED558CCD}
ROLL = {0: 0x9E3779B97F4A7C15, 1: 0xD1342543DE82EF95}
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = {seed: np.random.default_rng(20240229 + seed).integers(0, 1 << 64, 256, dtype=np.uint64) for seed in ROLL}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def words_of(text: str | None) -> list[bytes]:
    """Words between the characters U+0020 and U+0009 to U+000D, as UTF-8; these are what ``bytes.split`` splits at."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def groups(texts: list[str | None] | pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(index of the first text, texts) in groups of about ``GROUP`` characters; of an Arrow column few texts are unpacked at a time."""
    if not isinstance(texts, list):
        for at in range(0, len(texts), SLICE):
            for k, some in groups(texts.slice(at, SLICE).to_pylist()):
                yield at + k, some
        return
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h.copy()
    for shift, factor in ((30, MIX[0]), (27, MIX[1])):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _power_tables(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the byte multiplier and of its inverse, at least ``n`` of them."""
    if seed not in _powers or len(_powers[seed][0]) < n:
        size = max(n, GROUP * 2)
        tables = []
        for factor in (STEP[seed], pow(STEP[seed], -1, 1 << 64)):
            row = np.full(size, factor, dtype=np.uint64)
            row[0] = 1
            tables.append(np.multiply.accumulate(row))
        _powers[seed] = (tables[0], tables[1])
    return _powers[seed]


def _hash_buffer(data: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of a buffer."""
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = ~_SPACE[data]
    turns = np.diff(word)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    up, down = _power_tables(seed, len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[seed][data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[str | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, one text after the other; words of each text)."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    offsets = np.cumsum([0, *(len(p) + 1 for p in parts)])
    data = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = at + 4 * GROUP
        while end < len(data) and not (cut := np.flatnonzero(_SPACE[data[end : end + GROUP]])[:1]).size:
            end += GROUP
        end = len(data) if end >= len(data) else end + int(cut[0])
        h, s = _hash_buffer(data[at:end], seed)
        hashes.append(h), starts.append(s + at)
        at = end
    held = np.concatenate([np.empty(0, dtype=np.int64), *starts])
    return np.concatenate([np.empty(0, dtype=np.uint64), *hashes]), np.diff(np.searchsorted(held, offsets))


def run_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` consecutive words, from word hashes of the same seed."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(ROLL[seed])
        out += hashes[k : k + len(out)]
    return mixed(out)


def running_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def within(lens: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, text index) of the runs of ``n`` words that lie within one text; ``lens`` are the texts' word counts, ``total`` their sum."""
    which = np.repeat(np.arange(len(lens)), lens)
    ends = np.cumsum(lens)[which] if len(lens) else np.empty(0, dtype=np.int64)
    starts = np.flatnonzero(np.arange(total) + n <= ends)
    return starts, which[starts]
