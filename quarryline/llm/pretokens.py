"""Pre-tokens of a byte-level BPE vocabulary file, exact counts of whole texts through a bounded cache, and their ids."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import regex
import tiktoken

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts beyond this many characters are split in blocks of pre-tokens rather than at once.
LONG_TEXT = 1 << 21
BLOCK = 100_000
#: Entries after which a cache of pre-tokens starts anew. It changes no result.
CACHE_ENTRIES = 1_000_000
#: Bytes beyond which a pre-token is merged by itself: rounds over all its symbols would cost the square of its length.
LONG_PIECE = 2048
#: Characters of texts whose unknown pre-tokens are resolved together.
GROUP = 1 << 20


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable Latin-1 for itself, the others from 256 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [rest.get(b, chr(b)) for b in range(256)]


class Splitter:
    """Pre-tokens of a text in blocks. Strings of special tokens are cut out first, as the library does by default."""

    def __init__(self, specials: list[str]):
        self.find = regex.compile(PATTERN)
        self.specials = frozenset(specials)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def blocks(self, text: str) -> Iterator[list[str]]:
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.specials) else [text]
        for part in parts:
            if part in self.specials:
                yield [part]
            elif len(part) <= LONG_TEXT:
                yield self.find.findall(part)
            else:
                found = (m.group() for m in self.find.finditer(part))
                while block := list(islice(found, BLOCK)):
                    yield block


class MergeTable:
    """The merges of a vocabulary file as sorted numpy arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.size = max(vocab.values()) + 1
        self.of_byte = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        self._pairs: dict[int, tuple[int, int]] | None = None
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in merges], dtype=np.int64)[order]

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each non-empty piece.

        All pieces lie in one ragged array. In each round every piece applies its own lowest-rank pair, at all its places
        at once and left to right where they overlap; pieces without a pair leave the array. Long pieces go one by one.
        """
        out = np.array([len(p) for p in pieces], dtype=np.int64)
        short = out <= LONG_PIECE
        for k in np.flatnonzero(~short).tolist():
            out[k] = self.count_long(pieces[k])
        which = np.flatnonzero(short)
        lens = out[which]
        ids = self.of_byte[np.frombuffer(b"".join(pieces[k] for k in which.tolist()), dtype=np.uint8)]
        none = np.iinfo(np.int64).max
        while len(ids):
            starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
            piece = np.repeat(np.arange(len(lens)), lens)
            pair = np.empty(len(ids), dtype=np.int64)
            pair[:-1] = ids[:-1] * self.size + ids[1:]
            pair[-1] = -1
            pair[starts[1:] - 1] = -1
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where(self.keys[at] == pair, self.rank[at], none)
            least = np.minimum.reduceat(rank, starts)
            hit = (rank == least[piece]) & (rank != none)
            where = np.flatnonzero(hit)
            if len(where):
                new_run = np.concatenate(([True], np.diff(where) != 1))
                first = np.maximum.accumulate(np.where(new_run, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - first) % 2 == 0]
            ids[where] = self.made[at[where]]
            keep = np.ones(len(ids), dtype=bool)
            keep[where + 1] = False
            lens = lens - np.bincount(piece[where], minlength=len(lens))
            out[which] = lens
            live = least != none
            keep &= live[piece]
            ids, lens, which = ids[keep], lens[live], which[live]
        return out

    def count_long(self, piece: bytes) -> int:
        """The same for one long piece: its pairs in a heap by rank and place, its symbols in a linked list, so that it costs n log n."""
        if self._pairs is None:
            self._pairs = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))
        pairs, size = self._pairs, self.size
        ids = self.of_byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(pairs[key][0], k, key) for k in range(n - 1) if (key := ids[k] * size + ids[k + 1]) in pairs]
        heapq.heapify(heap)
        left = n
        while heap:
            _, k, key = heapq.heappop(heap)
            other = after[k]
            if ids[k] < 0 or other < 0 or ids[k] * size + ids[other] != key:
                continue  # one of the two has been merged since
            ids[k], ids[other] = pairs[key][1], -1
            after[k] = after[other]
            if after[k] >= 0:
                before[after[k]] = k
            left -= 1
            for at in (before[k], k):
                if at >= 0 and after[at] >= 0 and (new := ids[at] * size + ids[after[at]]) in pairs:
                    heapq.heappush(heap, (pairs[new][0], at, new))
        return left


class Cached:
    """Values of pre-tokens: known ones from a dictionary, unknown ones of a block resolved together."""

    def __init__(self, splitter: Splitter, resolve: Callable[[list[str]], list], special: dict[str, object]):
        self.splitter, self.resolve, self.special, self.known = splitter, resolve, special, dict(special)

    def each(self, texts: Iterable[str]) -> Iterator[Iterable[Iterable]]:
        """For each text its blocks of values, in order; texts are read in groups of about ``GROUP`` characters."""
        group: list[str] = []
        size = 0
        for text in texts:
            if len(text) > LONG_TEXT:
                yield from self._grouped(group)
                group, size = [], 0
                yield self._long(text)
                continue
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._grouped(group)
                group, size = [], 0
        yield from self._grouped(group)

    def _grouped(self, texts: list[str]) -> Iterator[list[Iterator]]:
        cut = [list(self.splitter.blocks(t)) for t in texts]
        self.learn(set().union(*(block for blocks in cut for block in blocks)))
        for blocks in cut:
            yield [map(self.known.__getitem__, block) for block in blocks]

    def _long(self, text: str) -> Iterator[Iterator]:
        for block in self.splitter.blocks(text):
            self.learn(set(block))
            yield map(self.known.__getitem__, block)

    def learn(self, found: set[str]) -> None:
        if missing := found.difference(self.known):
            if len(self.known) + len(missing) > CACHE_ENTRIES:
                self.known = dict(self.special)
                missing = found.difference(self.known)
            missing = list(missing)
            self.known.update(zip(missing, self.resolve(missing), strict=True))


_LOADED: dict[tuple[str, str], object] = {}


def counter(path: str) -> Cached:
    """Token counts of pre-tokens, by merging; one for each worker process."""
    if ("count", path) not in _LOADED:
        merges = MergeTable(path)
        _LOADED["count", path] = Cached(Splitter(merges.specials), lambda found: merges.count([p.encode() for p in found]).tolist(), dict.fromkeys(merges.specials, 1))
    return _LOADED["count", path]


def encoder(path: str) -> tiktoken.Encoding:
    """The same vocabulary for ids of whole texts, one for each worker process; tests hold its ids against the tokenizers library.

    Merges must have ids in their own order, as ranks; a file of another kind is refused rather than read wrongly.
    """
    if ("ids", path) not in _LOADED:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        of_char = {c: b for b, c in enumerate(byte_alphabet())}
        if any(b <= a for a, b in zip(made, made[1:])) or (made and made[0] <= max(vocab[c] for c in of_char)):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        ranks = {bytes(of_char[c] for c in token): i for token, i in vocab.items() if all(c in of_char for c in token)}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s in specials:
            ranks.pop(s.encode(), None)
        _LOADED["ids", path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)
    return _LOADED["ids", path]
