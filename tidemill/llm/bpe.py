"""Encoding with a public byte-level BPE vocabulary.

The merges of a whole batch of pre-tokens run together. A linked list over the bytes of all of them holds the current
symbols; a bucket for each merge rank holds the list positions where that merge may apply; a bitmap of three levels
over the ranks gives the next rank by find-first-set. A popped bucket's stale positions (symbols since merged) are
skipped, the rest are merged at once in NumPy, and the pairs that come into being go to their buckets, which are always
of a higher rank. The cost of a pre-token grows with its length only (no rescanning), however long it is.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie on every machine; a parameter of :func:`encode`.
DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the vocabulary's published pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
_NONE = np.iinfo(np.int64).max


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class RankQueue:
    """Buckets of positions by rank, with a hierarchical bitmap of the ranks that have any."""

    def __init__(self, ranks: int):
        self.low, self.mid, self.top = [0] * (ranks // 64 + 1), [0] * (ranks // 4096 + 1), 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        if (found := self.buckets.get(rank)) is not None:
            found.append(positions)
            return
        self.buckets[rank] = [positions]
        i = rank >> 6
        self.low[i] |= 1 << (rank & 63)
        self.mid[i >> 6] |= 1 << (i & 63)
        self.top |= 1 << (i >> 6)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) == 1:
            self.push(int(ranks[0]), positions)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist(), len(ranks)]
        heads = ranks[starts[:-1]].tolist()
        for k, r in enumerate(heads):
            self.push(r, positions[starts[k] : starts[k + 1]])

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        b = (a << 6) + (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = (b << 6) + (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[b >> 6] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        found = self.buckets.pop(rank)
        return rank, found[0] if len(found) == 1 else np.concatenate(found)


class Encoder:
    """A byte-level BPE vocabulary read from its published file."""

    #: short pre-tokens kept with their ids, per worker; the table is emptied when it is full
    KEPT, KEPT_CHARS = 200_000, 24
    #: bytes of pre-tokens merged together; a longer pre-token is a batch of its own
    BATCH = 1 << 20

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.a, self.b = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.new = np.array([vocab[x + y] for x, y in pairs], np.int64)
        keys = (self.a << 32) | self.b
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        self.kept: dict[str, list[int]] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def merge(self, pretokens: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token (none of them empty)."""
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        ids = self.first[np.frombuffer(b"".join(pretokens), np.uint8)]
        n, ends = len(ids), np.cumsum(sizes)
        following, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        following[ends - 1] = -1
        before[ends[:-1]] = -1
        queue = RankQueue(len(self.new))
        left = np.flatnonzero(following >= 0)
        ranks = self._ranks(ids[left], ids[left + 1])
        some = ranks != _NONE
        if some.any():
            queue.push_all(ranks[some], left[some])
        while (popped := queue.pop()) is not None:
            rank, p = popped
            q = following[p]
            p = p[alive[p] & (q >= 0) & (ids[p] == self.a[rank]) & (ids[q] == self.b[rank])]  # stale entries skipped
            if not len(p):
                continue
            if len(p) > 1:
                p = np.unique(p)
                if self.a[rank] == self.b[rank]:  # of overlapping pairs the leftmost wins
                    keep, last = [], -1
                    for x, y in zip(p.tolist(), following[p].tolist()):
                        if x != last:
                            keep.append(x)
                            last = y
                    p = np.array(keep, np.int64)
            q = following[p]
            after = following[q]
            ids[p] = self.new[rank]
            alive[q] = False
            following[p] = after
            inner = after >= 0
            before[after[inner]] = p[inner]
            prior = before[p]
            lefts = np.concatenate([prior[prior >= 0], p[inner]])
            if len(lefts):
                ranks = self._ranks(ids[lefts], ids[following[lefts]])
                some = ranks != _NONE
                if some.any():
                    queue.push_all(ranks[some], lefts[some])
        kept = np.flatnonzero(alive)
        cuts = np.searchsorted(kept, np.concatenate([[0], ends])).tolist()
        flat = ids[kept].tolist()
        return [flat[cuts[i] : cuts[i + 1]] for i in range(len(pretokens))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts; a null or empty text has none."""
        split = [_SPLIT.findall(t) if t else [] for t in texts]
        kept, fresh = self.kept, {}
        for parts in split:
            for part in parts:
                if part not in kept and part not in fresh:
                    fresh[part] = None
        if fresh:
            names, batch, size, done = list(fresh), [], 0, 0
            for name in names:
                data = name.encode("utf-8", "surrogatepass")
                if batch and size + len(data) > self.BATCH:
                    for k, ids in enumerate(self.merge(batch), done):
                        fresh[names[k]] = ids
                    done, batch, size = done + len(batch), [], 0
                batch.append(data)
                size += len(data)
            for k, ids in enumerate(self.merge(batch), done):
                fresh[names[k]] = ids
        flat: list[int] = []
        offsets = [0]
        for parts in split:
            for part in parts:
                flat += kept[part] if part in kept else fresh[part]
            offsets.append(len(flat))
        if len(kept) + len(fresh) > self.KEPT:
            kept.clear()
        kept.update((k, v) for k, v in fresh.items() if len(k) <= self.KEPT_CHARS)
        return np.array(offsets, np.int64), np.array(flat, np.int32)


@lru_cache(maxsize=4)
def encoder(file: str) -> Encoder:
    return Encoder(file)


#: Characters of text encoded together: bounds a worker's memory, whatever the batch or the document.
STEP_CHARS = 1 << 20


def _steps(texts: list[str | None]):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= STEP_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(df: DataFrame, text: str, out: str = "ids", file: str = DEFAULT_FILE) -> DataFrame:
    """Adds the column ``out`` (array<int>): the ids of ``text``, without special tokens (their strings are ordinary text).

    Null and empty texts give an empty list; blank texts are encoded as they are; texts are encoded whole, whatever
    their length; repeated rows and all other columns are kept (one named ``out`` is replaced); an empty table gives an
    empty table.
    """

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        enc, lists = encoder(file), []
        for part in _steps(column.to_pylist()):
            offsets, flat = enc.encode(part)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())))
        return pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))

    return df.withColumn(out, ids(F.col(text)))
