"""New batches held against everything accepted before.

Each text is reduced to its letters and digits and cut at content-defined boundaries: a rolling hash runs over it, and
every window of a fixed number of characters is represented by the gram with the smallest hash in it. The boundaries
depend on the characters around them only, so a shared run gives shared chunks wherever it stands. A persistent table
(chunk hash, accepted row, share of the row's windows) is kept in buckets; a new batch's chunks are shuffled to these
buckets, the shared totals of each pair of texts are summed, and pairs with enough of them are decided by the exact
coverage. What is accepted is appended. No ingest rewrites or shuffles the history.

An accepted text need not be looked up by all of its chunks: any share of its windows that a repeat can't miss will do,
and the chunks that the fewest texts have are kept, so that usual lines are left out.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.leakage import _grams, stream
from tidemill.session import discard, fresh_path, publish, published


@dataclass(frozen=True)
class ChunkParams:
    """``kept`` is the least share of an accepted text that a repeat has in runs of at least ``run`` characters.

    Pairs to be decided are found without loss where the new text holds ``wide_kept`` of the accepted one's windows of
    ``wide`` characters. Accepted texts of fewer than ``dense_below`` characters are looked up so that every repeat is
    found, however its runs lie; a larger value extends that to longer texts, at the price of many more pairs to count.
    ``buckets`` is that of the kept tables and fixed when a store is made; ``leaders`` is how many undecided texts of
    one batch that share a chunk are looked at in the first round (eight times as many in each further one).
    """

    kept: float = 0.75
    run: int = 16
    wide: int = 48
    wide_kept: float = 0.3
    wide_least: float = 0.1
    dense_below: int = 96
    buckets: int = 24
    leaders: int = 16


def kept_share(accepted: str, other: str, run: int) -> float:
    """The share of ``accepted`` that lies in runs of at least ``run`` characters found in ``other`` too; shorter texts must be equal."""
    if accepted == other:
        return 1.0
    if len(accepted) < run or len(other) < run:
        return 0.0
    found = {other[i : i + run] for i in range(len(other) - run + 1)}
    covered = last = 0
    for i in range(len(accepted) - run + 1):
        if accepted[i : i + run] in found:
            covered += i + run - max(last, i)
            last = i + run
    return covered / len(accepted)


def _prepared(texts: pd.Series) -> pd.Series:
    return pd.Series([stream(t) if t else None for t in texts], dtype=object)


def _windows(codes: np.ndarray, run: int, q: int) -> np.ndarray:
    """For each window of ``run`` characters the smallest hash of its grams of ``q`` characters."""
    h = _grams(codes, q)
    width, step, least = run - q + 1, 1, h
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    return least


def _gram_of(run: int) -> int:
    """The largest power of two that leaves several grams in a window."""
    return 1 << max(2, int(math.log2(run * 3 / 4)))


@dataclass
class _Heads:
    """The chunks of a few texts: where each begins, its hash, and of how many windows it is the smallest gram."""

    hashes: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    windows: np.ndarray
    n: np.ndarray


def _heads(texts: Sequence[str], run: int, seed: int) -> _Heads | None:
    """None where all texts are shorter than ``run``."""
    lengths = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(lengths - run + 1, 0)
    if not n.any():
        return None
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    least = _windows(codes, run, _gram_of(run))
    owner = np.repeat(np.arange(len(texts)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    h = least[np.repeat(np.cumsum(lengths) - lengths, n) + within]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
    windows = np.diff(np.append(first, len(h)))
    with np.errstate(over="ignore"):
        hashes = (h[first] ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> np.uint64(32)
    return _Heads(hashes, owner[first], within[first], windows, n)


def _probes(texts: Sequence[str], run: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and owners of all chunks, each once for a text."""
    found = _heads(texts, run, seed)
    if found is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = np.lexsort((found.owner, found.hashes))
    h, o = found.hashes[order], found.owner[order]
    once = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    return h[once], o[once]


def _stretch(cost: np.ndarray, length: int, p: ChunkParams) -> tuple[int, int]:
    """From and to of the cheapest stretch of windows that no repeat can miss, however short its runs."""
    n = len(cost)
    total = np.concatenate([[0], np.cumsum(cost)])
    # at either end of a text, characters lie in fewer windows than inside it
    missing = length - math.ceil(p.kept * length - 1e-9)
    ends, inner = min(missing + 1, n), missing + p.run
    found = [(total[ends], 0, ends), (total[n] - total[n - ends], n - ends, n)]
    if inner < n:
        sums = total[inner:] - total[: n + 1 - inner]
        k = int(sums.argmin())
        found.append((sums[k], k, k + inner))
    return min(found)[1:]


def _rarest(found: _Heads, held: np.ndarray, p: ChunkParams) -> np.ndarray:
    """Of each text the rarest chunks, in any place, up to the share of its windows of which a repeat has ``wide_least``."""
    order = np.lexsort((-found.windows, held, found.owner))
    owner, size = found.owner[order], found.windows[order]
    before = np.cumsum(size) - size - (np.cumsum(found.n) - found.n)[owner]
    return order[before < np.ceil(found.n * (1 - p.wide_kept + p.wide_least))[owner]]


def _index(texts: Sequence[str], p: ChunkParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, owners and shares of the chunks by which accepted texts are looked up.

    A chunk's share is that of the text's windows which it represents, or 1 where sharing it once is enough. What a chunk
    costs is judged by how many texts at hand have it; that decides which chunks are taken, not what is found.
    """
    hashes, owners, shares = [], [], []
    short = np.array([len(t) < p.dense_below for t in texts])
    for dense, run, seed in ((True, p.run, 1), (False, p.wide, 2)):
        chosen = np.flatnonzero(short == dense)
        found = _heads([texts[i] for i in chosen], run, seed) if len(chosen) else None
        if found is None:
            continue
        _, number, held = np.unique(found.hashes, return_inverse=True, return_counts=True)
        held = held[number]
        if not dense:
            some = _rarest(found, held, p)
            hashes.append(found.hashes[some])
            owners.append(chosen[found.owner[some]])
            shares.append(found.windows[some] / found.n[found.owner[some]])
            continue
        first = np.searchsorted(found.owner, np.arange(len(chosen) + 1))
        for k, i in enumerate(chosen.tolist()):
            a, b = int(first[k]), int(first[k + 1])
            if a == b:
                continue
            at, size, n = found.at[a:b], found.windows[a:b], int(found.n[k])
            cost = np.zeros(n)
            cost[at] = held[a:b] - 1 + 0.001
            x, y = _stretch(cost, len(texts[i]), p)
            some = np.flatnonzero(np.minimum(at + size, y) > np.maximum(at, x))
            hashes.append(found.hashes[a:b][some])
            owners.append(np.full(len(some), i))
            shares.append(np.ones(len(some)))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(hashes), np.concatenate(owners), np.concatenate(shares)


def _whole(texts: Sequence[str]) -> np.ndarray:
    """One more chunk for each text, the text as a whole: equal texts meet by it, however short."""
    return np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 3) for t in texts], np.uint64)


#: Characters of texts handled at a time.
_AT_ONCE = 1_000_000
#: Chunks of a bucket, and pairs of chunks, held at a time.
_HELD, _EXPANDED = 1_000_000, 1_000_000
_BLOB = "bucket int, side int, hashes binary, owners binary, shares binary, numbers binary"


def _entries(texts: DataFrame, p: ChunkParams, sides: str) -> DataFrame:
    """The chunks of texts (``m``, ``text``), packed: for each bucket one row of sorted hashes from some thousand texts.

    Side 0 are chunks to be looked up, side 1 those that look up. Packed, some ten million chunks cost the shuffle and
    the JVM a few thousand rows; their arrays are joined by numpy, bucket by bucket.
    """

    def packed(side: int, numbers: np.ndarray, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, o, w = (np.concatenate([x[i] for x in parts]) for i in range(3))
        order = np.argsort(h, kind="stable")
        h, o, w = h[order], o[order].astype(np.uint32), w[order].astype(np.float32)
        cut = [0, *np.searchsorted((h >> np.uint64(32)) * np.uint64(p.buckets) >> np.uint64(32), np.arange(1, p.buckets)).tolist(), len(h)]
        some = [b for b in range(p.buckets) if cut[b] < cut[b + 1]]
        blob = lambda x: pa.array([x[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([side] * len(some), pa.int32()), blob(h), blob(o), blob(w), pa.array([numbers.tobytes()] * len(some), pa.binary())],
            ["bucket", "side", "hashes", "owners", "shares", "numbers"],
        )

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_numbers, all_texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            at = 0
            while at < len(all_texts):
                end, size = at, 0
                while end < len(all_texts) and size < _AT_ONCE:
                    size += len(all_texts[end])
                    end += 1
                numbers, texts_ = all_numbers[at:end].astype(np.int64), all_texts[at:end]
                at = end
                own, whole = np.arange(len(texts_)), _whole(texts_)
                if "A" in sides:
                    yield packed(0, numbers, [(whole, own, np.ones(len(own))), _index(texts_, p)])
                if "B" in sides:
                    parts = [(*_probes(texts_, run, seed), 0) for run, seed in ((p.run, 1), (p.wide, 2)) if run != p.run or "dense" in sides]
                    yield packed(1, numbers, [(whole, own, np.zeros(len(own))), *((h, o, np.zeros(len(h))) for h, o, _ in parts)])

    return texts.select("m", "text").mapInArrow(chunked, _BLOB)


def _side(table: pa.Table, side: int) -> list[tuple[np.ndarray, ...]]:
    """Sorted hashes, owners, shares and numbers of texts of each packed row of one side, without a copy."""
    out = []
    for batch in table.to_batches():
        sides, *blobs = (batch.column(c) for c in ("side", "hashes", "owners", "shares", "numbers"))
        for i in np.flatnonzero(sides.to_numpy(zero_copy_only=False) == side).tolist():
            out.append(tuple(np.frombuffer(x[i].as_buffer(), kind) for x, kind in zip(blobs, (np.uint64, np.uint32, np.float32, np.int64))))
    return out


def _slices(known: list[tuple[np.ndarray, ...]], new: list[tuple[np.ndarray, ...]]) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Hashes, numbers of texts and shares of both sides, range of hashes by range, some :data:`_HELD` chunks each."""
    every = [x[0] for x in known + new]
    if not known or not new:
        return
    low, high, n = min(int(h[0]) for h in every), max(int(h[-1]) for h in every), -(-sum(map(len, every)) // _HELD)
    bounds = np.array([low + (high - low) * i // n for i in range(1, n)], np.uint64)
    cuts = [[[0, *np.searchsorted(x[0], bounds).tolist(), len(x[0])] for x in side] for side in (known, new)]
    for i in range(n):
        both = []
        for side, cut in zip((known, new), cuts):
            parts = [(h[c[i] : c[i + 1]], m[o[c[i] : c[i + 1]]], w[c[i] : c[i + 1]]) for (h, o, w, m), c in zip(side, cut)]
            both.append(tuple(np.concatenate([x[j] for x in parts]) for j in range(3)))
        yield both


_MET = "a bigint, b bigint, share float, hidden bigint, own boolean"


def _met(known: pa.Table, new: pa.Table, leaders: int | None, own: bool = False) -> pa.Table:
    """The pairs of texts that share chunks of one bucket, with their shares summed within a range of hashes.

    With ``leaders``, a chunk of more texts to be looked up gives the lowest-numbered ones only, and each text that looks
    up gets a row that tells the lowest number it may have missed (``hidden``). ``own`` marks pairs within a batch.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("share", pa.float32()), ("hidden", pa.int64()), ("own", pa.bool_())])
    out = [schema.empty_table()]
    for (ah, an, aw), (bh, bn, _) in _slices(_side(known, 0), _side(new, 1)):
        order = np.lexsort((an, ah)) if leaders else np.argsort(ah, kind="stable")
        ah, an, aw = ah[order], an[order], aw[order]
        low = np.searchsorted(ah, bh, "left")
        n = np.searchsorted(ah, bh, "right") - low
        hidden_b, hidden_a = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if leaders:
            over = np.flatnonzero(n > leaders)
            if len(over):
                hidden_b, which = np.unique(bn[over], return_inverse=True)
                hidden_a = np.full(len(hidden_b), np.iinfo(np.int64).max)
                np.minimum.at(hidden_a, which, an[low[over] + leaders])
            n = np.minimum(n, leaders)
        hit = np.flatnonzero(n)
        low, n, bn = low[hit], n[hit], bn[hit]
        a_names, a_local = np.unique(an, return_inverse=True)
        b_names, b_local = np.unique(bn, return_inverse=True)
        ends, at = np.cumsum(n), 0
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _EXPANDED, "right")))
            k = n[at:end]
            entry = np.repeat(low[at:end] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            key, which = np.unique(a_local[entry].astype(np.int64) * len(b_names) + np.repeat(b_local[at:end], k), return_inverse=True)
            a, b, total = a_names[key // len(b_names)], b_names[key % len(b_names)], np.bincount(which, aw[entry])
            some = np.flatnonzero(a != b)
            out.append(pa.table([pa.array(a[some]), pa.array(b[some]), pa.array(total[some].astype(np.float32)), pa.nulls(len(some), pa.int64()), pa.repeat(own, len(some))], schema))
            at = end
        out.append(pa.table([pa.nulls(len(hidden_b), pa.int64()), pa.array(hidden_b), pa.repeat(pa.scalar(0, pa.float32()), len(hidden_b)), pa.array(hidden_a), pa.repeat(own, len(hidden_b))], schema))
    return pa.concat_tables(out)


class ChunkStore:
    """What has been accepted so far, in bucketed tables below ``path`` in the shared folder; each ingest adds files, none rewrites them.

    A manifest names what belongs to finished ingests and is swapped last, so that a broken-off ingest leaves nothing
    behind that counts; a store made at a path that has one goes on from there.
    """

    TABLES = {"index": (f"{_BLOB}, part string", "bucket"), "texts": ("m bigint, text string, part string", "m"), "ids": ("id string, n bigint, part string", "id")}

    def __init__(self, spark: SparkSession, path: str | None = None, params: ChunkParams = ChunkParams()):
        self.spark, self.path, self.p = spark, (path or fresh_path(spark, "chunks")).rstrip("/"), params
        self.name, self.stages = f"tidemill_{uuid.uuid4().hex}", []
        state = json.loads(published(spark, f"{self.path}/MANIFEST") or "{}")
        #: the finished ingests; whether a text to be looked up densely is among what they accepted
        self.parts, self.dense, buckets = state.get("parts", []), state.get("dense", False), state.get("buckets", params.buckets)
        if buckets != params.buckets:
            raise ValueError(f"the store at {self.path} has {buckets} buckets")
        for name, (schema, by) in self.TABLES.items():
            spark.sql(f"CREATE TABLE {self.name}_{name} ({schema}) USING parquet CLUSTERED BY ({by}) INTO {params.buckets} BUCKETS LOCATION '{self.path}/{name}'")

    def _kept(self, name: str) -> DataFrame:
        """A kept table, of the finished ingests only; it comes hash-partitioned by its bucket column, without a shuffle."""
        return self.spark.table(f"{self.name}_{name}").where(F.col("part").isin(self.parts) if self.parts else F.lit(False)).drop("part")

    def _append(self, name: str, df: DataFrame, part: str) -> None:
        schema, by = self.TABLES[name]
        rows = df.withColumn("part", F.lit(part)).select(*[c.split()[0] for c in schema.split(", ")])
        rows.repartition(self.p.buckets, by).write.format("parquet").mode("append").bucketBy(self.p.buckets, by).option("path", f"{self.path}/{name}").saveAsTable(f"{self.name}_{name}")

    def _stage(self, name: str, df: DataFrame, keep: bool = False) -> DataFrame:
        """Writes an intermediate result, so that later steps survive the loss of executors and don't repeat it."""
        return self._counted(name, df, keep=keep)[0]

    def _counted(self, name: str, df: DataFrame, keep: bool = False, **rows: Column) -> tuple[DataFrame, dict[str, int]]:
        """A written stage, and how many of its rows meet some conditions, counted as they are written."""
        at, seen = fresh_path(self.spark, name), Observation()
        (df.observe(seen, *[F.count_if(c).alias(k) for k, c in rows.items()]) if rows else df).write.parquet(at)
        if not keep:
            self.stages.append(at)
        return self.spark.read.schema(df.schema).parquet(at), seen.get if rows else {}

    def _clear(self) -> None:
        discard(self.spark, *self.stages)
        self.stages = []

    def _prepare(self, batch: DataFrame, number: str, key: str, text: str) -> tuple[DataFrame, DataFrame, bool]:
        """Rows (n, id, t), distinct texts (m, t, text), and whether one of them is looked up densely.

        ``t`` names a reduced text, null where there is none; ``m`` is the smallest number of its rows.
        """
        clean = F.pandas_udf(_prepared, "string").asNondeterministic()
        raw = batch.where(F.col(number).isNotNull()).select(F.col(number).cast("bigint").alias("n"), F.struct(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).alias("r"))
        rows = raw.groupBy("n").agg(F.first("r").alias("r")).select("n", "r.id", clean("r.text").alias("text"))
        rows = self._stage("rows", rows.withColumn("t", F.when(F.length("text") > 0, F.unhex(F.md5(F.col("text").cast("binary"))))))
        texts = rows.where("t IS NOT NULL").groupBy("t").agg(F.min("n").alias("m"), F.first("text").alias("text")).select("m", "t", "text")
        texts, n = self._counted("texts", texts, dense=self._dense())
        return rows.select("n", "id", "t"), texts, n["dense"] > 0

    def _dense(self) -> Column:
        return (F.length("text") < self.p.dense_below) & (F.length("text") >= self.p.run)

    @staticmethod
    def _numbered(rows: DataFrame, texts: DataFrame) -> DataFrame:
        """(m, t, text) of the texts of some rows; ``m`` is the smallest number of their rows."""
        return rows.where("t IS NOT NULL").groupBy("t").agg(F.min("n").alias("m")).join(texts.drop("m"), "t").select("m", "t", "text")

    def accept(self, batch: DataFrame, number: str, key: str, text: str) -> None:
        """Takes all rows of a batch as accepted history."""
        rows, texts, dense = self._prepare(batch, number, key, text)
        self._add(rows, texts.select("m", "text"), dense)
        self._clear()

    def _add(self, rows: DataFrame, texts: DataFrame, dense: bool) -> None:
        part = uuid.uuid4().hex
        self._append("texts", texts, part)
        self._append("index", _entries(texts, self.p, "A"), part)
        self._append("ids", rows.where("id IS NOT NULL").groupBy("id").agg(F.min("n").alias("n")), part)
        dense, parts = self.dense or dense, [*self.parts, part]
        publish(self.spark, f"{self.path}/MANIFEST", json.dumps({"parts": parts, "dense": dense, "buckets": self.p.buckets}))
        self.parts, self.dense = parts, dense

    def _meet(self, met: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Pairs (a, b, own) of texts that share enough chunks to be decided, (b, hidden) of texts that may have missed some, and how many."""
        totals = met.groupBy("a", "b", "own").agg(F.sum("share").alias("share"), F.min("hidden").alias("hidden"))
        enough = totals.where(F.col("a").isNull() | (F.col("share") >= self.p.wide_least * 0.999))
        pairs, n = self._counted("pairs", enough.select("a", "b", "own", "hidden"), hidden=F.col("a").isNull())
        return pairs.where("a IS NOT NULL").select("a", "b", "own"), pairs.where("a IS NULL").select("b", "hidden"), n["hidden"]

    def _decided(self, sides: Sequence[tuple[DataFrame, DataFrame]], new: DataFrame) -> DataFrame:
        """Of pairs (a, b), each with the texts in which to find ``a``, those (a, ta, tb) in which ``b`` keeps enough of ``a``; only the texts of such pairs are fetched."""
        run, kept = self.p.run, self.p.kept
        share = F.pandas_udf(lambda x, y: pd.Series([kept_share(s, t, run) for s, t in zip(x, y)]), "double").asNondeterministic()
        name = lambda known: F.col("t") if "t" in known.columns else F.lit(None).cast("binary")
        found = [known.select(F.col("m").alias("a"), F.col("text").alias("x"), name(known).alias("ta")).join(pairs.select("a", "b").hint("shuffle_hash"), "a") for pairs, known in sides]
        both = reduce(DataFrame.unionByName, found).join(new.select(F.col("m").alias("b"), F.col("text").alias("y"), F.col("t").alias("tb")), "b")
        return self._stage("links", both.where(share("x", "y") >= kept).select("a", "ta", "tb"))

    @staticmethod
    def _earliest(rows: DataFrame, accepted: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Adds to ``rows`` the smallest number, below its own, among ``accepted`` rows of the same id, the same text or a text it keeps."""
        by_id = accepted.where("id IS NOT NULL").groupBy("id").agg(F.min("n").alias("by_id"))
        of_text = accepted.where("t IS NOT NULL").groupBy("t").agg(F.min("n").alias("m"))
        linked = links.join(of_text.withColumnRenamed("t", "ta"), "ta").select(F.col("tb").alias("t"), "m").unionByName(of_text.select("t", "m"))
        by_text = linked.groupBy("t").agg(F.min("m").alias("by_text"))
        both = rows.join(by_id, "id", "left").join(by_text, "t", "left")
        earlier = lambda c: F.when(F.col(c) < F.col("n"), F.col(c))
        return both.withColumn(name, F.least(earlier("by_id"), earlier("by_text"))).drop("by_id", "by_text")

    def _links(self, known: DataFrame, rows: DataFrame, texts: DataFrame, leaders: int | None, dense: bool) -> tuple[DataFrame, DataFrame | None]:
        """(ta, tb) names of different texts of a batch, the second keeping enough of the first; (t, hidden) of texts that may have missed some."""
        to, by = self._stage("texts", self._numbered(known, texts)), self._stage("texts", self._numbered(rows, texts))
        entries = _entries(to, self.p, "A").unionByName(_entries(by, self.p, "B dense" if dense else "B"))
        pairs, hidden, n = self._meet(entries.groupBy("bucket").applyInArrow(lambda x: _met(x, x, leaders, True), _MET))
        links = self._decided([(pairs, to)], by).where("ta != tb").select("ta", "tb")
        return links, by.join(hidden, by["m"] == hidden["b"]).select("t", "hidden") if n else None

    def ingest(self, batch: DataFrame, number: str, key: str, text: str) -> DataFrame:
        """Holds a batch against all accepted rows and its own earlier ones; accepts what repeats nothing.

        Gives (``first_no``, ``n``): each row that repeats an accepted one, with the earliest accepted row it repeats.
        A row repeats by an equal non-null key or by keeping enough of an accepted text. Null keys match nothing; null
        and empty texts, and those without a letter or digit, match nothing by text; texts shorter than a run must be
        equal; rows with a null number take no part and a repeated number counts once; long texts are taken whole; an
        empty batch gives no rows. Numbers grow with arrival: those of a batch are above those accepted before.

        The batch is looked up in the history and in itself at once. Within the batch only the first few texts that share
        a chunk are looked at in a round. Those that repeat nothing are accepted, their copies drop out, and what may have
        missed an earlier text goes on to the next round, so that a group of near copies is held against its first
        members instead of all against all.
        """
        leaders = self.p.leaders
        rows, texts, dense = self._prepare(batch, number, key, text)
        entries = _entries(texts, self.p, "A B dense" if self.dense or dense else "A B")
        both = lambda x, y: pa.concat_tables([_met(x, y, None), _met(y, y, leaders, True)])
        pairs, hidden, n_hidden = self._meet(self._kept("index").groupBy("bucket").cogroup(entries.groupBy("bucket")).applyInArrow(both, _MET))
        found = self._decided([(pairs.where("NOT own"), self._kept("texts")), (pairs.where("own"), texts)], texts)

        of_text = found.where("ta IS NULL").groupBy(F.col("tb").alias("t")).agg(F.min("a").alias("by_text"))
        ids = rows.where("id IS NOT NULL").select("id").distinct()
        of_id = self._kept("ids").join(ids.hint("shuffle_hash"), "id").groupBy("id").agg(F.min("n").alias("by_id"))
        first = rows.join(of_text, "t", "left").join(of_id, "id", "left").select("n", "id", "t", F.least("by_text", "by_id").alias("first_no"))
        first, n = self._counted("first", first, left=F.col("first_no").isNull())

        mine = ["n", "id", "t"]
        left = first.where("first_no IS NULL").select(*mine)
        links = found.where("ta != tb").select("ta", "tb")
        hidden = texts.join(hidden, texts["m"] == hidden["b"]).select("t", "hidden") if n_hidden else None
        undecided, n_open, taken, missed = left, n["left"], left.limit(0), n_hidden > 0
        while n_open:
            n_now, least = 1, hidden.groupBy("t").agg(F.min("hidden").alias("hidden")) if hidden is not None else None
            while n_open and n_now:
                # accepted are rows without an earlier undecided one that they repeat, or might repeat unseen
                round_ = self._earliest(undecided, undecided, links, "open")
                if least is not None:
                    round_ = round_.join(least, "t", "left").withColumn("open", F.least("open", F.when(F.col("hidden") < F.col("n"), F.col("hidden"))))
                round_, n = self._counted("round", round_.select(*mine, "open"), now=F.col("open").isNull(), open=F.col("open").isNotNull())
                now, n_now, n_open = round_.where("open IS NULL").select(*mine), n["now"], n["open"]
                taken = taken.unionByName(now)
                if n_open and n_now:
                    rest = self._earliest(round_.where("open IS NOT NULL").select(*mine), now, links, "hit").where("hit IS NULL")
                    undecided, n = self._counted("undecided", rest.select(*mine), open=F.lit(True))
                    n_open = n["open"]
            if n_open:
                leaders *= 8
                more, hidden = self._links(undecided.unionByName(taken), undecided, texts, leaders, dense)
                links, missed = links.unionByName(more), missed or hidden is not None
        again = left.join(taken.select("n"), "n", "left_anti")
        if missed:
            links, _ = self._links(taken, again, texts, None, dense)
        late = self._earliest(again, taken, links, "first_no")
        out = self._stage("found", first.where("first_no IS NOT NULL").select("first_no", "n").unionByName(late.select("first_no", "n")), keep=True)
        accepted, n = self._counted("accepted-texts", self._numbered(taken, texts).select("m", "text"), dense=self._dense())
        self._add(taken, accepted, n["dense"] > 0)
        self._clear()
        return out
