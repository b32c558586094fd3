"""Vector codes by product quantisation, with assignments pruned by norm-of-sum bounds.

Every part position has a codebook, refined by rounds of assignment and averaging on integers, so
the result does not depend on how the rows are dealt. A part is scanned against a whole codebook
once. From then on it carries, for groups of entries, a lower bound of the distance to the group's
other entries and the round in which that bound was taken. The codebooks of all rounds are kept:
an entry has moved from round s to round t by the norm of the sum of its steps, which is its true
net displacement and never more than the sum of the steps' norms. A group whose bound, less its
entries' largest net displacement since the stamp, stays above the distance to the own entry holds
no nearer one. Only the other groups are scanned again, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerpitch.llm.common import arrow_map, durable
from ledgerpitch.session import max_broadcast_rows

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Groups of entries that share one bound.
GROUPS = 4
#: Components beyond this do not keep squared distances in 64 bits.
LARGEST = 1 << 24
#: What a bound gives up so that rounding never makes it too high.
SLACK = 1e-6


class Assigner:
    """Assigns parts to codebooks, given the codebooks of all rounds so far.

    ``history`` is [round][part][entry][component]. ``scanned`` counts the exact distances taken.
    """

    def __init__(self, history: Sequence[np.ndarray], groups: int = GROUPS):
        self.history = [np.asarray(book, np.int64) for book in history]
        self.now = len(self.history) - 1
        entries = self.history[0].shape[1]
        self.members = [m for m in np.array_split(np.arange(entries), groups) if len(m)]
        self.group_of = np.concatenate([np.full(len(m), g) for g, m in enumerate(self.members)])
        self.scanned = 0
        # [stamp][part][group]: the largest net displacement of the group's entries since the stamp.
        latest = self.history[-1]
        moved = [np.sqrt(((latest - book).astype(np.float64) ** 2).sum(-1)) for book in self.history]
        self.moved = np.array([[[m[p, own].max() for own in self.members] for p in range(latest.shape[0])] for m in moved])

    def _distances(self, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
        self.scanned += len(rows) * len(entries)
        return ((rows[:, None, :] - entries[None]) ** 2).sum(-1)

    def first(self, part: int, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Entry, squared distance, bounds and stamps of rows that were never scanned."""
        every = self._distances(rows, self.history[-1][part])
        code = every.argmin(1)
        at = np.arange(len(rows))
        own = every[at, code]
        every[at, code] = np.iinfo(np.int64).max
        low = np.stack([self._floor(every[:, m].min(1)) for m in self.members], 1)
        return code, own, low, np.full(low.shape, self.now, np.uint8)

    def again(self, part: int, rows: np.ndarray, code: np.ndarray, low: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same after the codebooks moved; equals a whole scan."""
        book = self.history[-1][part]
        old = code.astype(np.int64)
        own = ((rows - book[old]) ** 2).sum(1)
        self.scanned += len(rows)
        groups = np.arange(len(self.members))
        bound = low.astype(np.float64) - self.moved[stamp, part, groups]
        open_ = bound * (1 - SLACK) <= np.sqrt(own)[:, None]
        best, near = old.copy(), own.copy()
        low, stamp = low.copy(), stamp.copy()
        found = []
        for g, members in enumerate(self.members):
            at = np.flatnonzero(open_[:, g])
            if not len(at):
                continue
            exact = self._distances(rows[at], book[members])
            least = exact.argmin(1)
            distance, entry = exact[np.arange(len(at)), least], members[least]
            better = (distance < near[at]) | ((distance == near[at]) & (entry < best[at]))
            near[at[better]], best[at[better]] = distance[better], entry[better]
            found.append((g, at, exact))
        for g, at, exact in found:
            mine = self.group_of[best[at]] == g
            exact[np.flatnonzero(mine), best[at][mine] - self.members[g][0]] = np.iinfo(np.int64).max
            low[at, g], stamp[at, g] = self._floor(exact.min(1)), self.now
        # An entry that was left is among its group's other entries from now on.
        left = np.flatnonzero(best != old)
        g = self.group_of[old[left]]
        kept = ~open_[left, g]
        left, g = left[kept], g[kept]
        low[left, g] = np.minimum(np.maximum(bound[left, g], 0) * (1 - SLACK), self._floor(own[left]))
        stamp[left, g] = self.now
        return best, near, low, stamp

    @staticmethod
    def _floor(squares: np.ndarray) -> np.ndarray:
        return (np.sqrt(squares.astype(np.float64)) * (1 - SLACK)).astype(np.float32)


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    """Components floor(SCALE * x) by row."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != dims).any():
        raise ValueError(f"a vector has {lengths[lengths != dims][0]} components, the least id's has {dims}")
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}")
    return scaled.astype(np.int64).reshape(-1, dims)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a two-dimensional array as bytes."""
    rows = np.ascontiguousarray(rows)
    kind = pa.binary(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(kind, len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _unpacked(column: pa.Array, dtype: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, *shape)


STATE = "vec_id {id}, label {label}, vector array<long>, codes binary, low binary, stamps binary, error long"


def _assigned(rows: DataFrame, history: list[np.ndarray], dims: int, kinds: dict[str, str]) -> DataFrame:
    """Rows with their entries, bounds and stamps after a pass against the newest codebooks."""
    width = dims // PARTS
    groups = min(GROUPS, history[0].shape[1])
    fresh = "vector" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        assigner = Assigner(history, groups)
        for batch in batches:
            if fresh:
                vectors = _integers(batch.column("embedding"), dims)
                state = None
            else:
                vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                state = (
                    _unpacked(batch.column("codes"), np.uint8, (PARTS,)),
                    _unpacked(batch.column("low"), np.float32, (PARTS, groups)),
                    _unpacked(batch.column("stamps"), np.uint8, (PARTS, groups)),
                )
            n = len(vectors)
            codes, errors = np.empty((n, PARTS), np.uint8), np.zeros(n, np.int64)
            low, stamps = np.empty((n, PARTS, groups), np.float32), np.empty((n, PARTS, groups), np.uint8)
            for p in range(PARTS):
                part = vectors[:, p * width : (p + 1) * width]
                known = () if state is None else tuple(s[:, p] for s in state)
                code, near, bound, stamp = assigner.again(p, part, *known) if known else assigner.first(p, part)
                codes[:, p], low[:, p], stamps[:, p] = code, bound, stamp
                errors += near
            yield {
                "vec_id": batch.column("vec_id"),
                "label": batch.column("label"),
                "vector": pa.ListArray.from_arrays(np.arange(0, n * dims + 1, dims, dtype=np.int32), vectors.ravel()),
                "codes": _binary(codes),
                "low": _binary(low.reshape(n, -1)),
                "stamps": _binary(stamps.reshape(n, -1)),
                "error": errors,
            }

    return arrow_map(rows, run, STATE.format(**kinds))


def _averaged(state: DataFrame, book: np.ndarray, dims: int) -> np.ndarray:
    """Entries replaced by the floored means of their parts; unused ones stay.

    Every task sums its rows by (part, entry) before anything moves; the driver gets the codebooks.
    """
    entries, width = book.shape[1], dims // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums = np.zeros((PARTS, entries, width), np.int64)
        counts = np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            codes = _unpacked(batch.column("codes"), np.uint8, (PARTS,))
            for p in range(PARTS):
                np.add.at(sums[p], codes[:, p], vectors[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        yield {"part": part, "entry": entry, "count": counts[part, entry], "sums": sums[part, entry].tolist()}

    partial = arrow_map(state.select("vector", "codes"), run, "part int, entry int, count long, sums array<long>")
    totals = (
        partial.select("part", "entry", "count", F.posexplode("sums").alias("at", "value"))
        .groupBy("part", "entry", "at")
        .agg(F.sum("count").alias("count"), F.sum("value").alias("value"))
    )
    moved = book.copy()
    for r in totals.collect():
        moved[r["part"], r["entry"], r["at"]] = r["value"] // r["count"]
    return moved


def vector_codes(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Codes, errors and the codebooks' digest for every usable row of ``embeddings``.

    Returns vec_id, code (two hex digits a part), error, label_error and codebooks_sha256. Rows
    whose vector is null or holds a null, NaN or infinite component are left out. Vectors must have
    one common length that is a multiple of 16, and components within 65,536 either way: otherwise
    a ValueError says so. Fewer than 64 rows make fewer entries. The codebooks start from the rows
    of least vec_id, nulls last, equal ids by vector; repeated rows count as often as they occur.
    Rows with a null label share one label_error. An empty table gives no rows. Other columns are
    ignored.
    """
    spark = embeddings.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select("vec_id", "label", "embedding").filter(F.col("embedding").isNotNull() & finite)
    kinds = {"id": rows.schema["vec_id"].dataType.simpleString(), "label": rows.schema["label"].dataType.simpleString()}
    start = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    out = f"vec_id {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string"
    if not start:
        return spark.createDataFrame([], out)
    dims = len(start[0]["embedding"])
    if not dims or dims % PARTS:
        raise ValueError(f"{dims} components are not {PARTS} equal parts")
    first = _integers(pa.array([r["embedding"] for r in start], pa.list_(pa.float64())), dims)
    history = [np.ascontiguousarray(first.reshape(len(start), PARTS, dims // PARTS).transpose(1, 0, 2))]
    state = durable(_assigned(rows, history, dims, kinds))
    for _ in range(rounds):
        history.append(_averaged(state, history[-1], dims))
        state = durable(_assigned(state, history, dims, kinds))
    digest = hashlib.sha256(",".join(map(str, history[-1].ravel().tolist())).encode()).hexdigest()
    totals = durable(state.groupBy("label").agg(F.sum("error").alias("label_error")))
    if totals.count() <= max_broadcast_rows(spark):
        totals = F.broadcast(totals)
    coded = state.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error")
    totals = totals.withColumnRenamed("label", "_label")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
