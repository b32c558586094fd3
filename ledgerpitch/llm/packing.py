"""Best-fit packing after Martello-Toth dominance reduction.

Documents are encoded and cut into pieces of at most one sequence. Pieces of one length are
interchangeable, so the instance is the histogram of lengths, which has no more rows than a
sequence has tokens, however many documents there are. On it, small sets that provably dominate
every other way to use their longest piece are fixed, all copies at once:

* a piece that nothing else fits beside,
* a pair that fills a sequence, or the longest partner where no two pieces fit beside the first,
* a triple of the two longest partners where no three fit and every other pair is no longer,
  piece by piece.

The shrunken rest is packed best-fit in decreasing length. The plan says which ranks of which
length go to which sequences; each piece finds its place by its rank within its length.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerpitch.llm import byte_bpe
from ledgerpitch.llm.common import arrow_map, durable
from ledgerpitch.plans.blocks import attach

TOKENIZER_FILE = "byte_bpe_50k.json"
CAPACITY = 1024
#: Chunks and words a worker remembers with their ids; about 250 bytes each.
CACHE_CHUNKS, CACHE_WORDS = 700_000, 200_000
END_ID = 2
_RANK_BITS = 48


@dataclass
class Plan:
    """Runs of (length, first rank, copies per sequence, first sequence, offset), and the totals."""

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0
    used: dict[int, int] = field(default_factory=dict)

    def place(self, length: int, sequences: int, per_sequence: int, first: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.runs.append((length, rank, per_sequence, first, offset))
        self.used[length] = rank + sequences * per_sequence


class _Stock:
    """Pieces left, by length."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: n for k, n in counts.items() if n > 0}
        self.lengths = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)

    def longest(self, room: int, without: tuple[int, ...]) -> int | None:
        """The longest piece of at most ``room`` tokens besides the pieces ``without``."""
        at = bisect_right(self.lengths, room)
        while at:
            at -= 1
            length = self.lengths[at]
            if self.counts[length] > without.count(length):
                return length
        return None

    def smallest(self, n: int, without: int) -> list[int]:
        found: list[int] = []
        for length in self.lengths:
            free = self.counts[length] - (length == without)
            found += [length] * min(free, n - len(found))
            if len(found) == n:
                break
        return found


def dominating_set(stock: _Stock, length: int, capacity: int) -> tuple[int, ...] | None:
    """A set with a piece of ``length`` that dominates every feasible set with it, or None."""
    room = capacity - length
    partner = stock.longest(room, (length,))
    if partner is None:
        return (length,)
    small = stock.smallest(3, length)
    if partner == room or len(small) < 2 or small[0] + small[1] > room:
        return (length, partner)
    if len(small) == 3 and sum(small) <= room:
        return None
    third = stock.longest(room - partner, (length, partner))
    # The shorter of two partners is at most half the room.
    half = stock.longest(room // 2, (length,))
    if third is not None and (half is None or third >= half):
        return (length, partner, third)
    return None


def reduce_instance(stock: _Stock, capacity: int, plan: Plan) -> None:
    """Fix dominating sets until none is left."""
    changed = True
    while changed:
        changed = False
        for length in sorted(stock.lengths, reverse=True):
            while length in stock.counts and (best := dominating_set(stock, length, capacity)):
                copies = min(stock.counts[k] // best.count(k) for k in best)
                offset = 0
                for k in best:
                    plan.place(k, copies, 1, plan.sequences, offset)
                    stock.take(k, copies)
                    offset += k
                plan.sequences += copies
                plan.fixed += copies
                changed = True


def best_fit(stock: _Stock, capacity: int, plan: Plan) -> None:
    """Best-fit decreasing; equal sequences are kept as one range, so the work is by lengths."""
    open_ranges: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_ranges:
                rooms.insert(bisect_right(rooms, room), room)
            open_ranges.setdefault(room, []).append((first, n))

    for length in sorted(stock.lengths, reverse=True):
        left = stock.counts[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                per = capacity // length
                n, room = -(-left // per), capacity
                first = plan.sequences
                plan.sequences += n
            else:
                room = rooms[at]
                first, n = open_ranges[room].pop()
                if not open_ranges[room]:
                    del open_ranges[room]
                    rooms.pop(at)
                per = room // length
            full = min(n, left // per)
            if full:
                plan.place(length, full, per, first, capacity - room)
                put(room - per * length, first, full)
            left -= full * per
            rest = n - full
            if rest and left:
                plan.place(length, 1, left, first + full, capacity - room)
                put(room - left * length, first + full, 1)
                left, rest, full = 0, rest - 1, full + 1
            put(room, first + full, rest)
    stock.counts.clear()
    stock.lengths.clear()


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Places for ``counts`` pieces of each length; its size depends on ``capacity`` alone."""
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    plan, stock = Plan(), _Stock(counts)
    reduce_instance(stock, capacity, plan)
    best_fit(stock, capacity, plan)
    return plan


class Encoder:
    """Token ids as little-endian 32-bit bytes, chunks between blanks encoded once."""

    def __init__(self, path: str):
        self.tokenizer = byte_bpe.load(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}
        self.chunks = byte_bpe.Chunks(byte_bpe.specials(self.tokenizer), self._encode, CACHE_CHUNKS)

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts; simple words go to the BPE model alone, behind the steps that split texts."""
        out: list = [None] * len(texts)
        other: list[int] = []
        for at, text in enumerate(texts):
            simple = byte_bpe.SIMPLE.match(text)
            if simple is None:
                other.append(at)
            elif simple[2]:
                out[at] = self._word(simple[1]) + self._word(simple[2])
            else:
                out[at] = self._word(text)
        found = self.tokenizer.encode_batch_fast([texts[at] for at in other], add_special_tokens=False)
        for at, encoding in zip(other, found, strict=True):
            out[at] = array("I", encoding.ids).tobytes()
        return out

    def _word(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is None:
            known = array("I", [token.id for token in self.tokenize(byte_bpe.in_letters(word))]).tobytes()
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            self.words[word] = known
        return known

    def ids(self, text: str) -> bytes:
        if self.chunks.can_cut(text):
            return b"".join(self.chunks.of(text))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    """One encoder per worker process, so that tasks share what earlier ones have learnt."""
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; a shorter piece comes first."""
    head = n % capacity
    starts = ([(0, head)] if head else []) + [(at, capacity) for at in range(head, n, capacity)]
    return starts


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_file: str = TOKENIZER_FILE,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Encoded pieces with their task and their rank among the task's pieces of that length.

    A null text is the empty one, a single piece of the end token. Every row has pieces of its own,
    also rows with null or repeated ids; an empty table gives none.
    """
    path = public_tokenizers.path(tokenizer_file)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    end = array("I", [end_id]).tobytes()
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "rank", "ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, seen = encoder_for(path), [0] * (capacity + 1)
        task = TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = memoryview(encoder.ids(text.as_py()) + end)
                for number, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    own = data[4 * start : 4 * (start + length)]
                    out.append((doc, number, start, length, zlib.crc32(own), seen[length], bytes(own) if with_ids else b""))
                    seen[length] += 1
            if out:
                columns = dict(zip(names, zip(*out, strict=True), strict=True))
                if not with_ids:
                    del columns["ids"]
                yield columns | {"task": [task] * len(out)}

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rank long, task int"
    return arrow_map(rows, encode, schema + (", ids binary" if with_ids else ""))


def pack_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_file: str = TOKENIZER_FILE,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A null text is the empty one, which still has the end id. Rows with null or repeated ids are
    packed like any others; other columns are not carried. An empty table gives no rows. Texts are
    encoded once; the pieces are written, so ranks stay the same if a task runs again. What comes
    to the driver is one row per length, at most ``capacity`` of them. ``with_ids`` adds the ids.
    """
    held = durable(pieces(docs, capacity, id_col, text_col, tokenizer_file, end_id, with_ids))
    sizes = durable(held.groupBy("task", "length").agg(F.count("*").alias("n")))
    # One row per length: bounded by the capacity.
    plan = make_plan({r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = attach(held, offsets, ["task", "length"], sizes.count())
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    keys = (runs[:, 0] << _RANK_BITS) + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            length = columns["length"].to_numpy()
            rank = columns.pop("rank").to_numpy() + columns.pop("earlier").to_numpy()
            run = runs[np.searchsorted(keys, (length << _RANK_BITS) + rank, "right") - 1]
            nth = rank - run[:, 1]
            yield columns | {
                "sequence_id": run[:, 3] + nth // run[:, 2],
                "offset": run[:, 4] + nth % run[:, 2] * length,
            }

    kind = held.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    wanted = [c for c in ranked.columns if c != "task"]
    return arrow_map(ranked.select(*wanted), place, schema + (", ids binary" if with_ids else ""))
