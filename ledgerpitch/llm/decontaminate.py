"""Benchmark decontamination by SimHash windows and exact verification.

A window of as many words as a benchmark item has gets a 64-bit SimHash of its five-word shingles,
weighted by how often each stands in the window. Fingerprints are cut into eight blocks; two that
differ in at most 20 bits agree in some block up to two bits, so probing every block within two
bits finds all item fingerprints within the radius. Candidates are verified by the generalised
Jaccard similarity of the shingle weights, sum(min) / sum(max) >= 0.8.

A window without any shingle of the benchmark has similarity 0, so it is not fingerprinted; this
loses nothing and leaves few windows of most documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerpitch.llm.common import arrow_map
from ledgerpitch.llm.shingles import WIDTH, WordHashes, shingle_hashes

SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 64, 8, 20
_FLIPS = RADIUS // BLOCKS
_BLOCK_BITS = BITS // BLOCKS
#: Benchmark text that one pass over the documents looks for; a larger benchmark takes several.
PASS_BYTES = 32 << 20
_PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_FOLD = bytes.maketrans(
    bytes(range(65, 91)) + _PUNCTUATION, bytes(range(97, 123)) + b" " * len(_PUNCTUATION)
)


def plain_words(text: str) -> list[bytes]:
    """Words with A-Z in lower case and ASCII punctuation as blanks."""
    return text.encode().translate(_FOLD).split()


def bit_counts(shingles: np.ndarray) -> np.ndarray:
    """Running counts of ones by bit, one row more than there are shingles."""
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def simhashes(counts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` shingles, as eight bytes each."""
    ones = counts[size:] - counts[:-size]
    return np.packbits(2 * ones > size, axis=1)


def _neighbourhood() -> np.ndarray:
    """Byte masks with at most the flips that a block is probed with."""
    return np.array(
        [sum(1 << b for b in flips) for n in range(_FLIPS + 1) for flips in combinations(range(_BLOCK_BITS), n)],
        np.uint8,
    )


def similarity(window: Counter, item: Counter) -> float:
    shared = sum((window & item).values())
    return shared / (window.total() + item.total() - shared)


@dataclass
class SizeIndex:
    """Items of one number of words: fingerprints, shingle weights and the block tables."""

    words: int
    shingles: int
    items: list[list[int]] = field(default_factory=list)
    weights: list[Counter] = field(default_factory=list)
    prints: np.ndarray | None = None
    tables: np.ndarray | None = None

    def finish(self, prints: list[np.ndarray]) -> None:
        self.prints = np.stack(prints)
        # tables[block, value] marks the items with a block within the flips of the value.
        self.tables = np.zeros((BLOCKS, 1 << _BLOCK_BITS, len(prints)), bool)
        masks = _neighbourhood()
        for at, own in enumerate(prints):
            for block in range(BLOCKS):
                self.tables[block, own[block] ^ masks, at] = True

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius."""
        found = np.zeros((len(prints), len(self.items)), bool)
        for block in range(BLOCKS):
            found |= self.tables[block, prints[:, block]]
        window, item = np.nonzero(found)
        distance = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1)
        near = distance <= RADIUS
        return window[near], item[near], distance[near]


@dataclass
class Benchmark:
    """The index of one pass; ``known`` holds every shingle of its items in order."""

    sizes: list[SizeIndex]
    known: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int | None, str | None]]) -> Benchmark:
        hashes = WordHashes()
        texts: dict[tuple[bytes, ...], list[int]] = {}
        for item, text in items:
            if words := plain_words(text or ""):
                texts.setdefault(tuple(words), []).append(item)
        sizes: dict[int, SizeIndex] = {}
        prints: dict[int, list[np.ndarray]] = {}
        known = [np.zeros(0, np.uint64)]
        for words, ids in texts.items():
            shingles = shingle_hashes(hashes.of(list(words)))
            index = sizes.setdefault(len(words), SizeIndex(len(words), len(shingles)))
            index.items.append(ids)
            index.weights.append(Counter(shingles.tolist()))
            prints.setdefault(len(words), []).append(simhashes(bit_counts(shingles), len(shingles))[0])
            known.append(shingles)
        for words, index in sizes.items():
            index.finish(prints[words])
        return cls(list(sizes.values()), np.unique(np.concatenate(known)))

    def matches(self, hashes: np.ndarray, least: float) -> list[tuple[int, int, int, float, int]]:
        """(item, first word, words, similarity, distance) of the best window for each item found."""
        best: dict[int, tuple] = {}
        if not len(self.known):
            return []
        if len(hashes) < WIDTH:
            shingles, short = shingle_hashes(hashes), True
        else:
            shingles, short = shingle_hashes(hashes), False
        self._search(shingles, [s for s in self.sizes if s.words >= WIDTH or short], len(hashes), least, best)
        if not short:
            # Items of fewer words than a shingle are one shingle of their own length.
            for index in self.sizes:
                if index.words < WIDTH:
                    self._search(shingle_hashes(hashes, index.words), [index], len(hashes), least, best)
        return [(item, *row) for item, row in best.items()]

    def _search(self, shingles: np.ndarray, sizes: list[SizeIndex], words: int, least: float, best: dict) -> None:
        if not sizes or not len(shingles):
            return
        places = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        hits = np.flatnonzero(self.known[places] == shingles)
        if not len(hits):
            return
        reach = max(s.shingles for s in sizes)
        # Regions around hits; windows further away hold no shingle of the benchmark.
        breaks = np.flatnonzero(np.diff(hits) > 2 * reach)
        for first, last in zip(hits[np.r_[0, breaks + 1]], hits[np.r_[breaks, len(hits) - 1]], strict=True):
            low, high = max(0, int(first) - reach), min(len(shingles), int(last) + reach + 1)
            region = shingles[low:high]
            counts = bit_counts(region)
            hit = np.zeros(len(region) + 1, np.int64)
            hit[1:] = np.cumsum(np.isin(np.arange(low, high), hits, assume_unique=True))
            for index in sizes:
                size = min(index.shingles, len(region))
                starts = np.flatnonzero(hit[size:] > hit[:-size])
                prints = simhashes(counts, size)[starts]
                for window, item, distance in zip(*index.within(prints), strict=True):
                    start = int(starts[window])
                    alike = similarity(Counter(region[start : start + size].tolist()), index.weights[item])
                    if alike < least:
                        continue
                    row = (low + start, min(index.words, words), alike, int(distance))
                    for found in index.items[item]:
                        if found not in best or (alike, -row[0]) > (best[found][2], -best[found][0]):
                            best[found] = row


def _passes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark in slices of at most about ``PASS_BYTES``, which come to the driver one by one."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // PASS_BYTES)
    for at in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == at)
        yield [(r["item"], r["text"]) for r in part.collect()]


FOUND = "doc_id long, item_id long, first_word long, n_words long, similarity double, distance int"


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity, distance), the best window for each pair.

    Only documents that hold an item have rows. A document of fewer words than an item is one
    window. Null and empty texts, of documents or items, match nothing; items with equal words are
    all reported; repeated rows are reported each. An empty benchmark or table gives no rows. Other
    columns are not carried. Ties go to the earliest window.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ("item_id", "first_word", "n_words", "similarity", "distance")
    out = rows.sparkSession.createDataFrame([], FOUND)
    for items in _passes(benchmark, item_col, item_text_col):
        index = rows.sparkSession.sparkContext.broadcast(Benchmark.build(items))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[dict]:
            hashes = WordHashes()
            for batch in batches:
                found = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    for row in index.value.matches(hashes.of(plain_words(text.as_py() or "")), least):
                        found.append((doc, *row))
                if found:
                    yield dict(zip(("doc_id", *names), zip(*found, strict=True), strict=True))

        out = out.unionByName(arrow_map(rows, search, FOUND))
    return out


def without_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = SIMILARITY,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no benchmark item.

    A null or empty text holds none, so its row stays. Rows are judged one by one, so repeated rows
    and null ids do not matter; texts of any length are read whole. An empty benchmark keeps every
    row, an empty table gives no rows.
    """
    for items in _passes(benchmark, item_col, item_text_col):
        index = docs.sparkSession.sparkContext.broadcast(Benchmark.build(items))

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[dict]:
            hashes = WordHashes()
            for batch in batches:
                clean = [
                    not index.value.matches(hashes.of(plain_words(text.as_py() or "")), least)
                    for text in batch.column(text_col)
                ]
                kept = batch.filter(pa.array(clean, pa.bool_()))
                yield {name: kept.column(name) for name in kept.schema.names}

        docs = arrow_map(docs, keep, docs.schema)
    return docs
