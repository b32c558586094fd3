"""Document fingerprints by consistent weighted sampling.

A text is a bag of words, the weight of a word is how often it stands there. For each of the
samples k and each word, hashing gives r and c from Gamma(2, 1) and b from the unit interval; with

    t = floor(ln(weight) / r + b),    a = c * exp(-r * (t - b)) * exp(-r)

the sample is the pair (word, t) of least a. Two texts have the same sample with a chance equal to
their generalised Jaccard similarity, sum(min) / sum(max) over the words' weights. A fingerprint
holds a 16-bit hash of each sample, and the likeness of two is the share of samples that agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerpitch.llm.common import arrow_map, mb_partitions
from ledgerpitch.llm.shingles import WordHashes, finish, words_of

SAMPLES = 128
#: (word, weight) pairs whose samples a worker remembers.
CACHE_ROWS = 150_000
#: Distinct words whose samples are compared at once.
BLOCK_ROWS = 8192
#: Words of several texts whose samples are drawn together; no more than are remembered.
GROUP_PAIRS = 30_000
#: Pairs drawn at once, so that their numbers stay in the processor's caches.
DRAWN = 128
#: Id ranges for each partition; they are dealt by hash, so several even out.
RANGES_EACH = 3
_STREAMS = finish(np.arange(1, 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MASK = np.uint64((1 << 23) - 1)
#: What a weight adds to the hash of a word to make the key of the pair.
_WEIGHT_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Keys, hashes and weights of a text's words.
Bag = tuple[np.ndarray, np.ndarray, np.ndarray]


def _unit(bits: np.ndarray) -> np.ndarray:
    """23-bit numbers as uniform numbers between 0 and 1, ends excluded."""
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23)


def _gamma(bits: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) from the upper 48 bits."""
    return -np.log(_unit(bits >> np.uint64(41)) * _unit(bits >> np.uint64(16) & _MASK))


class Sampler:
    """Fingerprints under a fixed number of samples.

    The costs of a (word, weight) pair are remembered; a code is worked out only for the pair that
    wins a sample. Of equal costs the pair with the lower hash wins, whatever the order of words.
    """

    def __init__(self, samples: int = SAMPLES, rows: int = CACHE_ROWS):
        self.samples = samples
        self.costs = np.empty((rows, samples), np.float32)
        self.places: dict[int, int] = {}
        self.hashes = WordHashes()
        self.offsets = finish(np.arange(samples, dtype=np.uint64) + np.uint64(0xA0761D6478BD642F))

    def _draw(self, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """ln a for each pair of a word's hash and a weight, and each sample.

        Two hashes give five uniform numbers: two of 23 bits each, and b from the 16 bits left.
        """
        mixed = words[:, None] ^ self.offsets[None, :]
        one, two = finish(mixed + _STREAMS[0]), finish(mixed + _STREAMS[1])
        r, c = _gamma(one), _gamma(two)
        b = (one & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
        cost = np.log(c) - r + r * b
        heavy = np.flatnonzero(weights > 1)
        if len(heavy):
            # At weight 1 the logarithm is 0, so t is floor(b) = 0.
            cost[heavy] -= r[heavy] * self._level(weights[heavy][:, None], r[heavy], b[heavy])
        return cost

    @staticmethod
    def _level(weights: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.floor(np.log(weights.astype(np.float32)) / r + b)

    def _codes(self, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """16-bit codes of (word, t) of the pairs that won the samples, in order of the samples."""
        mixed = words ^ self.offsets
        one = finish(mixed + _STREAMS[0])
        t = np.zeros(self.samples, np.uint64)
        heavy = np.flatnonzero(weights > 1)
        if len(heavy):
            own = one[heavy]
            b = (own & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
            t[heavy] = self._level(weights[heavy], _gamma(own), b).astype(np.int64).astype(np.uint64)
        return (finish((mixed ^ one) + t) >> np.uint64(48)).astype(np.uint16)

    def _learn(self, bags: list[Bag]) -> None:
        """Remember every pair of the bags, all missing ones at once."""
        keys, words, weights = (np.concatenate([bag[k] for bag in bags]) for k in range(3))
        keys, first = np.unique(keys, return_index=True)
        listed = keys.tolist()
        new = np.array([k for k, key in enumerate(listed) if key not in self.places], np.int64)
        if len(self.places) + len(new) > len(self.costs):
            self.places.clear()
            new = np.arange(len(listed))
        start = len(self.places)
        at = first[new]
        for k in range(0, len(new), DRAWN):
            part = at[k : k + DRAWN]
            self.costs[start + k : start + k + len(part)] = self._draw(words[part], weights[part])
        self.places.update(zip(keys[new].tolist(), range(start, start + len(new)), strict=True))

    def _winners(self, bag: Bag) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least cost of each sample over remembered pairs, with the winning word and weight."""
        keys, words, weights = bag
        costs = self.costs.take(np.fromiter(map(self.places.__getitem__, keys.tolist()), np.int64, len(keys)), axis=0)
        least = costs.min(axis=0)
        flat = np.flatnonzero((costs == least).ravel())
        at, sample = np.divmod(flat, self.samples)
        if len(flat) == self.samples:
            won = np.empty(self.samples, np.int64)
            won[sample] = at
        else:
            won = at[np.unique(sample, return_index=True)[1]]
        return least, words[won], weights[won]

    def _bag(self, words: list[bytes]) -> Bag:
        """Keys, hashes and weights of the distinct words, in order of the hashes."""
        hashes, weights = np.unique(self.hashes.of(words), return_counts=True)
        return hashes + (weights.astype(np.uint64) - np.uint64(1)) * _WEIGHT_STEP, hashes, weights

    def _of(self, bags: list[Bag]) -> list[np.ndarray]:
        if not bags:
            return []
        self._learn(bags)
        return [self._codes(*self._winners(bag)[1:]) for bag in bags]

    def _of_large(self, bag: Bag) -> np.ndarray:
        """A text with more words than are compared at once."""
        best = None
        for at in range(0, len(bag[0]), BLOCK_ROWS):
            part = tuple(column[at : at + BLOCK_ROWS] for column in bag)
            self._learn([part])
            own = self._winners(part)
            better = own[0] < best[0] if best is not None else np.ones(self.samples, bool)
            best = own if best is None else tuple(np.where(better, a, b) for a, b in zip(own, best, strict=True))
        return self._codes(*best[1:])

    def fingerprints(self, texts: list[str]) -> list[np.ndarray | None]:
        """16-bit codes of the samples of each text; None for a text without words."""
        out: list[np.ndarray | None] = [None] * len(texts)
        waiting: dict[int, Bag] = {}
        size = 0

        def fill() -> None:
            for k, codes in zip(waiting, self._of(list(waiting.values())), strict=True):
                out[k] = codes
            waiting.clear()

        for k, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            bag = self._bag(words)
            if len(bag[0]) > BLOCK_ROWS:
                out[k] = self._of_large(bag)
                continue
            if size + len(bag[0]) > GROUP_PAIRS:
                fill()
                size = 0
            waiting[k] = bag
            size += len(bag[0])
        fill()
        return out

    def fingerprint(self, text: str) -> np.ndarray | None:
        return self.fingerprints([text])[0]


@lru_cache(maxsize=2)
def sampler_for(samples: int) -> Sampler:
    return Sampler(samples)


def likeness(one: np.ndarray | None, other: np.ndarray | None) -> float:
    """Share of samples that agree; texts without words are like each other and nothing else."""
    if one is None or other is None:
        return float(one is None and other is None)
    return float((one == other).mean())


def as_text(fingerprint: np.ndarray | None, samples: int) -> str:
    return "-" * (4 * samples) if fingerprint is None else fingerprint.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many characters from the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``key``; two short searches instead of one over all bounds."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[at : at + step] for at in range(0, len(bounds), step)]
    firsts = F.array(*[F.lit(p[0]) for p in parts])
    lists = F.array(*[F.array(*[F.lit(b) for b in p]) for p in parts])
    coarse = F.size(F.filter(firsts, lambda b: b <= key))
    fine = F.size(F.filter(F.element_at(lists, F.greatest(coarse, F.lit(1))), lambda b: b <= key))
    return F.greatest(coarse - 1, F.lit(0)) * step + fine


def with_following(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, last, text) in ranges of ids, each in one partition in order of id and text.

    A range ends with a copy (``last``) of the first row of the next one, and the last range with
    the first row of all, so that every row's next document follows it. Texts move once.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = mb_partitions(docs.sparkSession, size, 32)
    n = RANGES_EACH * parts
    # The bounds are as many as the ranges, and so are the first rows of the ranges.
    cuts = rows.agg(F.percentile_approx("key", [at / n for at in range(1, n)], 20 * n)).first()[0] or []
    bounds = sorted(set(cuts))
    ranged = rows.withColumn("range", _range_of(F.col("key"), bounds))
    firsts = {r["range"]: r["key"] for r in ranged.groupBy("range").agg(F.min("key").alias("key")).collect()}
    order = sorted(firsts)
    before = {at: order[k - 1] for k, at in enumerate(order)}
    heads = (
        ranged.filter(F.col("key").isin(list(firsts.values())))
        .groupBy("range", "key")
        .agg(F.min("text").alias("text"))
    )
    placed = docs.sparkSession.createDataFrame(
        [(at, firsts[at], before[at]) for at in order], "range int, key long, target int"
    )
    copies = heads.join(F.broadcast(placed), ["range", "key"]).select(
        F.lit(None).cast("long").alias("doc_id"), "key", "text", F.col("target").alias("range"), F.lit(True).alias("last")
    )
    return (
        ranged.withColumn("last", F.lit(False))
        .unionByName(copies)
        .repartition(parts, "range")
        .sortWithinPartitions("range", "last", "key", "text")
        .select("doc_id", "last", "text")
    )


def fingerprints(
    docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    One row per row of ``docs``. The next document is the next in order of (id, text), nulls first;
    after the last comes the first, so a single row is followed by itself. A null text is the empty
    one; a text without words has dashes for a fingerprint and is like other such texts only.
    Repeated rows follow each other. Other columns are not carried; an empty table gives no rows.
    """
    rows = with_following(docs, id_col, text_col)
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sampler = sampler_for(samples)
        held: tuple | None = None
        for batch in batches:
            ids, lasts = batch.column("doc_id").to_pylist(), batch.column("last").to_pylist()
            texts = batch.column("text").to_pylist()
            # What precedes each row, and the text that it edits.
            before = [held[1] if held else None, *(None if last else t for last, t in zip(lasts[:-1], texts[:-1], strict=True))]
            changes = [None if b is None else edited(b, t) for b, t in zip(before, texts, strict=True)]
            other = [k for k, (b, c) in enumerate(zip(before, changes, strict=True)) if c is not None and c != b]
            found = sampler.fingerprints(texts + [changes[k] for k in other])
            after = dict(zip(other, found[len(texts) :], strict=True))
            out = []
            for k, (doc, last, text, own) in enumerate(zip(ids, lasts, texts, found, strict=False)):
                if held is not None:
                    doc_before, text_before, print_before = held
                    changed = after.get(k, print_before)
                    out.append((
                        doc_before, len(text_before), hashlib.sha256(changes[k].encode()).hexdigest(),
                        as_text(print_before, samples), as_text(changed, samples),
                        likeness(print_before, changed), likeness(print_before, own),
                    ))
                held = None if last else (doc, text, own)
            if out:
                yield dict(zip(names, zip(*out, strict=True), strict=True))

    return arrow_map(
        rows,
        sample,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
