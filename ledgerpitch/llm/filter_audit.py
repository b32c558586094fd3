"""How corpus filters interact: what each removes in every order they can run in.

Duplicate flags come from radix tries. Each task first puts the texts of a bounded batch into a trie
of its own, so copies within it become one row; those rows are range-partitioned by text prefixes,
which grow where a prefix holds too many bytes, and every prefix cell is one compressed trie over
full texts with the least id at each terminal. Filters are then bits of a mask, and the counts of
the masks answer every order.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerpitch.llm.common import arrow_map, durable, mb_partitions

#: The filters, by bit: few words, few distinct words, shouting, symbols, duplicates.
LETTERS = "ABCDE"
DUPLICATE = 1 << LETTERS.index("E")
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
SYMBOLS = b"#$%&*|"
#: Bytes and rows of one trie in the first step.
BATCH_BYTES, BATCH_ROWS = 32 << 20, 50_000
#: Code points of a prefix at first, and how much longer it gets where it holds too many bytes.
FIRST_PREFIX, LONGER = 4, 4
#: Megabytes of text in a partition of tries, and prefix cells a partition has at least.
PARTITION_MB, CELLS = 32, 4

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))


class Node:
    """A node of a radix trie: the bytes on its way in, its children by first byte, and at
    terminals the least id and the keys of the rows that ended here."""

    __slots__ = ("children", "keys", "label", "least")

    def __init__(self, label: bytes, children: dict[int, Node] | None = None):
        self.label, self.children = label, children or {}
        self.least: int | None = None
        self.keys: list[int] | None = None

    def meet(self, key: int, least: int | None) -> None:
        if self.keys is None:
            self.keys = []
        self.keys.append(key)
        if least is not None and (self.least is None or least < self.least):
            self.least = least


class RadixTrie:
    """A compressed trie over whole byte strings."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def terminal(self, text: bytes) -> Node:
        """The node where ``text`` ends, made if there is none."""
        node, at, size = self.root, 0, len(text)
        while at < size:
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = leaf = Node(text[at:])
                return leaf
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            shared = _shared(child.label, text, at)
            upper = Node(child.label[:shared], {child.label[shared]: child})
            child.label = child.label[shared:]
            node.children[text[at]] = upper
            node, at = upper, at + shared
        return node

    def terminals(self) -> Iterator[Node]:
        waiting = [self.root]
        while waiting:
            node = waiting.pop()
            if node.keys is not None:
                yield node
            waiting.extend(node.children.values())


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Bytes that ``label`` and ``text`` from ``at`` on have in common at the start."""
    low, high = 1, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def text_mask(text: bytes) -> int:
    """The bits of the filters that look at one text alone."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * len(text.translate(None, _CONTINUED))) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


ROWS = "doc_id {id}, part string, mask int, node long, least {id}, text string"


def _first_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row per document; the first of each distinct text of a batch of documents holds the text.

    ``node`` names that text within the batch, ``least`` is its least id there.
    """
    counter = TaskContext.get().partitionId() << 40

    def flushed(rows: list[tuple], trie: RadixTrie) -> dict:
        masks: dict[int, int] = {}
        out = {"doc_id": [], "part": [], "mask": [], "node": [], "least": [], "text": []}
        for key, doc_id, part, text, node in rows:
            name = node.keys[0]
            if name not in masks:
                masks[name] = text_mask(text)
            out["doc_id"].append(doc_id)
            out["part"].append(part)
            out["mask"].append(masks[name])
            out["node"].append(name)
            out["least"].append(node.least)
            out["text"].append(text if key == name else None)
        out["text"] = pa.array(out["text"], pa.binary()).cast(pa.string())
        return out

    rows, trie, size = [], RadixTrie(), 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for doc_id, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), texts, strict=True):
            node = trie.terminal(text)
            node.meet(counter, doc_id)
            rows.append((counter, doc_id, part, text, node))
            counter += 1
            size += len(text)
            if size > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield flushed(rows, trie)
                rows, trie, size = [], RadixTrie(), 0
    if rows:
        yield flushed(rows, trie)


def prefix_cells(texts: DataFrame, total: int, partitions: int) -> DataFrame:
    """``texts`` with the column ``cell``: the shortest of the prefix lengths at which the rows that
    share it hold no more bytes than a cell should, or the whole text.

    Heavy prefixes of a length are at most CELLS * partitions, so their hashes are a short list, and
    rows are told by it without a join. A prefix that shares its hash with a heavy one may grow
    needlessly; equal texts always get equal cells.
    """
    most = max(1, total // (CELLS * partitions))
    size, depth = F.octet_length("text"), FIRST_PREFIX
    open_, grown = F.lit(True), []
    while True:
        start = F.substring("text", 1, depth)
        heavy = (
            texts.filter(open_)
            .groupBy(F.xxhash64(start).alias("start"))
            .agg(F.sum(size).alias("bytes"), F.max(F.length("text")).alias("longest"))
            .filter((F.col("bytes") > most) & (F.col("longest") > depth))
            .select("start")
            .collect()
        )
        if not heavy:
            break
        open_ = F.xxhash64(start).isin([r["start"] for r in heavy])
        grown.append((open_, start))
        depth *= LONGER
    cell = F.substring("text", 1, depth)
    for heavy_here, start in reversed(grown):
        cell = F.when(heavy_here, cell).otherwise(start)
    return texts.withColumn("cell", cell)


def _shared_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """(node, least) of all nodes whose text other nodes hold too; rows come sorted by cell."""

    def met(trie: RadixTrie) -> dict:
        out: dict[str, list] = {"node": [], "least": []}
        for terminal in trie.terminals():
            if len(terminal.keys) > 1:
                out["node"] += terminal.keys
                out["least"] += [terminal.least] * len(terminal.keys)
        return out

    trie, current = RadixTrie(), None
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        rows = zip(batch.column("cell").to_pylist(), texts, batch.column("node").to_pylist(), batch.column("least").to_pylist(), strict=True)
        for cell, text, node, least in rows:
            if cell != current:
                yield met(trie)
                trie, current = RadixTrie(), cell
            trie.terminal(text).meet(node, least)
    yield met(trie)


def filter_masks(docs: DataFrame, text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask) of every row of ``docs``: which filters its text fails, by bit.

    Bits A to E as in ``LETTERS``. A null text counts as empty, a null part as the empty string. A
    row is a duplicate if its whole text equals that of a row with a smaller doc_id: rows that share
    their id are no duplicates of each other, rows without an id neither are nor make any. Texts of
    any length are compared whole. Other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id", F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    written = durable(arrow_map(rows, _first_tries, ROWS.format(id=kind)))
    texts = written.filter(F.col("text").isNotNull()).select("node", "least", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = mb_partitions(docs.sparkSession, total, PARTITION_MB)
    cells = prefix_cells(texts, total, partitions).repartitionByRange(partitions, "cell").sortWithinPartitions("cell")
    shared = arrow_map(cells, _shared_texts, f"node long, least {kind}")
    # Rows above the least id of their own batch are duplicates whatever other batches hold.
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    own = written.select("doc_id", "part", "mask", "node", "least")
    late = own.filter(later).select("doc_id", "part", F.col("mask").bitwiseOR(F.lit(DUPLICATE)).alias("mask"))
    first = (
        own.filter(~later)
        .drop("least")
        .join(shared, "node", "left")
        .select("doc_id", "part", F.col("mask").bitwiseOR(F.when(later, DUPLICATE).otherwise(0)).alias("mask"))
    )
    return late.unionByName(first)


def filter_audit(docs: DataFrame, labels: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """Document counts by part, order of the filters and step.

    Returns part, filter_order (every permutation of ``letters``), step (from 1) and, for the
    filter at that step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.
    Masks as in ``filter_masks``. A document is good or toxic if any of its label rows says 1; null
    ids and null labels say nothing. Parts without a removal have zeros, an empty table no rows.
    """
    marked = (
        labels.groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
        .filter("doc_id is not null and (good = 1 or toxic = 1)")
    )
    masks = durable(filter_masks(docs))
    counted = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.lit(0).cast("long").alias(c) for c in ("good", "toxic")))
    lost = (
        masks.join(marked, "doc_id")
        .groupBy("part", "mask")
        .agg(F.lit(0).cast("long").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")))
    )
    # At most 32 masks a part: what the orders need of a part is one short list.
    parts = (
        counted.unionByName(lost)
        .groupBy("part", "mask")
        .agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
        .groupBy("part")
        .agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    )
    steps = []
    for order in itertools.permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            steps.append(("".join(order), step, bit, before))
            before |= bit
    spark = docs.sparkSession
    plan = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, bit int, earlier int"))
    every = sum(1 << LETTERS.index(letter) for letter in letters)
    orders = len(steps) // len(letters)
    bit, earlier = F.col("bit"), F.col("earlier")

    def total(of: str, holds) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("masks", zero, lambda sum_, m: sum_ + F.when(holds(m["mask"].bitwiseAND(F.lit(every))), m[of]).otherwise(zero))

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(bit) != 0

    def gone(mask: Column) -> Column:
        return mask.bitwiseAND(earlier) != 0

    share = F.aggregate(
        "masks",
        F.lit(0).cast("long"),
        lambda sum_, m: sum_ + F.when(
            fails(m["mask"]), m["n"] * F.floor(F.lit(orders) / F.bit_count(m["mask"].bitwiseAND(F.lit(every))))
        ).otherwise(F.lit(0).cast("long")),
    )
    # A document is removed by each filter it fails in an equal share of the orders.
    return parts.crossJoin(plan).select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(earlier)) == 0).alias("kept"),
        total("n", lambda m: fails(m) & ~gone(m)).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", lambda m: fails(m) & ~gone(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & ~gone(m)).alias("toxic_lost"),
        share.alias("shapley"),
    )
