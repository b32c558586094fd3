"""Near-duplicates by an LSH forest.

Every document has a MinHash signature that is cut into several trees. In each tree signatures are
sorted; the neighbours of a document in that order are those with the longest common prefixes, so
crowded regions are compared at greater depth and sparse ones at smaller depth. Neighbours whose
signatures agree well enough tie documents to candidate groups. Within a group all links are
settled on full shingle sets:

    100 * |A & B| >= 85 * |A | B|   <=>   185 * |A ^ B| <= 15 * (|A| + |B|)

With a pivot set P and differences D(A) = A ^ P, |A ^ B| = |D(A)| + |D(B)| - 2 |D(A) & D(B)|. Let
v(A) = 185 |D(A)| - 15 |A|. If v(A) + v(B) <= 0 the two are linked, whatever they share. So all
documents near the one of least v are linked to it in one pass; for the others only documents that
share part of their difference need a look. No group is compared pair by pair, and no partner is
dropped: groups too large for one task take the same steps as joins.

Documents with equal shingle sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerpitch.llm.common import arrow_map, durable, rows_without
from ledgerpitch.llm.components import connected_components
from ledgerpitch.llm.shingles import WordHashes, distinct_shingles, finish, words_of
from ledgerpitch.session import max_broadcast_rows

TREES, DEPTH = 12, 8
#: Levels that neighbours must share at least, and neighbours looked at on each side.
LEAST_DEPTH, NEIGHBOURS = 2, 64
#: Hashes in the sketch that neighbours are compared by. A pair at the link threshold agrees in
#: fewer than this many of them with a chance of about one in a million.
SKETCH, SKETCH_LEAST = 64, 40
PERCENT = 85
#: Shingles of a candidate group that one task may hold; larger groups are settled by joins.
GROUP_SHINGLES = 4_000_000
#: Members of a large group whose majority makes its pivot; any pivot gives the same links.
PIVOT_MEMBERS = 128
#: Rows at the borders of sorted partitions that one task may compare.
BORDER_ROWS = 100_000

_KEY = 2 * DEPTH
_LEAST_BYTES = 2 * LEAST_DEPTH
_FACTORS = finish(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least image of the set under each hash function."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 12):
        part = shingles[at : at + (1 << 12)]
        np.minimum(out, (part[None, :] * _FACTORS[:, None]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, keys, sketch); node is a hash of the set, null for an empty one."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            out: dict = {"n_shingles": [], "node": [], "keys": [], "sketch": []}
            for text in batch.column("text"):
                shingles = distinct_shingles(hashes.of(words_of(text.as_py() or "")))
                out["n_shingles"].append(len(shingles))
                if not len(shingles):
                    for name in ("node", "keys", "sketch"):
                        out[name].append(None)
                    continue
                least = finish(minima(shingles))
                out["node"].append(_node(shingles))
                out["keys"].append((least & np.uint64(0xFFFF)).astype(">u2").tobytes())
                out["sketch"].append((least[:SKETCH] >> np.uint64(16) & np.uint64(0xFF)).astype(np.uint8).tobytes())
            yield out | {"doc_id": batch.column("doc_id")}

    return arrow_map(rows, sign, "doc_id long, n_shingles long, node long, keys binary, sketch binary")


def _node(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


class _Neighbours:
    """The last rows of a sorted tree order, with the candidate groups they are in."""

    def __init__(self):
        self.sketches = np.zeros((NEIGHBOURS, SKETCH), np.uint8)
        self.groups = np.zeros(NEIGHBOURS, np.int64)
        self.nodes = np.zeros(NEIGHBOURS, np.int64)
        self.region: tuple | None = None
        self.n = 0

    def meet(self, tree: int, key: bytes, node: int, sketch: bytes) -> list[int]:
        """Nodes to tie this one to, one for each other group among its neighbours."""
        region = (tree, key[:_LEAST_BYTES])
        if region != self.region:
            self.region, self.n = region, 0
        own = np.frombuffer(sketch, np.uint8)
        ties: list[int] = []
        group = node
        if held := min(self.n, NEIGHBOURS):
            near = np.flatnonzero((self.sketches[:held] == own).sum(axis=1) >= SKETCH_LEAST)
            if len(near):
                joined, at = np.unique(self.groups[near], return_index=True)
                ties = [int(x) for x in self.nodes[near[at]] if x != node]
                group = int(joined[0])
                if len(joined) > 1:
                    self.groups[:held][np.isin(self.groups[:held], joined)] = group
        slot = self.n % NEIGHBOURS
        self.sketches[slot], self.groups[slot], self.nodes[slot] = own, group, node
        self.n += 1
        return ties


def _tied(rows: DataFrame, borders: bool) -> DataFrame:
    """Ties among sorted neighbours; rows within reach of a partition's ends come back as well."""

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        near = _Neighbours()
        head, tail = 0, []
        empty = {"tree": None, "key": None, "node": None, "sketch": None}
        for batch in batches:
            out: dict = {k: [] for k in ("a", "b", "tree", "key", "node", "sketch")}

            def emit(a=None, b=None, out=out, **row) -> None:
                for name, value in ({"a": a, "b": b} | empty | row).items():
                    out[name].append(value)

            for row in zip(*[batch.column(k).to_pylist() for k in ("tree", "key", "node", "sketch")], strict=True):
                for other in near.meet(*row):
                    emit(row[2], other)
                if borders:
                    named = dict(zip(("tree", "key", "node", "sketch"), row, strict=True))
                    if head < NEIGHBOURS:
                        head += 1
                        emit(**named)
                    else:
                        tail.append(named)
            del tail[:-NEIGHBOURS]
            yield out
        if tail:
            yield {"a": [None] * len(tail), "b": [None] * len(tail)} | {k: [t[k] for t in tail] for k in tail[0]}

    return arrow_map(rows, tie, "a long, b long, tree int, key binary, node long, sketch binary")


def candidate_ties(signed: DataFrame) -> DataFrame:
    """(a, b): ties between nodes that are neighbours in some tree and agree in their sketches.

    Each tree is range-partitioned in sorted order, which splits regions of any size. Neighbours on
    both sides of a partition's end meet in a further round over the rows near such ends only.
    """
    order = ["tree", "key", "node"]
    nodes = signed.filter("node is not null").select("node", "keys", "sketch").distinct()
    rows = durable(nodes).select(
        "node", "sketch", "keys", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    ).select("tree", F.substring("keys", F.col("tree") * _KEY + 1, F.lit(_KEY)).alias("key"), "node", "sketch")
    spark = signed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ties = []
    while True:
        sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        found = durable(_tied(sorted_rows, borders=parts > 1))
        ties.append(found.filter("a is not null").select("a", "b"))
        if parts == 1:
            break
        rows = found.filter("a is null").select("tree", "key", "node", "sketch")
        parts = min(parts - 1, -(-2 * NEIGHBOURS * parts // BORDER_ROWS))
    out = ties[0]
    for more in ties[1:]:
        out = out.unionByName(more)
    return out.distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, coarse, size, shingles) of the wanted (doc_id, node, coarse), from their whole texts.

    Where rows with one id hold different texts, the text is the one whose set has the node's hash.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if wanted.count() <= max_broadcast_rows(docs.sparkSession):
        wanted = F.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for node, coarse, text in zip(
                batch.column("node").to_pylist(), batch.column("coarse").to_pylist(), batch.column("text"), strict=True
            ):
                shingles = distinct_shingles(hashes.of(words_of(text.as_py() or "")))
                if len(shingles) and _node(shingles) == node:
                    rows.append((node, coarse, len(shingles), shingles.tobytes()))
            if rows:
                yield dict(zip(("node", "coarse", "size", "shingles"), zip(*rows, strict=True), strict=True))

    joined = texts.join(wanted, "doc_id").select("node", "coarse", "text")
    return arrow_map(joined, sets, "node long, coarse long, size long, shingles binary")


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))
        self.groups = n

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.groups -= 1


def majority(sets: list[np.ndarray]) -> np.ndarray:
    """Shingles of at least half of the sets."""
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    return values[2 * counts >= len(sets)]


def link_sets(sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """For each set the place of the first set it is connected with by links on full sets."""
    n = len(sets)
    union = _Union(n)
    pivot = majority(sets)
    differences = [np.setxor1d(s, pivot, assume_unique=True) for s in sets]
    sizes = np.array([len(s) for s in sets], np.int64)
    away = np.array([len(d) for d in differences], np.int64)
    value = (100 + percent) * away - (100 - percent) * sizes
    centre = int(value.argmin())
    # With v(A) + v(centre) <= 0 the link needs nothing in common.
    for at in np.flatnonzero(value + value[centre] <= 0):
        union.join(int(at), centre)
    rest = np.flatnonzero(value + value[centre] > 0)
    if len(rest) and n > 1:
        owners = np.repeat(np.arange(n), away)
        shingles = np.concatenate(differences)
        by_value = np.argsort(shingles, kind="stable")
        shingles, owners = shingles[by_value], owners[by_value]
        for at in rest:
            first = np.searchsorted(shingles, differences[at], "left")
            last = np.searchsorted(shingles, differences[at], "right")
            lengths = last - first
            places = np.repeat(first - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            shared = np.bincount(owners[places], minlength=n)
            # v(A) + v(B) - 2 * 185 * shared <= 0 is the link condition.
            for other in np.flatnonzero(value[at] + value - 2 * (100 + percent) * shared <= 0):
                union.join(int(at), int(other))
            if union.groups == 1:
                break
    return [union.find(at) for at in range(n)]


def _settled_in_tasks(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that span the components of each candidate group, one group at a time."""
    rows = sets.repartition("coarse").sortWithinPartitions("coarse", "node")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(k).to_pylist() for k in ("coarse", "node", "shingles")], strict=True)

        for _, group in groupby(rows(), key=lambda row: row[0]):
            # A set comes once for each row that has its node's id and text.
            members = {node: shingles for _, node, shingles in group}
            nodes = list(members)
            firsts = link_sets([np.frombuffer(s, np.uint64) for s in members.values()], percent)
            yield {"a": nodes, "b": [nodes[f] for f in firsts]}

    return arrow_map(rows, settle, "a long, b long")


def _settled_by_joins(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links of groups that no single task should hold, by the same steps as ``link_sets``."""
    unique = sets.dropDuplicates(["node"])
    chosen = F.row_number().over(Window.partitionBy("coarse").orderBy("node"))
    sample = unique.withColumn("nth", chosen).filter(F.col("nth") <= PIVOT_MEMBERS).select("coarse", "shingles")

    def pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch.column("coarse").to_pylist(), batch.column("shingles").to_pylist(), strict=True)

        for coarse, group in groupby(rows(), key=lambda row: row[0]):
            chosen = majority([np.frombuffer(s, np.uint64) for _, s in group])
            yield {"coarse": [coarse], "pivot": [chosen.tobytes()]}

    pivot = arrow_map(
        sample.repartition("coarse").sortWithinPartitions("coarse"), pivots, "coarse long, pivot binary"
    )

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            away = [
                np.setxor1d(np.frombuffer(s, np.uint64), np.frombuffer(p, np.uint64), assume_unique=True)
                for s, p in zip(batch.column("shingles").to_pylist(), batch.column("pivot").to_pylist(), strict=True)
            ]
            yield {
                "coarse": batch.column("coarse"),
                "node": batch.column("node"),
                "v": [(100 + percent) * len(d) - (100 - percent) * n for d, n in zip(away, batch.column("size").to_pylist(), strict=True)],
                "away": [d.astype(np.int64).tolist() for d in away],
            }

    members = durable(
        arrow_map(
            unique.join(pivot, "coarse").select("coarse", "node", "size", "shingles", "pivot"),
            differ,
            "coarse long, node long, v long, away array<long>",
        )
    )
    centre = members.groupBy("coarse").agg(F.min(F.struct("v", "node")).alias("c")).select(
        "coarse", F.col("c.v").alias("centre_v"), F.col("c.node").alias("centre")
    )
    placed = durable(members.join(centre, "coarse"))
    near = placed.filter("v + centre_v <= 0").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    own = placed.filter("v + centre_v > 0").select("coarse", "node", "v", F.explode("away").alias("shingle"))
    all_rows = placed.select("coarse", F.col("node").alias("other"), F.col("v").alias("other_v"), F.explode("away").alias("shingle"))
    shared = (
        own.join(all_rows, ["coarse", "shingle"])
        .filter("node <> other")
        .groupBy("node", "other", "v", "other_v")
        .agg(F.count("*").alias("shared"))
        .filter(F.col("v") + F.col("other_v") - 2 * (100 + percent) * F.col("shared") <= 0)
    )
    return near.unionByName(shared.select(F.col("node").alias("a"), F.col("other").alias("b")))


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_shingles: int = GROUP_SHINGLES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents are linked if their sets of distinct five-word shingles (A-Z in lower case; words are
    what stands between blanks; fewer words make one shingle) have a Jaccard similarity of at least
    ``percent`` hundredths. ``component_id`` is the least id reachable over links. A document
    without words (null, empty or blank text) is linked with nothing. Rows that share an id and a
    text are one document and all kept if it is; a row with a null id is linked with nothing, has a
    null component and is kept. Other columns are not carried. An empty table gives no rows.
    """
    signed = durable(signatures(docs, id_col, text_col))
    linkable = signed.filter("node is not null and doc_id is not null")
    ties = durable(candidate_ties(linkable))
    coarse = connected_components(ties).select("node", F.col("component").alias("coarse"))
    least = linkable.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = durable(coarse.join(least, "node").select("doc_id", "node", "coarse"))
    sets = durable(shingle_sets(docs, wanted, id_col, text_col))
    large = (
        sets.groupBy("coarse").agg(F.sum("size").alias("shingles")).filter(F.col("shingles") > group_shingles).select("coarse")
    )
    links = _settled_in_tasks(sets.join(large, "coarse", "left_anti"), percent)
    if large.limit(1).count():
        links = links.unionByName(_settled_by_joins(sets.join(large, "coarse", "left_semi"), percent))
        links = connected_components(durable(links)).select(F.col("node").alias("a"), F.col("component").alias("b"))
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    nodes = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = durable(nodes)
    firsts = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    final = named.join(firsts, "root").select("node", "component_id")
    return (
        signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
        .join(final, "node", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
        )
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which each near-duplicate group keeps one.

    The one with the least id stays. Of rows that repeat both id and text one stays; a row with a
    null id always stays. A null or empty text is in no group. Other columns are those of the row
    that stays; an empty table gives no rows.
    """
    verdicts = durable(near_duplicates(docs, percent, id_col, text_col))
    gone = verdicts.filter("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    stay = rows_without(docs, gone, id_col)
    repeated = durable(
        verdicts.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).count().filter("count > 1").select(id_col)
    )
    if not repeated.limit(1).count():
        return stay
    again = stay.join(repeated, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col, text_col])
    return rows_without(stay, repeated, id_col).unionByName(again)
