from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerpitch.llm import filter_audit
from ledgerpitch.llm.filter_audit import RadixTrie

LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [
        len(words) < 50,
        100 * len(set(words)) < 65 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
    ]


def brute_force(docs, labels):
    """Every order run filter by filter."""
    rows = []
    for doc_id, text, part in docs:
        text = text or ""
        copies = [i for i, t, _ in docs if (t or "") == text and i is not None]
        found = dict(zip("ABCD", fails(text), strict=True))
        found["E"] = doc_id is not None and any(i < doc_id for i in copies)
        marks = [(q == 1, t == 1) for i, q, t in labels if i is not None and i == doc_id]
        rows.append((part or "", found, any(q for q, _ in marks), any(t for _, t in marks)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, letter in enumerate(order, 1):
                removed = [r for r in alive if r[1][letter]]
                alive = [r for r in alive if not r[1][letter]]
                failing = [r for r in own if r[1][letter]]
                alone = [r for r in failing if sum(r[1].values()) == 1]
                shares[letter] += len(removed)
                out[part, "".join(order), step] = [
                    len(alive), len(removed), len(failing) - len(removed), len(alone), sum(r[2] for r in removed), sum(r[3] for r in removed)
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return out


def collected(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in df.collect()}


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(80)]
    texts = []
    for k in range(n):
        size = rng.choice([0, 3, 49, 50, 70])
        own = [rng.choice(words[: rng.choice([10, 80])]) for _ in range(size)]
        if rng.random() < 0.3:
            own = [w.upper() for w in own]
        text = rng.choice([" ", "\n", " \t"]).join(own) + rng.choice(["", "", "$", " é|"])
        texts.append(rng.choice(texts) if texts and rng.random() < 0.3 else text)
    same = "the same opening of many documents " * 9
    texts += [same + f"but{k % 7} its own end" for k in range(20)]
    docs = [(k * 37 % 1009, t, rng.choice(["a", "b", None, ""])) for k, t in enumerate(texts)]
    docs += [(docs[0][0], docs[0][1], "a"), (None, docs[1][1], "b"), (None, docs[1][1], "c"), (2000, None, "c"), (2001, "", "c"), (2001, "ünï " * 60, "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, _, _ in docs if rng.random() < 0.6] + [(None, 1, 1), (2000, 0, 1), (2000, 1, 0)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_running_every_order(spark, seed, monkeypatch):
    monkeypatch.setattr(filter_audit, "BATCH_ROWS", 7)
    docs, labels = made(seed, 90)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    df = df.withColumns({c: F.lit("x") for c in ("part", "mask", "node", "least", "cell", "good")}).repartition(4)
    got = filter_audit.filter_audit(df, spark.createDataFrame(labels, LABELS).withColumn("part", F.lit(1)))
    want = brute_force(docs, labels)
    assert collected(got) == want
    assert got.count() == len(want)


def test_heavy_prefixes_grow_and_nothing_is_split(spark):
    start = "one opening that thousands of documents share word by word " * 8
    rows = [(k, start + str(k % 40)) for k in range(200)] + [(900 + k, "same text" * 60) for k in range(50)]
    texts = spark.createDataFrame(rows, "node long, text string")
    total = sum(len(t) for _, t in rows)
    cells = filter_audit.prefix_cells(texts, total, 8).collect()
    assert max(len(r["cell"]) for r in cells) > 64
    by_text = {}
    for r in cells:
        assert r["text"].startswith(r["cell"])
        assert by_text.setdefault(r["text"], r["cell"]) == r["cell"]


def test_no_broadcast_of_many_prefixes(spark):
    docs, labels = made(5, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    spark.conf.set("spark.ledgerpitch.maxBroadcastRows", "0")
    try:
        assert collected(filter_audit.filter_audit(df, spark.createDataFrame(labels, LABELS))) == brute_force(docs, labels)
    finally:
        spark.conf.unset("spark.ledgerpitch.maxBroadcastRows")


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(no_docs, labels).count() == 0
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    assert collected(filter_audit.filter_audit(odd_docs, labels)) == brute_force(rows, [])


def test_trie_holds_every_text_once():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(3000)]
    trie = RadixTrie()
    for k, text in enumerate(texts):
        trie.terminal(text).meet(k, k)
    groups = {}
    for k, text in enumerate(texts):
        groups.setdefault(text, []).append(k)
    assert sorted(t.keys for t in trie.terminals()) == sorted(groups.values())
    assert all(t.least == min(t.keys) for t in trie.terminals())


def test_cells_grow_without_a_join(spark):
    start = "the opening of all of them, which is far longer than a first prefix " * 40
    texts = spark.createDataFrame([(k, start + str(k)) for k in range(300)] + [(900, ""), (901, "ab")], "node long, text string")
    cells = filter_audit.prefix_cells(texts, 300 * len(start), 8)
    assert "Join" not in cells._jdf.queryExecution().optimizedPlan().toString()
    found = {r["node"]: r["cell"] for r in cells.collect()}
    assert len(found) == 302 and found[900] == "" and found[901] == "ab"
    assert len({found[k] for k in range(300)}) == 300
