from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np

from ledgerpitch.llm import crf_pii as pii

MODEL = pii.Model.from_counts(
    Counter({("u", "11+", 4): 50, ("u", "10", 0): 200, ("u", "16L", 3): 80, ("u", "16", 0): 50, ("u", "@", 1): 90})
)
NAIVE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def naive(text):
    out = []
    for kind, pattern in NAIVE:
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    chance = random.Random(5)
    parts = [*"a@.+-1 2(5)0é\n", "@", ".", "4929 1111 2222 3", "10.0.0.255", "+1 (523) 555-1055", "x@y.z", "4316522678525456", "256.1.1.1"]
    for _ in range(30_000):
        text = "".join(chance.choice(parts) for _ in range(chance.randint(0, 18)))
        assert pii.base_spans(text) == naive(text), text


def test_hostile_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000, "9" * 5000 + ".1.1.1"):
        base = pii.base_spans(text)
        pii.all_spans(text, base, MODEL)


def found(text):
    return [(kind, text[s:e]) for kind, s, e in pii.all_spans(text, pii.base_spans(text), MODEL)]


def test_repeats_share_their_label_over_any_distance():
    far = " word" * 5000
    text = f"call +1 (523) 555-1055 now.{far} Later 523-555-1055 and 999-888-7777; bob@x.org{far} bob (at) x (dot) org"
    assert found(text) == [
        ("email", "bob@x.org"), ("email", "bob (at) x (dot) org"), ("phone", "+1 (523) 555-1055"), ("phone", "523-555-1055"),
    ]
    assert found("Later 523-555-1055 and bob (at) x (dot) org") == []


def test_messages_are_exact_on_trees():
    text = "+1 (523) 555-1055 or 523-555-1055"
    base = pii.base_spans(text)
    mentions = pii.mentions_of(text, base)
    edges = pii.edges_of(mentions)
    assert len(mentions) == 2 and len(edges) == 1
    unary = [MODEL.unary.get(m.feature, MODEL.default) for m in mentions]
    score = np.zeros(5)
    for a, b in itertools.product(range(5), repeat=2):
        observed = 0.0 if a == 4 else -pii.OBSERVED
        score[b] += np.exp(observed + unary[1][b] + MODEL.edges[edges[0][2]][a, b])
    assert MODEL.label(mentions, pii._observed(mentions, base))[1] == int(score.argmax())


def test_edges_do_not_grow_with_the_square_of_repeats():
    text = "523-555-1055 x " * 2000
    assert len(pii.edges_of(pii.mentions_of(text, []))) < 6 * 2000


def test_rows_against_brute_force(spark, odd_docs, no_docs):
    got = pii.find_pii(odd_docs).collect()
    assert len(got) == odd_docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.filter("doc_id is not null").collect()}
    for r in got:
        if r["doc_id"] is not None:
            base = naive(texts[r["doc_id"]])
            spelled = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
            assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
            assert set(filter(None, spelled.split(","))) <= set(r["spans"].split(","))
    assert pii.find_pii(no_docs).count() == 0


def test_redaction_keeps_rows_and_columns(odd_docs, no_docs):
    rows = pii.redact(odd_docs)
    assert rows.columns == odd_docs.columns and rows.count() == odd_docs.count()
    texts = [r for r in rows.collect() if r["doc_id"] is None and r["text"]]
    assert [(r["text"], r["n_chars"]) for r in texts] == [("no id at all here, mail [EMAIL]", 31)]
    assert pii.redacted("ab 1234 cd", [("card", 3, 7), ("phone", 5, 9)]) == "ab [CARD]d"
    assert pii.redact(no_docs).count() == 0


def test_no_mention_lies_inside_a_base_span_however_far_it_starts():
    text = "1.1.1.1_" * 40 + "1234567_a@b.org"
    base = naive(text)
    assert ("email", 0, len(text)) in base
    spans = {(s, e) for _, s, e in base}
    assert {(m.start, m.end) for m in pii.mentions_of(text, base)} == spans
