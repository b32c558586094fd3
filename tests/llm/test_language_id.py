from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerpitch.llm import language_id as li
from ledgerpitch.llm.common import durable

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    train = li.document_evidence(docs.filter("doc_id % 2 = 0"), ["doc_id"])
    held = li.document_evidence(docs.filter("doc_id % 2 = 1 and n_chars >= 200"), ["doc_id"])
    model = li.fit(train)
    got = li.identify(held.withColumn("declared", F.lit(None).cast("string")), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("language = lang").count() >= 0.98 * got.count()
    assert got.filter("not kept").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_text_in_no_language_is_rejected_and_evidence_helps_short_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = li.fit(li.document_evidence(docs, ["doc_id"]))
    rows = [
        (1, "qzxv wkjq zzxq vvkw jqxz " * 20, "en", None, None, None), (2, "привет мир как дела " * 9, None, None, None, None),
        (3, "1234 !! 56", "en", None, None, None), (4, "de", "es", None, None, None), (5, "de", "fr", "fr", None, None),
    ] + [(100 + n, "der und schen für die", "de", "de", "h.example.de", "example.de") for n in range(40)] + [
        (6, "en", None, None, "h.example.de", "example.de"), (7, "en", None, None, "new.example.de", "example.de"),
        (8, "de la", "fr", "es", None, None), (9, "", "fr", "es", None, None), (10, None, None, None, None, None),
    ]
    evidence = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string, domain string")
    got = {r["id"]: r for r in li.identify(evidence.repartition(3), model).collect()}
    assert [got[n]["language"] for n in (1, 2, 3, 9, 10)] == ["und"] * 5 and not any(got[n]["kept"] for n in (1, 2, 3, 9, 10))
    assert got[6]["language"] == got[7]["language"] == "de"
    assert len(got) == len(rows)


def test_pages_give_their_evidence(spark):
    html = '<!DOCTYPE html><html lang="FR-ca"><head><title>x</title></head><script>var a="</p>";</script><p>Bonjour &amp; oui</p>'
    rows = [(1, "https://Blog.Host.example.com/fr/12?x", html), (2, "http://a.de", "<p>x"), (3, None, None)]
    got = {r["page_id"]: r for r in li.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1]["declared"], got[1]["suffix"], got[1]["host"], got[1]["domain"]) == ("fr", "fr", "blog.host.example.com", "example.com")
    assert got[1]["text"].split() == ["Bonjour", "oui"]
    assert (got[2]["declared"], got[2]["suffix"], got[2]["domain"]) == (None, "de", "a.de")
    assert (got[3]["text"], got[3]["declared"], got[3]["suffix"], got[3]["host"]) == (None, None, None, None)


def test_odd_rows(odd_docs, no_docs):
    assert li.identify(li.document_evidence(odd_docs, ["doc_id"])).count() == odd_docs.count()
    numbered = odd_docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.monotonically_increasing_id()) for c in (*li.SCORES, "language", "kept", "caller_row")})
    named = [*li.SCORES, "language", "kept", "caller_row"]
    got = li.identify(li.document_evidence(durable(numbered), ["doc_id", *named]))
    assert got.columns == ["doc_id", *li.SCORES, "_language", "_kept", "caller_row", "language", "posterior", "text_language", "kept"]
    rows = got.collect()
    assert len(rows) == odd_docs.count() and len({r["logs"] for r in rows}) == len(rows)
    assert all(r["_language"].startswith("language-") and r["known"].startswith("known-") for r in rows)
    kept = li.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {3, 4, 5}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert li.identify(li.document_evidence(no_docs, ["doc_id"])).count() == 0
    assert li.keep_identified(no_docs).count() == 0


def test_rare_and_many_languages_keep_their_documents(spark):
    def letters(at, n):
        return [chr(0x4E00 + 40 * at + (n * k + k * k) % 37) for k in range(1, 60)]

    # 12 languages of their own letters, a common one, and one with a single text.
    rows = [(f"l{at:02}", " ".join("".join(letters(at, n)[k : k + 4]) for k in range(50)), "s") for at in range(12) for n in range(6)]
    rows += [("aa", f"common words and the number {'abcdefghij'[n % 10]}{'klmnopqrst'[n // 10 % 10]} of it", "s") for n in range(600)]
    rows += [("zz", "привет мир как дела " * 9, "s")]
    docs = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "doc_id long, lang string, text string, source string")
    evidence = li.document_evidence(docs.repartition(4), ["doc_id"])
    got = li.identify(evidence, li.fit(evidence, 20)).join(docs, "doc_id").collect()
    assert len(got) == len(rows)
    assert [r for r in got if r["language"] != r["lang"] or not r["kept"]] == []


def test_declared_language_without_a_model_is_not_gated_out(spark):
    plain = [(n, "the words of a plain text about many things and others " * 3 + f" {chr(97 + n % 20)}{chr(97 + n // 20)}", "en") for n in range(200)]
    model = li.fit(li.document_evidence(spark.createDataFrame([(*r, "s") for r in plain], "doc_id long, text string, lang string, source string"), ["doc_id"]))
    rows = [(1, "привет мир как дела " * 9, "ru"), (2, "привет мир как дела " * 9, "en"), (3, "привет мир как дела " * 9, None), (4, "12 34", "ru")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: (r["language"], r["kept"]) for r in li.identify(li.document_evidence(docs, ["doc_id"]), model).collect()}
    assert model.sure == ("en",)
    assert got == {1: ("ru", True), 2: ("und", False), 3: ("und", False), 4: ("und", False)}


def test_twins_with_nulls_elsewhere_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(li, "identify", lambda evidence: evidence.withColumn("kept", F.col("declared").isNotNull()))
    rows = [(None, "a text", None, "web"), (None, "a text", "web", None), (None, "a text", "web", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert [(r["lang"], r["source"]) for r in li.keep_identified(docs).collect()] == [("web", None)] * 2


def test_junk_declarations_share_one_model(spark, monkeypatch):
    monkeypatch.setattr(li, "MODELS", 2)
    words = ["the words of a plain text about many things", "die Worte eines schlichten Textes von vielen Dingen", "привет мир как дела сегодня"]
    rows = [(n, f"{words[n % 2]} " * 3 + f"{chr(97 + n % 20)}{chr(97 + n // 20)}", ("en", "de")[n % 2], "s") for n in range(200)]
    rows += [(1000 + n, f"{words[2]} " * 6 + chr(0x430 + n % 30) * 3, f"junk{n}", "s") for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    evidence = li.document_evidence(docs, ["doc_id"])
    model = li.fit(evidence)
    assert model.languages == ["de", "en", li.OTHER]
    got = {r["doc_id"]: (r["language"], r["kept"]) for r in li.identify(evidence, model).collect()}
    assert got == {r[0]: (r[2], True) for r in rows}


def test_posteriors_equal_a_hand_computation(spark):
    rng = random.Random(7)
    texts = {"en": "the words of a plain text", "de": "die Worte eines Textes von", "fr": "les mots de ce texte sont"}
    rows = []
    for n in range(90):
        language = rng.choice(list(texts))
        own = texts[language].split()
        text = " ".join(rng.choice(own) for _ in range(rng.choice([1, 2, 30])))
        rows.append((n, text, rng.choice([language, language, "en", None]), rng.choice([None, language, "de"]), f"h{n % 4}.{language}", language if n % 3 else None))
    evidence = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string, domain string")
    model = li.fit(evidence)
    got = {r["id"]: r for r in li.identify(evidence.repartition(3), model).collect()}
    scores = [model.score(r[1]) for r in rows]
    likely = np.array([np.exp(s - s.max()) / np.exp(s - s.max()).sum() if known else np.zeros(len(s)) for s, known, _ in scores])
    shares = likely.sum(0) + 1.0

    def counts(column, value):
        return likely[[r[column] == value for r in rows]].sum(0)

    for k, row in enumerate(rows):
        fused = scores[k][0].copy()
        for column in (2, 3):
            if row[column] is not None:
                c = counts(column, row[column])
                fused += np.log((c + li.RELIABILITY_WEIGHT * c.sum() / shares.sum() + 1e-9) / (shares + li.RELIABILITY_WEIGHT))
        prior = shares / shares.sum()
        for column in (5, 4):
            c = counts(column, row[column]) if row[column] is not None else np.zeros(len(prior))
            prior = (c + li.PRIOR_WEIGHT * prior) / (c.sum() + li.PRIOR_WEIGHT)
        fused += np.log(prior + 1e-9)
        chances = np.exp(fused - fused.max()) / np.exp(fused - fused.max()).sum()
        if scores[k][1]:
            assert got[k]["posterior"] == pytest.approx(chances.max(), rel=1e-6)
            assert got[k]["language"] == model.languages[int(chances.argmax())]
        else:
            assert not got[k]["kept"] or got[k]["posterior"] == li.LEAST_POSTERIOR
