from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerpitch.llm import byte_bpe, packing
from ledgerpitch.llm import token_counts as tc

PATH = public_tokenizers.path(tc.TOKENIZER_FILE)
PARTS = [" ", "  ", "\n", "\n\n", "'re", "'ll", "'s", "'", "re", "the", " and", "ß", "é", "日本", "🙂", "123", "!!", "...",
         "<|endoftext|>", "<|", "　", "\x1c", "\x85", "\t", "ing", "A", "_", "́", "​", "²"]
texts = st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=2)), max_size=12).map("".join)


@pytest.fixture(scope="module")
def counter():
    return tc.PrefixCounter(PATH)


@pytest.fixture(scope="module")
def library():
    return byte_bpe.load(PATH)


def size(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(text=texts)
def test_every_prefix_has_the_library_s_count(counter, library, text):
    want = [size(library, text[:k]) for k in range(len(text) + 1)]
    assert counter.counts(text).tolist() == want
    assert counter.total(text) == want[-1]
    stored = tc.deltas(counter.counts(text))
    assert [tc.count_at(stored, k) for k in range(len(text) + 1)] == want
    for budget in range(4):
        assert tc.longest_within(stored, budget) == max(k for k, n in enumerate(want) if n <= budget)


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_ids_by_chunks_are_the_library_s(library, text):
    encoder = packing.encoder_for(PATH)
    got = memoryview(encoder.ids(text)).cast("I").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids


def test_all_characters_between_blanks(counter, library):
    for start in range(0, 0x30000, 97):
        if not 0xD800 <= start < 0xE000:
            text = f"a{chr(start)} b{chr(start)} {chr(start)}c"
            assert counter.total(text) == size(library, text), hex(start)


def test_odd_rows(odd_docs, no_docs, library):
    got = sorted(map(tuple, tc.token_counts(odd_docs).collect()), key=str)
    want = [
        (r["doc_id"], len((r["text"] or "").encode()), n := size(library, r["text"] or ""), n > 1024)
        for r in odd_docs.collect()
    ]
    assert got == sorted(want, key=str)
    assert tc.token_counts(no_docs).count() == 0
    stored = tc.token_counts(odd_docs.filter("n_chars < 100"), store=True).filter("doc_id = 8").first()
    assert tc.count_at(stored["prefix_deltas"], 9) == stored["n_tokens"]


def test_caches_are_bounded(library):
    chunks = byte_bpe.Chunks([], lambda texts: [len(t) for t in texts], limit=50)
    for n in range(300):
        assert chunks.of(f"w{n} x{n}\ny{n}") == [len(f"w{n}"), 1 + len(f"x{n}"), 1, len(f"y{n}")]
        assert len(chunks.first) + len(chunks.spaced) <= 55


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_stored_counts_by_chunks_are_those_of_the_text(counter, library, text):
    stored = counter.stored(text)
    assert [tc.count_at(stored, k) for k in range(len(text) + 1)] == [size(library, text[:k]) for k in range(len(text) + 1)]


def test_the_query_stores_every_prefix(spark, tmp_path, library):
    from ledgerpitch.llm import queries

    rows = [(1, "the quick  brown\n\n fox"), (2, " ".join(f"word{n}" for n in range(900))), (3, None), (4, "a<|endoftext|> b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op6_token_counts(spark, str(tmp_path)).collect()}
    for doc, text in rows:
        text, stored = text or "", got[doc]["prefix_deltas"]
        assert len(stored) == len(text) and got[doc]["n_tokens"] == size(library, text) == tc.count_at(stored, len(text))
        for k in range(0, len(text), 97):
            assert tc.count_at(stored, k) == size(library, text[:k])
        assert got[doc]["limit_chars"] == tc.longest_within(stored, 1024)
        assert size(library, text[: got[doc]["limit_chars"]]) <= 1024
