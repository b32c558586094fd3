"""Exact token counts of every prefix by dynamic programming.

For byte-level BPE the last token of the encoding of a prefix is the only token that ends there
and is compatible with the last token of the prefix before it: two tokens are compatible if their
joined bytes are encoded as just these two. One pass therefore gives the last token and the count
at every prefix of a pre-token. Counts of a text's prefixes are sums over pre-tokens, except

* within a run of blanks, whose prefix is one pre-token of its own,
* after the first letter of 're, 've and 'll, which split there as long as the last is missing,
* within a special token, whose beginning is ordinary text.

The counts are stored as one signed byte per character (the change against the prefix before), so
the longest prefix within a budget, or the count of any prefix, is read off without encoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerpitch.llm import byte_bpe
from ledgerpitch.llm.common import arrow_map

#: Token pairs a worker remembers.
PAIRS = 1_000_000
TOKENIZER_FILE = "byte_bpe_50k.json"
#: Two-letter contractions of the pre-tokenizer (fixed values).
_CUT = frozenset(("'re", "'ve", "'ll"))
#: Characters with the property White_Space (fixed values).
_BLANKS = frozenset(
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
#: A run of blanks with what follows it: no pre-token reaches over the ends, nor does that of a prefix.
_CHUNK = re.compile(f"[{''.join(sorted(_BLANKS))}]*[^{''.join(sorted(_BLANKS))}]+|[{''.join(sorted(_BLANKS))}]+")
#: Characters of a chunk that is remembered.
CHUNK_CHARS = 64


class PrefixCounter:
    """Token counts of all prefixes of a text under one tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = byte_bpe.load(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        letters = byte_bpe.LETTERS
        if not all(letter in vocab for letter in letters):
            raise ValueError("the vocabulary does not hold every byte")
        #: A trie of the tokens by byte letter: (children, number of the token that ends here or -1).
        self.root: tuple[dict, int] = ({}, -1)
        self.names = [*vocab, ""]
        for number, token in enumerate(vocab):
            children = self.root[0]
            for letter in token[:-1]:
                children = children.setdefault(letter, ({}, -1))[0]
            below = children[token[-1]][0] if token[-1] in children else {}
            children[token[-1]] = (below, number)
        self.special = byte_bpe.specials(self.tokenizer)
        self.splitter = self.tokenizer.pre_tokenizer
        self.model = self.tokenizer.model
        self.letters = letters
        self.pairs: list[dict[int, bool] | None] = [None] * len(self.names)
        self.n_pairs = 0
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self._special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.chunks = byte_bpe.Chunks(self.special, lambda texts: [self._plain_total(t) for t in texts])

    def _compatible(self, left: int, right: int) -> bool:
        self.n_pairs += 1
        if self.n_pairs > PAIRS:
            self.n_pairs = 1
            for row in self.pairs:
                if row is not None:
                    row.clear()
        one, two = self.names[left], self.names[right]
        fits = [t.value for t in self.model.tokenize(one + two)] == [one, two] if one else True
        self.pairs[left][right] = fits
        return fits

    def _piece(self, piece: str) -> list[int]:
        """Counts of all prefixes of a pre-token in byte letters, by bytes, from the empty one on."""
        n = len(piece)
        last = [-1] * (n + 1)
        counts = [0] * (n + 1)
        pairs, root, free = self.pairs, self.root[0], n
        for start in range(n):
            left, count = last[start], counts[start] + 1
            row = pairs[left]
            if row is None:
                row = pairs[left] = {}
            children = root
            end = start
            for letter in piece[start:]:
                node = children.get(letter)
                if node is None:
                    break
                children, token = node
                end += 1
                if token >= 0 and last[end] < 0:
                    fits = row.get(token)
                    if fits is None:
                        fits = self._compatible(left, token)
                    if fits:
                        last[end], counts[end] = token, count
                        free -= 1
            if not free:
                break
        return counts

    def _pieces(self, text: str) -> list[tuple[str, int, int]]:
        """Pre-tokens in byte letters, with the places of their characters."""
        if simple := byte_bpe.SIMPLE.match(text):
            word, marks = simple.groups()
            at = simple.end(1)
            piece = byte_bpe.in_letters(word)
            return [(piece, 0, at), (marks, at, len(text))] if marks else [(piece, 0, at)]
        return [(piece, *span) for piece, span in self.splitter.pre_tokenize_str(text)]

    def _plain_total(self, text: str) -> int:
        return sum(self._piece(piece)[-1] for piece, _, _ in self._pieces(text)) if text else 0

    def _run(self, out: np.ndarray, run: str, start: int, before: int) -> None:
        counts = self._piece("".join([self.letters[b] for b in run.encode()]))
        ends = np.cumsum([len(c.encode()) for c in run])
        out[start + 1 : start + 1 + len(run)] = [before + counts[e] for e in ends]

    def plain(self, text: str) -> np.ndarray:
        """Counts of all prefixes, by characters, of a text without special tokens."""
        out = np.zeros(len(text) + 1, np.int64)
        before, blanks, blank_start, blank_before = 0, "", 0, 0
        for piece, start, end in self._pieces(text):
            own = text[start:end]
            counts = self._piece(piece)
            if own in _CUT:
                counts = [0, 1, 2, counts[-1]]
            ends = np.cumsum([len(c.encode()) for c in own]) if len(piece) != len(own) else range(1, len(own) + 1)
            out[start + 1 : end + 1] = [before + counts[e] for e in ends]
            follows = bool(blanks) and blank_start + len(blanks) == start
            if own[-1] in _BLANKS:
                # A run of blanks before a word comes in two pre-tokens; up to its end it is one.
                if follows:
                    self._run(out, blanks + own, blank_start, blank_before)
                blanks, blank_start, blank_before = own, start, before
            elif follows and own[0] == " ":
                self._run(out, f"{blanks} ", blank_start, blank_before)
            before += counts[-1]
        return out

    def counts(self, text: str) -> np.ndarray:
        """Counts of all prefixes, by characters, of any text."""
        out = np.zeros(len(text) + 1, np.int64)
        at = before = 0
        for found in self._special.finditer(text):
            # Up to its last character a special token is ordinary text, joined with what precedes it.
            inside = self.plain(text[at : found.end() - 1])
            out[at : found.end()] = before + inside
            before += int(self.plain(text[at : found.start()])[-1]) + 1
            at = found.end()
            out[at] = before
        out[at:] = before + self.plain(text[at:])
        return out

    def stored(self, text: str) -> bytes:
        """Changes of the count from prefix to prefix, each chunk's computed once per worker."""
        if self._special.search(text):
            return deltas(self.counts(text))
        known = self.known
        if len(known) > byte_bpe.CACHE_CHUNKS:
            known.clear()
        chunks = _CHUNK.findall(text)
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            long: dict[str, bytes] = {}
            for chunk in set(chunks).difference(known):
                (known if len(chunk) <= CHUNK_CHARS else long)[chunk] = self._chunk(chunk)
            if not long:
                return b"".join(map(known.__getitem__, chunks))
            return b"".join([known[c] if c in known else long[c] for c in chunks])

    def _chunk(self, chunk: str) -> bytes:
        if simple := byte_bpe.SIMPLE.match(chunk):
            # Two pre-tokens at most, and words come again with other marks behind them.
            word, marks = simple.groups()
            return self._word(word) + self._word(marks) if marks else self._word(word)
        return deltas(self.plain(chunk))

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            counts = self._piece(byte_bpe.in_letters(word))
            if len(counts) - 1 != len(word):
                ends = [0]
                for letter in word:
                    ends.append(ends[-1] + len(letter.encode()))
                counts = [counts[e] for e in ends]
            found = bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)]) if len(word) < 127 else deltas(np.array(counts))
            if len(word) <= CHUNK_CHARS:
                if len(self.words) > byte_bpe.CACHE_CHUNKS:
                    self.words.clear()
                self.words[word] = found
        return found

    def total(self, text: str) -> int:
        if self.chunks.can_cut(text):
            return sum(self.chunks.of(text))
        return int(self.counts(text)[-1])


@lru_cache(maxsize=2)
def counter_for(path: str) -> PrefixCounter:
    """One counter per worker process, so that tasks share what earlier ones have learnt."""
    return PrefixCounter(path)


def deltas(counts: np.ndarray) -> bytes:
    """One signed byte for each character; a longer step between two prefixes is an error."""
    steps = np.diff(counts)
    if len(steps) and max(steps.max(), -steps.min()) > 127:
        raise ValueError("the count of tokens changes by more than 127 at one character")
    return steps.astype(np.int8).tobytes()


def total_of(stored: bytes) -> int:
    return int(np.frombuffer(stored, np.int8).sum(dtype=np.int64))


def count_at(stored: bytes, chars: int) -> int:
    """Tokens of the prefix of ``chars`` characters."""
    return int(np.frombuffer(stored, np.int8)[:chars].sum(dtype=np.int64))


def longest_within(stored: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    counts = np.concatenate([[0], np.cumsum(np.frombuffer(stored, np.int8), dtype=np.int64)])
    return int(np.flatnonzero(counts <= budget)[-1])


def token_counts(
    docs: DataFrame,
    limit: int = 1024,
    store: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_file: str = TOKENIZER_FILE,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, and the stored prefix counts on request.

    With ``store`` a binary column ``prefix_deltas`` answers ``count_at`` and ``longest_within``;
    ``n_tokens`` and ``limit_chars``, the characters of the longest prefix of at most ``limit``
    tokens, are read off it. A null text is the empty one: no bytes, no tokens. Rows with null or
    repeated ids stay as they are, one result each; other columns are not carried. Texts are never
    cut; chunks between blanks are counted once per worker.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("n_bytes", F.octet_length("text").cast("long"))
    path = public_tokenizers.path(tokenizer_file)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counter = counter_for(path)
        for batch in batches:
            ids, sizes = batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist()
            texts = (value.as_py() for value in batch.column("text"))
            if store:
                found = [counter.stored(text) for text in texts]
                tokens = [total_of(s) for s in found]
                longest = [longest_within(s, limit) if n > limit else len(s) for s, n in zip(found, tokens, strict=True)]
                extra = {"prefix_deltas": found, "limit_chars": longest}
            else:
                tokens, extra = [counter.total(text) for text in texts], {}
            yield {
                "doc_id": ids, "n_bytes": sizes, "n_tokens": tokens, "over_limit": [n > limit for n in tokens],
            } | extra

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return arrow_map(rows, count, schema + (", prefix_deltas binary, limit_chars long" if store else ""))
