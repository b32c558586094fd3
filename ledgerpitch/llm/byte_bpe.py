"""Byte-level BPE over chunks between blanks, which repeat, so that each is encoded once per worker.

The pre-tokenizer of byte-level BPE never joins what stands before a single space or line break
with what stands after it, and a space goes with the word behind it. A text is therefore cut at
line breaks and spaces, and the ids of the pieces are those of the whole. It does not hold for
three blanks in a row, two at the end, or a special token; such texts are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from tokenizers import Tokenizer

#: Chunks a worker remembers before it starts afresh; about 150 bytes each.
CACHE_CHUNKS = 1_000_000
_RUNS = re.compile(r"\s\s(?:\s|\Z)")


#: A word of Latin letters, maybe behind a space, and ASCII marks behind it but for the apostrophe:
#: two pre-tokens at most.
SIMPLE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + at) for at, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


LETTERS = byte_letters()


def in_letters(piece: str) -> str:
    """A pre-token as the vocabulary writes it."""
    if not piece.isascii():
        return "".join([LETTERS[b] for b in piece.encode()])
    return LETTERS[32] + piece[1:] if piece[0] == " " else piece


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def specials(tokenizer: Tokenizer) -> list[str]:
    return [token.content for token in tokenizer.get_added_tokens_decoder().values()]


class Chunks:
    """A cache from chunks to whatever ``measure`` makes of them.

    ``measure`` takes a list of texts and gives one value for each. Chunks behind a space have a
    cache of their own, so no string is built to look one up.
    """

    def __init__(self, special: Iterable[str], measure: Callable[[list[str]], Iterable], limit: int = CACHE_CHUNKS):
        self.special = list(special)
        self.measure = measure
        self.limit = limit
        self.first: dict = {}
        self.spaced: dict = {}
        (self.newline,) = measure(["\n"])

    def can_cut(self, text: str) -> bool:
        return not _RUNS.search(text) and not any(s in text for s in self.special)

    def of(self, text: str) -> list:
        """The values of the chunks of a text that can be cut, in order."""
        out: list = []
        first, spaced = self.first, self.spaced
        if len(first) + len(spaced) > self.limit:
            first.clear()
            spaced.clear()
        lines = [line.split(" ") for line in text.split("\n")]
        try:
            for chunks in lines:
                out.append(first[chunks[0]])
                if len(chunks) > 1:
                    out.extend(map(spaced.__getitem__, chunks[1:]))
                out.append(self.newline)
        except KeyError:
            self._learn(lines)
            return self.of_lines(lines)
        out.pop()
        return out

    def of_lines(self, lines: list[list[str]]) -> list:
        out: list = []
        for chunks in lines:
            out.append(self.first[chunks[0]])
            out.extend(map(self.spaced.__getitem__, chunks[1:]))
            out.append(self.newline)
        out.pop()
        return out

    def _learn(self, lines: list[list[str]]) -> None:
        first, spaced = self.first, self.spaced
        starts = [c for c in {c[0] for c in lines} if c not in first]
        rest = [c for c in set().union(*[c[1:] for c in lines]) if c not in spaced]
        values = self.measure([*starts, *[f" {chunk}" for chunk in rest]])
        for at, value in enumerate(values):
            if at < len(starts):
                self.first[starts[at]] = value
            else:
                self.spaced[rest[at - len(starts)]] = value
