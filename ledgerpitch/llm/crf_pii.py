"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. Mentions - digit groups of at least seven digits and addresses, also
spelled with (at) - are the nodes of a graph for each document. Chain edges tie mentions that stand
close together; skip edges tie distant mentions that are written alike (the same digits or address)
or similarly (the same last seven digits). Loopy sum-product messages spread labels over the graph,
so that a number found once as a phone number is one wherever the document repeats it, with or
without its plus sign. Words that are no mention have the label "none" with certainty; the model
factors there, which is why they need no nodes.

Unary, chain and skip weights are counted on a bounded sample of documents, labelled by the base
patterns.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerpitch.llm.common import arrow_map, sample_by_hash

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents that the weights are counted on, those of least hash.
FIT_DOCS = 2000
#: Mentions with at most this many characters between them share a chain edge.
CHAIN_CHARS = 40
#: Bounds of the learnt weights, in nats. A pattern misses mentions, so its silence weighs little.
UNARY_FLOOR, CHAIN_BOUND, SKIP_BOUNDS, SIMILAR_DISCOUNT, OBSERVED = 3.0, 1.0, (4.0, 6.0), 0.25, 12.0
ROUNDS, DAMPING, SETTLED = 30, 0.5, 1e-4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
# A match never ends within a run of digits, so starting at the run's first digit changes nothing.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}")
_AT = re.compile(r" ?[(\[](?:at|AT)[)\]] ?")
_SPELLED = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[(\[](?:dot|DOT)[)\]] ?)[A-Za-z0-9-]+)+")
_DOT = re.compile(r" ?[(\[](?:dot|DOT)[)\]] ?")

Span = tuple[str, int, int]


def _addresses(text: str) -> list[Span]:
    """Addresses, leftmost and apart, found from their @ signs in linear time."""
    out, floor = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, domain.end()))
            floor = domain.end()
            at = text.find("@", floor)
        else:
            # The signs before a lone @ cannot be part of a later address.
            floor = max(floor, at)
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start."""
    out = _addresses(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(part) <= 3 and int(part) <= 255 for part in (g.lstrip("0") or "0" for g in m.groups())):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    feature: str
    same: str
    similar: str | None


def mentions_of(text: str, base: list[Span]) -> list[Mention]:
    """Nodes of the graph in order: base spans, and what looks like an address or a long number."""
    found: dict[tuple[int, int], Mention] = {}

    def number(start: int, end: int) -> None:
        own = text[start:end]
        digits = "".join(_DIGIT.findall(own))
        feature = f"{min(len(digits), 20)}{'+' if own[0] == '+' else ''}{'.' * min(own.count('.'), 4)}{'L' if luhn(digits) else ''}"
        found[start, end] = Mention(start, end, feature, digits, digits[-7:] if len(digits) >= 9 else None)

    for kind, start, end in base:
        if kind == "email":
            found[start, end] = Mention(start, end, "@", text[start:end].lower(), None)
        else:
            number(start, end)
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    # Base spans of different kinds may overlap: the furthest end of any that starts before counts.
    reach = list(accumulate((e for _, e in taken), max))

    def free(start: int, end: int) -> bool:
        at = bisect_left(starts, end)
        return not at or reach[at - 1] <= start

    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            if free(*m.span()):
                number(*m.span())
    for m in _AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (domain := _SPELLED.match(text, m.end())) and free(start, domain.end()):
            written = f"{text[start : m.start()]}@{_DOT.sub('.', domain[0])}".lower()
            found[start, domain.end()] = Mention(start, domain.end(), "(at)", written, None)
    return [found[place] for place in sorted(found)]


def _observed(mentions: list[Mention], base: list[Span]) -> list[int]:
    """For each mention the label of its base span; 0 where it has none."""
    labels = {(s, e): KINDS.index(kind) + 1 for kind, s, e in reversed(base)}
    return [labels.get((m.start, m.end), 0) for m in mentions]


def edges_of(mentions: list[Mention]) -> list[tuple[int, int, str]]:
    """(one, other, type); every repeat is tied to the one before it and to the first, not to all."""
    edges = {
        (at, at + 1): "chain"
        for at in range(len(mentions) - 1)
        if mentions[at + 1].start - mentions[at].end <= CHAIN_CHARS
    }
    for kind in ("similar", "same"):
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for at, mention in enumerate(mentions):
            key = getattr(mention, kind)
            if key is None:
                continue
            if key in last:
                edges[last[key], at] = kind
                edges[first[key], at] = kind
            first.setdefault(key, at)
            last[key] = at
    return [(a, b, kind) for (a, b), kind in edges.items()]


@dataclass(frozen=True)
class Model:
    """Log potentials: by feature, and by type of edge."""

    unary: dict[str, np.ndarray]
    default: np.ndarray
    edges: dict[str, np.ndarray]

    @classmethod
    def from_counts(cls, counts: Counter) -> Model:
        """``counts`` holds ("u", feature, label), ("c", label, label) and ("s", kind, agree) tallies."""
        n = len(LABELS)
        totals = np.array([sum(c for k, c in counts.items() if k[0] == "u" and k[2] == label) for label in range(n)], float)
        prior = (totals + 1) / (totals + 1).sum()

        def bounded(weights: np.ndarray) -> np.ndarray:
            logs = np.log(weights / weights.max())
            return np.maximum(logs, -UNARY_FLOOR)

        features = {k[1] for k in counts if k[0] == "u"}
        unary = {
            f: bounded(np.array([counts["u", f, label] for label in range(n)]) + prior) for f in features
        }
        pairs = np.array([[counts["c", a, b] for b in range(n)] for a in range(n)], float)
        joint = pairs + pairs.T + np.outer(prior, prior)
        joint /= joint.sum()
        alone = joint.sum(axis=0)
        chain = np.clip(np.log(joint / np.outer(alone, alone)), -CHAIN_BOUND, CHAIN_BOUND)
        skip = {
            kind: np.clip(np.log((counts["s", kind, 1] + 1) / (counts["s", kind, 0] + 1)), *SKIP_BOUNDS)
            for kind in ("same", "similar")
        }
        return cls(
            unary,
            bounded(prior),
            {
                "chain": chain,
                "same": np.eye(n) * skip["same"],
                "similar": np.eye(n) * (skip["similar"] - SIMILAR_DISCOUNT),
            },
        )

    def label(self, mentions: list[Mention], observed: list[int]) -> list[int]:
        """The label of greatest marginal for each mention, by loopy sum-product messages."""
        n = len(LABELS)
        unary = np.array([self.unary.get(m.feature, self.default) for m in mentions])
        for at, label in enumerate(observed):
            if label:
                unary[at] = -OBSERVED
                unary[at, label] = 0.0
        edges = edges_of(mentions)
        if not edges:
            return unary.argmax(axis=1).tolist()
        source = np.array([a for a, _, _ in edges] + [b for _, b, _ in edges])
        target = np.array([b for _, b, _ in edges] + [a for a, _, _ in edges])
        # All potentials are symmetric, so both directions share them.
        table = np.stack([self.edges[k] for _, _, k in edges] * 2)
        back = np.r_[len(edges) : 2 * len(edges), : len(edges)]
        messages = np.zeros((len(source), n))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, messages)
            into = (belief[source] - messages[back])[:, :, None] + table
            top = into.max(axis=1, keepdims=True)
            new = np.log(np.exp(into - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - messages).max()
            messages = DAMPING * messages + (1 - DAMPING) * new
            if change < SETTLED:
                break
        belief = unary.copy()
        np.add.at(belief, target, messages)
        return belief.argmax(axis=1).tolist()


def all_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Base spans and those the model adds, by kind and start."""
    mentions = mentions_of(text, base)
    observed = _observed(mentions, base)
    added = []
    # Without an unobserved mention there is nothing to label.
    if not all(observed):
        for mention, seen, label in zip(mentions, observed, model.label(mentions, observed), strict=True):
            if label and not seen:
                added.append((LABELS[label], mention.start, mention.end))
    return sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def tally(text: str) -> Counter:
    """What one document says about the weights."""
    base = base_spans(text)
    mentions = mentions_of(text, base)
    observed = _observed(mentions, base)
    counts: Counter = Counter(("u", m.feature, label) for m, label in zip(mentions, observed, strict=True))
    for a, b, kind in edges_of(mentions):
        if kind == "chain":
            counts["c", observed[a], observed[b]] += 1
        else:
            counts["s", kind, int(observed[a] == observed[b])] += 1
    return counts


def fit(docs: DataFrame, text_col: str = "text", fit_docs: int = FIT_DOCS) -> Model:
    """Count the weights on at most ``fit_docs`` whole documents with digits or @, of least hash.

    The driver gets one row per tally; their number depends on features and labels alone.
    """
    text = F.col(text_col).cast("string").alias("text")
    found = docs.select(text).filter(F.col("text").rlike("[0-9]{7}|@|[0-9][ ().-][0-9]"))
    sample = sample_by_hash(found, fit_docs, "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column("text"):
                counts.update(tally(value.as_py()))
        if counts:
            yield {
                "kind": [k[0] for k in counts], "one": [str(k[1]) for k in counts],
                "other": [int(k[2]) for k in counts], "n": list(counts.values()),
            }

    rows = arrow_map(sample, count, "kind string, one string, other int, n long").groupBy("kind", "one", "other").agg(F.sum("n").alias("n"))
    counts = Counter()
    for r in rows.collect():
        counts[r["kind"], int(r["one"]) if r["kind"] == "c" else r["one"], r["other"]] += r["n"]
    return Model.from_counts(counts)


def spell(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_pii(
    docs: DataFrame,
    model: Model | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of ``docs``.

    The counts and the digest are those of the base spans. A null text is the empty one; repeated
    rows and null ids give one row each; other columns are not carried. Whole texts are searched,
    and the work is linear in their length. Without ``model`` one is fitted on ``docs`` first.
    """
    model = model or fit(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {f"n_{kind}": [] for kind in KINDS} | {"base_sha256": [], "spans": []}
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["base_sha256"].append(hashlib.sha256(spell(base).encode()).hexdigest())
                out["spans"].append(spell(all_spans(text, base, model)))
            yield out | {"doc_id": batch.column("doc_id")}

    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return arrow_map(rows, find, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in capitals; spans that overlap become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with all columns, personal data in the text replaced and the length column renewed.

    Null texts stay null. Every row stays, repeated ones and those without an id too; texts of any
    length are read whole, and an empty table gives no rows.
    """
    model = model or fit(docs, text_col)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            texts = []
            for value in columns[text_col]:
                text = value.as_py()
                texts.append(text and redacted(text, all_spans(text, base_spans(text), model)))
            columns[text_col] = texts
            if length_col in columns:
                old = columns[length_col].to_pylist()
                columns[length_col] = [n if t is None else len(t) for t, n in zip(texts, old, strict=True)]
            yield columns

    return arrow_map(docs, replace, docs.schema)
