"""Language identification by Bayesian fusion of evidence.

Text gives a likelihood per language from letter trigrams. Three more sources are added in logs:

* the declared language: P(declared | language),
* the suffix of the address: P(suffix | language),
* the host: a prior for each host, smoothed towards its domain, which is smoothed towards all rows.

All three are soft counts: the languages that the texts alone suggest, summed by grouped
aggregation over all rows. So a wrong declaration is outweighed where declarations often are wrong.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerpitch.llm.common import arrow_map, durable, free_name, rows_without, sample_by_hash
from ledgerpitch.llm.shingles import finish

UNKNOWN = "und"
#: Declared languages with a model of their own, those of most texts; the others share one, which
#: stands under this name.
MODELS, OTHER = 128, "other"
#: Rows of each declared language that the trigram model is counted on, those of least hash.
FIT_ROWS = 4000
BUCKETS = 1 << 16
#: Trigrams that a language's own sample must have to be judged by itself. Below, it is smoothed
#: by all languages, and its declaration holds where the text is in no language.
LEAST_TRIGRAMS, THIN_WEIGHT = 10_000, 3000.0
#: Overlapping trigrams repeat each other's evidence; their logs are weighed down by this.
TEMPER = 0.2
#: Pseudo-counts: of a bucket's share, of reliabilities, and of a host's or domain's prior.
BUCKET_WEIGHT, RELIABILITY_WEIGHT, PRIOR_WEIGHT = 0.05, 5.0, 10.0
#: A text whose mean log likelihood lies this far below its language's own is in none of them:
#: nats, and standard errors.
GATE_NATS, GATE_ERRORS = 4.0, 6.0
LEAST_POSTERIOR = 0.5

#: What the scan adds to a row of evidence.
SCORES = ("logs", "known", "letters", "likely")
_LETTERS = re.compile(r"\b[^\W\d_]+\b")


def trigrams(text: str) -> np.ndarray:
    """Bucket of every trigram of letters, in lower case, words apart by single blanks."""
    words = _LETTERS.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    packed = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
    return (finish(packed) >> np.uint64(48)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Log shares of the buckets by language, and each language's own mean and variance of them."""

    languages: list[str]
    logs: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    #: Languages whose sample is large enough to say that a text is not in them.
    sure: tuple[str, ...]

    @classmethod
    def from_counts(cls, languages: list[str], counts: np.ndarray) -> Model:
        logs = np.empty((BUCKETS, len(languages)), np.float32)
        mean, variance = np.zeros(len(languages)), np.zeros(len(languages))
        pooled = counts.sum(axis=0, dtype=np.float64) + BUCKET_WEIGHT
        pooled /= pooled.sum()
        totals = counts.sum(axis=1, dtype=np.float64)
        for at, total in enumerate(totals):
            shares = counts[at] + (BUCKET_WEIGHT if total >= LEAST_TRIGRAMS else THIN_WEIGHT * pooled)
            shares = shares / shares.sum()
            own = np.log(shares)
            mean[at] = (shares * own).sum()
            variance[at] = (shares * own**2).sum() - mean[at] ** 2
            logs[:, at] = own
        sure = tuple(x for x, n in zip(languages, totals, strict=True) if n >= LEAST_TRIGRAMS)
        return cls(languages, logs, mean, variance, sure)

    def score(self, text: str) -> tuple[np.ndarray, bool, bool]:
        """Tempered log likelihoods, whether the text is in one of the languages at all, and whether
        it has letters."""
        found = trigrams(text)
        if not len(found):
            return np.zeros(len(self.languages)), False, False
        total = np.zeros(len(self.languages))
        for at in range(0, len(found), 1 << 16):
            total += self.logs[found[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        low = self.mean[best] - GATE_NATS - GATE_ERRORS * np.sqrt(self.variance[best] / len(found))
        return TEMPER * (total - total.max()), bool(total[best] / len(found) >= low), True


def fit(evidence: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Count trigrams on at most ``fit_rows`` whole texts of each declared language.

    Any string may be declared, so only the ``MODELS`` languages of most texts have a model of their
    own, ties by name; all others share the model ``OTHER``. The driver gets at most one row per
    model and bucket; a model takes 256 KB.
    """
    declared = evidence.filter("declared is not null").select("declared", "text")
    ranked = declared.groupBy("declared").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    named = [r["declared"] for r in ranked.orderBy(F.col("n").desc(), "declared").limit(MODELS).collect()]
    labelled = declared.withColumn("declared", F.when(F.col("declared").isin(named), F.col("declared")).otherwise(OTHER))
    sample = sample_by_hash(labelled, fit_rows, "text", by="declared")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch.column("declared").to_pylist(), batch.column("text"), strict=True):
                own = counts.setdefault(language, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for language, own in counts.items():
            used = np.flatnonzero(own)
            yield {"language": [language] * len(used), "bucket": used, "n": own[used]}

    found = arrow_map(sample, count, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    found = durable(found)
    languages = sorted(r["language"] for r in found.select("language").distinct().collect())
    place = {language: at for at, language in enumerate(languages)}
    counts = np.zeros((max(1, len(languages)), BUCKETS), np.float32)
    for r in found.toLocalIterator():
        counts[place[r["language"]], r["bucket"]] = r["n"]
    return Model.from_counts(languages or [UNKNOWN], counts)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _normal(logs: Column) -> Column:
    """Probabilities from logs, in time linear in their number."""

    def shares(raised: Column) -> Column:
        return _let(F.aggregate(raised, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(raised, lambda x: x / total))

    return _let(logs, lambda own: _let(F.array_max(own), lambda top: _let(F.transform(own, lambda x: F.exp(x - top)), shares)))


def _likely(logs: np.ndarray, known: bool) -> list[float]:
    raised = np.exp(logs - logs.max())
    return (raised / raised.sum() if known else np.zeros(len(logs))).tolist()


def _sums(rows: DataFrame, by: list[str], languages: int, tag: str) -> DataFrame:
    """Soft counts of the languages by key, as an array; combined map-side."""
    sums = [F.sum(F.col("likely")[at]).alias(f"_s{at}") for at in range(languages)]
    named = rows.filter(F.col(by[-1]).isNotNull()).groupBy(*by).agg(*sums)
    return named.select(*by, F.array(*[f"_s{at}" for at in range(languages)]).alias(tag))


def identify(evidence: DataFrame, model: Model | None = None) -> DataFrame:
    """Add ``language``, ``posterior``, ``text_language`` and ``kept`` to rows of evidence.

    ``evidence`` has ``text``, ``declared``, ``suffix``, ``host`` and ``domain``, all strings that
    may be null, besides columns of its own, which come back unchanged; one that has the name of a
    result comes back with an underscore in front. Evidence that is null is left out. A text that is
    most like the pooled rare languages has its declared one, or ``other`` where none is declared. A text without letters (null, empty, digits) or unlike every known language has the
    language ``und``; it is not kept, nor is a row whose best posterior is below one half. But a text
    with letters that is unlike every known language has its declared one, with a posterior of one
    half, and is kept, if too few texts declare that language to know it by its trigrams. Ties go
    to the first language by name. Repeated rows count as often as they stand there. An empty
    table gives no rows. Without any declared language every row is ``und``.
    """
    model = model or fit(evidence.withColumn("text", F.coalesce("text", F.lit(""))))
    n = len(model.languages)
    # The caller's columns travel in one, so that their names cannot meet those used here.
    names_own = [c for c in evidence.columns if c not in ("text", "declared", "suffix", "host", "domain")]
    own = ["caller_row"]
    packed = F.struct(*(F.col(f"`{c}`") for c in names_own)) if names_own else F.struct(F.lit(0).alias("none"))
    evidence = evidence.select(packed.alias("caller_row"), "text", "declared", "suffix", "host", "domain")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            scores = [model.score(value.as_py() or "") for value in batch.column("text")]
            columns = {name: batch.column(name) for name in batch.schema.names if name != "text"}
            yield columns | {
                "logs": [s.tolist() for s, _, _ in scores], "known": [k for _, k, _ in scores], "letters": [x for _, _, x in scores],
                "likely": [_likely(s, k) for s, k, _ in scores],
            }

    from pyspark.sql import types as T

    keys = ["declared", "suffix", "host", "domain"]
    carried = [f for f in evidence.schema.fields if f.name != "text"]
    schema = T.StructType([*carried, *[T.StructField(k, t) for k, t in zip(SCORES, (T.ArrayType(T.DoubleType()), T.BooleanType(), T.BooleanType(), T.ArrayType(T.DoubleType())), strict=True)]])
    likely = durable(arrow_map(evidence.select(*own, *keys, "text"), score, _ordered(schema, [*own, *keys])))
    total = likely.agg(*[F.sum(F.col("likely")[at]).alias(f"_s{at}") for at in range(n)]).first()
    shares = np.array([total[at] or 0.0 for at in range(n)]) + 1.0
    all_rows = F.array(*[F.lit(float(x)) for x in shares])
    base = F.array(*[F.lit(float(x)) for x in shares / shares.sum()])

    def prior(counts: Column, parent: Column) -> Column:
        known = F.coalesce(counts, F.array_repeat(F.lit(0.0), n))
        return _let(
            F.aggregate(known, F.lit(0.0), lambda a, b: a + b),
            lambda n_known: F.zip_with(known, parent, lambda c, p: (c + PRIOR_WEIGHT * p) / (n_known + PRIOR_WEIGHT)),
        )

    def reliability(counts: Column) -> Column:
        # Logs of P(value | language), smoothed towards the value's share of all rows.
        return _let(
            F.aggregate(counts, F.lit(0.0), lambda a, b: a + b) / float(shares.sum()),
            lambda value_share: F.zip_with(
                counts, all_rows, lambda c, t: F.log((c + RELIABILITY_WEIGHT * value_share + 1e-9) / (t + RELIABILITY_WEIGHT))
            ),
        )

    nothing = F.array_repeat(F.lit(0.0), n)
    joined = likely
    for key, tag in (("declared", "d_counts"), ("suffix", "s_counts"), ("domain", "m_counts"), ("host", "h_counts")):
        joined = joined.join(_sums(likely, [key], n, tag), key, "left")
    host_prior = prior(F.col("h_counts"), prior(F.col("m_counts"), base))
    fused = F.col("logs")
    for part in (
        F.coalesce(reliability(F.col("d_counts")), nothing),
        F.coalesce(reliability(F.col("s_counts")), nothing),
        F.transform(host_prior, lambda p: F.log(p + 1e-9)),
    ):
        fused = F.zip_with(fused, part, lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in model.languages])
    posteriors = joined.withColumn("chances", _normal(fused))
    results = ("language", "posterior", "text_language", "kept")
    callers = []
    for name in names_own:
        taken = [*results, *(c for c in names_own if c != name)]
        callers.append(F.col("caller_row").getField(name).alias(free_name(taken, name) if name.lower() in results else name))
    best = F.array_max("chances")
    known = F.col("known") & F.lit(model.languages != [UNKNOWN])
    # Only the declaration speaks of a language that is too rare for its trigrams to be known.
    declared = F.col("declared")
    trusted = F.coalesce(~F.col("known") & F.col("letters") & ~declared.isin(list(model.sure)), F.lit(False))
    likeliest = F.element_at(names, F.array_position("chances", best).cast("int"))
    named = F.when(likeliest == OTHER, F.coalesce(declared, likeliest)).otherwise(likeliest)
    return posteriors.select(
        *callers,
        F.when(known, named).when(trusted, declared).otherwise(UNKNOWN).alias("language"),
        F.when(known, best).when(trusted, LEAST_POSTERIOR).otherwise(0.0).alias("posterior"),
        F.when(known, F.element_at(names, F.array_position("logs", F.array_max("logs")).cast("int"))).otherwise(UNKNOWN).alias("text_language"),
        ((known & (best >= LEAST_POSTERIOR)) | trusted).alias("kept"),
    )


def _ordered(schema, first: list[str]):
    from pyspark.sql import types as T

    names = [*first, *SCORES]
    return T.StructType([schema[name] for name in names])


def _text(column: Column) -> Column:
    return column.cast("string")


def document_evidence(docs: DataFrame, own: list[str]) -> DataFrame:
    """Documents with their declared language and their source as the host; they have no address.

    The domain is what sources have in common: the last two parts of a name with dots, else the
    name without the number at its end. Nulls stay nulls.
    """
    source = _text(F.col("source"))
    domain = F.when(source.contains("."), F.substring_index(source, ".", -2)).otherwise(F.nullif(F.regexp_replace(source, "[0-9]+$", ""), F.lit("")))
    return docs.select(
        *own, _text(F.col("text")).alias("text"), F.nullif(_text(F.col("lang")), F.lit("")).alias("declared"),
        F.lit(None).cast("string").alias("suffix"), source.alias("host"), domain.alias("domain"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages with the language of their markup, the language-like part of their address, and host.

    The suffix is the first path segment if it has two letters, else the last part of the host;
    the domain is the last two parts of the host. The text is the markup without tags and scripts.
    A null url has no suffix, host or domain, a null html no text or declared language. Every row
    of ``pages`` gives one row, other columns are not carried.
    """
    url, html = _text(F.col("url")), _text(F.col("html"))
    host = F.lower(F.nullif(F.regexp_extract(url, r"(?s)^.*?://([^/?#:]*)", 1), F.lit("")))
    segment = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*/([A-Za-z]{2})(?:[/?#].*)?$", 1)
    hidden = r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z0-9#]+;"
    return pages.select(
        "page_id",
        F.regexp_replace(html, hidden, " ").alias("text"),
        F.nullif(F.lower(F.substring(F.regexp_extract(html, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1), 1, 8)), F.lit("")).alias("declared"),
        F.when(segment != "", F.lower(segment)).otherwise(F.nullif(F.substring_index(host, ".", -1), F.lit(""))).alias("suffix"),
        host.alias("host"),
        F.substring_index(host, ".", -2).alias("domain"),
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose language is identified.

    Rows are told apart by 128 bits over their evidence and over which of it is null, so null and
    repeated ids stay what they are; rows that are equal in all evidence have equal verdicts. A null
    or empty text goes, repeated rows stay repeated, texts of any length are read whole, and an
    empty table gives no rows.
    """
    key = free_name(docs.columns, "row_key")
    parts = [c for name in ("doc_id", "text", "lang", "source") for c in (F.col(name).isNull(), F.col(name))]
    numbered = docs.withColumn(key, F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in (1, 2))))
    verdicts = identify(document_evidence(numbered, [key])).filter("not kept").select(key).distinct()
    # Rows that are equal in all evidence have equal verdicts, so few keys name what goes.
    return rows_without(numbered, verdicts, key).select(*docs.columns)
