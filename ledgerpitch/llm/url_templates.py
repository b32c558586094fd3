"""URL filter by a tree of path templates per host, in DataFrame operations only.

1. A path is split into segments; digit runs and long hexadecimal strings become placeholders.
2. Level by level, children of a node that has many children become ``*`` where each holds only a
   small share of the node's pages. The level's table has one row per host and generalised path.
3. Branches that differ in one segment are compared with what they hold together: a branch whose
   labelled rate does not differ significantly, or that has no labels, joins the merged branch.
4. A template is rejected by its labelled purity, smoothed towards the rates of its host and of
   the same template on all hosts, which are smoothed towards the rate of all labelled pages.

Rules label the pages they fit, and their verdict stands for these pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerpitch.llm.common import durable

#: Segments with templates of their own; deeper ones are one ``**`` together.
DEPTH = 4
#: A node with more children than this keeps only those with at least the least share of its pages.
MAX_CHILDREN, LEAST_SHARE = 20, 0.02
#: Pseudo-labels behind each prior, the significance bound of a merge, the purity of a rejection.
PRIOR_WEIGHT, MERGE_Z, REJECT_PURITY = 4.0, 1.96, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"


@dataclass(frozen=True)
class Rule:
    action: str
    rule: str

    def fits(self, host: Column, path: Column) -> Column:
        own_host, slash, rest = self.rule.partition("/")
        at_host = (host == own_host) | host.endswith(f".{own_host}")
        return at_host & path.startswith(slash + rest)


def host_of(url: Column) -> Column:
    known = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(known, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, null where none does."""
    found: Column = F.lit(None).cast("string")
    action: Column = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = rule.fits(host, path)
        found = F.when(fits, F.lit(rule.rule)).otherwise(found)
        action = F.when(fits, F.lit(rule.action)).otherwise(action)
    return found, action


def _shapes(path: Column, depth: int) -> Column:
    """Segments with placeholders, the ones beyond ``depth`` as one ``**``."""
    parts = F.split(path, "/")
    segments = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    shaped = F.transform(
        F.slice(segments, 1, depth),
        lambda s: F.regexp_replace(
            F.regexp_replace(s, r"\b(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{16,}\b", "{hex}"), r"[0-9]+", "{n}"
        ),
    )
    return F.when(F.size(segments) > depth, F.concat(shaped, F.array(F.lit("**")))).otherwise(shaped)


def generalised(paths: DataFrame, depth: int, max_children: int, least_share: float) -> DataFrame:
    """Add ``template`` to rows of (host, shapes, pages, ...), one tree level after the other."""
    tree = paths.withColumn("template", F.lit(""))
    for level in range(depth + 1):
        # What follows the last level is kept as it is: nothing or ``**``.
        here = tree.withColumn("segment", F.get("shapes", F.lit(level)))
        children = here.filter("segment is not null").groupBy("host", "template", "segment").agg(
            F.sum("pages").alias("own")
        )
        nodes = children.groupBy("host", "template").agg(
            F.sum("own").alias("all"), F.count("*").alias("children")
        )
        large = nodes.filter(F.col("children") > max_children)
        # Only children of large nodes can lose their name, so only these are looked up.
        dropped = (
            children.join(large, ["host", "template"])
            .filter(F.col("own") < least_share * F.col("all"))
            .select("host", "template", "segment", F.lit(True).alias("variable"))
        )
        named = here.join(dropped, ["host", "template", "segment"], "left")
        tree = durable(
            named.withColumn(
                "template",
                F.when(F.col("segment").isNull(), F.col("template")).otherwise(
                    F.concat("template", F.lit("/"), F.when(F.col("variable"), "*").otherwise(F.col("segment")))
                ),
            ).drop("segment", "variable")
        )
    return tree


def merged(templates: DataFrame, depth: int, z_bound: float) -> DataFrame:
    """Replace ``template`` by ``branch``, in which statistically similar branches are one.

    ``templates`` has one row per host and template with the sums ``labelled`` and ``bad``. The
    branches compared at a level differ in that segment alone; there are at most as many as a node
    has children, which generalisation has bounded.
    """
    rows = templates.withColumn("branch", F.col("template"))
    for level in reversed(range(depth)):
        parts = F.split("branch", "/")
        at = F.lit(level + 2)
        has = F.size(parts) >= at
        wide = F.concat_ws(
            "/", F.slice(parts, 1, level + 1), F.array(F.lit("*")), F.slice(parts, level + 3, F.greatest(F.size(parts), F.lit(1)))
        )
        rows = rows.withColumn("wide", F.when(has, wide).otherwise(F.col("branch")))
        one, group = Window.partitionBy("host", "branch"), Window.partitionBy("host", "wide")
        rows = rows.withColumns({"n1": F.sum("labelled").over(one), "b1": F.sum("bad").over(one)}).withColumns({
            "n": F.sum("labelled").over(group), "b": F.sum("bad").over(group),
            "few": F.min("branch").over(group) == F.max("branch").over(group),
        })
        rate = F.col("b") / F.col("n")
        others = F.col("n") - F.col("n1")
        spread = rate * (1 - rate) * (1 / F.col("n1") + 1 / others)
        gap = F.col("b1") / F.col("n1") - (F.col("b") - F.col("b1")) / others
        alike = F.when((F.col("n1") == 0) | (others == 0), True).otherwise(gap * gap <= z_bound * z_bound * spread)
        rows = rows.withColumn(
            "branch", F.when(~F.col("few") & alike, F.col("wide")).otherwise(F.col("branch"))
        ).drop("wide", "n1", "b1", "n", "b", "few")
    return rows


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    labels: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    depth: int = DEPTH,
    max_children: int = MAX_CHILDREN,
    least_share: float = LEAST_SHARE,
    prior_weight: float = PRIOR_WEIGHT,
    merge_z: float = MERGE_Z,
    reject_purity: float = REJECT_PURITY,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), one row per row of ``pages``.

    ``labels`` (id, bad boolean) may add labelled pages to those the rules label; a page with
    several labels takes the worst. Null urls and urls without ``://`` have an empty host and path
    and share one template. Repeated rows count as often as they stand there; null ids carry no
    added label. Without any label the rate of all pages is taken as 0 and nothing but the rules
    rejects. An empty table gives no rows; other columns are not carried.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    rule, action = longest_rule(rules, F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), action.alias("ruled"), _shapes(F.col("path"), depth).alias("shapes"))
    bad = (F.col("ruled") == "block").cast("long")
    if labels is not None:
        given = labels.groupBy(F.col(labels.columns[0]).alias("page_id")).agg(
            F.max(F.col(labels.columns[1]).cast("long")).alias("given")
        )
        rows = rows.join(given, "page_id", "left")
        bad = F.coalesce(bad, F.col("given"))
    counted = durable(
        rows.groupBy("host", "shapes").agg(
            F.count("*").alias("pages"),
            F.count(bad).alias("labelled"),
            F.coalesce(F.sum(bad), F.lit(0)).alias("bad"),
        )
    )
    named = generalised(counted, depth, max_children, least_share)
    templates = named.groupBy("host", "template").agg(
        F.sum("pages").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
    )
    branches = durable(merged(templates, depth, merge_z))
    total = branches.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    base = F.lit((total["bad"] or 0) / (total["labelled"] or 1))

    def smoothed(bad: str, labelled: str, prior: Column) -> Column:
        return (F.col(bad) + prior_weight * prior) / (F.col(labelled) + prior_weight)

    def sums(by: list[str], tag: str) -> DataFrame:
        return branches.groupBy(*by).agg(F.sum("bad").alias(f"{tag}_bad"), F.sum("labelled").alias(f"{tag}_n"))

    prior = (smoothed("host_bad", "host_n", base) + smoothed("like_bad", "like_n", base)) / 2
    judged = (
        sums(["host", "branch"], "own")
        .join(sums(["host"], "host"), "host")
        .join(sums(["branch"], "like"), "branch")
        .select("host", "branch", smoothed("own_bad", "own_n", prior).alias("purity"))
    )
    by_shape = (
        named.select("host", "shapes", "template")
        .join(branches.select("host", "template", "branch"), ["host", "template"])
        .join(judged, ["host", "branch"])
        .select("host", "shapes", F.col("branch").alias("template"), "purity")
    )
    learnt = F.when(F.col("purity") >= reject_purity, "block").otherwise("allow")
    return rows.join(by_shape, ["host", "shapes"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", learnt).alias("verdict"), "template", "purity"
    )
