"""URL filters: a tree of path templates per host, judged by smoothed labelled purity; suffix rules come first.

1. ``split_url``: host and path of a url, as expressions.
2. ``template_tree``: variable segments of each path become wildcards, first by their form (numbers, hex strings),
   then by fan-out, level by level from the root: a parent with many thinly used children gets ``*``.
3. Sibling branches whose labelled bad rates do not differ from their pooled rate are merged.
4. A template is rejected if its purity, smoothed towards its host's rate and that towards the overall rate, reaches
   ``reject_at``.

The tree is built from one row per host and coarse template, never from single pages, so a host with a third of all
pages is summed before any shuffle. Path segments beyond ``max_depth`` generalise to ``**``.

Defined results: a null url or one without ``://`` has empty host and path (one template); urls of any length are read
whole; repeated rows are judged alike; a child whose rate differs from the pooled one by exactly ``similar_z`` is merged;
without labels nothing is rejected by the method; an empty table gives no rows. Input columns with the names of the
results (``RESULTS``) are replaced, all others are left as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_of(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null fields if none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def coarse_template(path: Column, max_depth: int = 8) -> Column:
    """Segments of the path with numbers as ``<n>`` and long hex strings as ``<h>``; a deeper tail as ``**``."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    named = F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-fA-F]{8,}(?![0-9a-zA-Z])", "<h>"), "[0-9]+", "<n>"))
    return F.when(F.size(named) > max_depth, F.concat(F.slice(named, 1, max_depth), F.array(F.lit("**")))).otherwise(named)


def template_tree(pages: DataFrame, bad: str, max_depth: int = 8, max_children: int = 12, min_support: float = 4.0, alpha: float = 8.0, similar_z: float = 1.64) -> DataFrame:
    """One row per (host, coarse): its template and smoothed ``purity``. ``pages``: host, coarse, ``bad`` (null: unlabelled)."""
    leaves = written(
        pages.groupBy("host", "coarse").agg(
            F.count("*").alias("n"), F.count(bad).alias("labelled"), F.coalesce(F.sum(F.col(bad).cast("long")), F.lit(0)).alias("bad")
        ),
        "url-leaves",
    )
    deepest = leaves.agg(F.max(F.size("coarse"))).first()[0] or 0
    tree = leaves.withColumn("template", F.lit(""))
    for level in range(deepest):
        here = F.get("coarse", F.lit(level))
        children = tree.where(here.isNotNull()).groupBy("host", "template", here.alias("child")).agg(F.sum("n").alias("n"))
        # A thin fan: many children with few pages each. Only such parents are kept, so this side is small as a rule.
        fans = children.groupBy("host", "template").agg(F.count("*").alias("k"), F.sum("n").alias("n")).where((F.col("k") > max_children) & (F.col("n") < F.col("k") * min_support))
        fans = written(fans.select("host", "template", F.lit(True).alias("fan")), "url-fans")
        step = F.when(here.isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.when(F.col("fan"), F.lit("*")).otherwise(here)))
        tree = tree.join(fans, ["host", "template"], "left").withColumn("template", F.concat("template", step)).drop("fan")
        tree = written(tree, "url-tree")

    parent = F.regexp_replace("template", "/[^/]*$", "")
    by_template = written(tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).withColumn("parent", parent), "url-templates")
    pooled = by_template.groupBy("host", "parent").agg((F.sum("bad") / F.greatest(F.sum("labelled"), F.lit(1))).alias("rate"))
    z = F.abs(F.col("bad") - F.col("labelled") * F.col("rate")) / F.sqrt(F.greatest(F.col("labelled") * F.col("rate") * (1 - F.col("rate")), F.lit(0.25)))
    branches = by_template.join(written(pooled, "url-pooled"), ["host", "parent"]).withColumn("branch", F.when(z <= similar_z, F.lit("{merged}")).otherwise(F.col("template")))
    branches = written(branches, "url-branches")
    merged = branches.groupBy("host", "parent", "branch").agg(F.sum("labelled").alias("b_labelled"), F.sum("bad").alias("b_bad"))
    overall = by_template.agg(F.sum("bad"), F.sum("labelled")).first()
    base = (overall[0] or 0) / max(overall[1] or 0, 1)
    hosts = by_template.groupBy("host").agg(((F.sum("bad") + alpha * base) / (F.sum("labelled") + alpha)).alias("host_rate"))
    purity = (F.col("b_bad") + alpha * F.col("host_rate")) / (F.col("b_labelled") + alpha)
    judged = branches.join(written(merged, "url-merged"), ["host", "parent", "branch"]).join(written(hosts, "url-hosts"), "host").select("host", "template", "branch", purity.alias("purity"))
    return written(tree.select("host", "coarse", "template").join(written(judged, "url-judged"), ["host", "template"]), "url-verdicts")


RESULTS = ["host", "path", "rule", "verdict", "template", "purity"]


def filter_urls(pages: DataFrame, bad: Column, rules: list[UrlRule], reject_at: float = 0.5, **tree) -> DataFrame:
    """``pages`` with ``RESULTS``. ``bad``: null for an unlabelled page."""
    kept = [c for c in pages.columns if c not in RESULTS]
    host, path = split_url(F.col("url"))
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("_"))
    parsed = pages.select(row.alias("row"), host.alias("host"), path.alias("path"), bad.alias("bad"))
    parsed = parsed.withColumn("coarse", coarse_template(F.col("path"), tree.get("max_depth", 8)))
    verdicts = template_tree(parsed.select("host", "coarse", "bad"), "bad", **tree).select("host", "coarse", "template", "purity")
    judged = parsed.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).join(verdicts, ["host", "coarse"], "left")
    method = F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(F.col("r.verdict"), method).alias("verdict")
    return judged.select(*[F.col("row").getField(c).alias(c) for c in kept], "host", "path", F.col("r.rule").alias("rule"), verdict, "template", "purity")
