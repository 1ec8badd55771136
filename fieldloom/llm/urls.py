r"""URL filters: fixed host and path rules, then a tree of path templates judged by labelled purity.

The tree is grown level by level with aggregates over (host, template so far, segment), so a host with most of
the rows is only ever a sum. On each level a segment that looks like a value (digits, long hex, a date) or
which stands among siblings whose share of bad labels does not differ from its own (two-proportion z-test) merges into the
wildcard ``*``, and the others keep their name. Levels go on as long as a template holds two paths that go deeper; a path
that is alone needs no further level, its other segments follow as they are (values as ``*``).

A template is rejected where its share of good labels, smoothed towards the host's and the host's towards the
whole table's, stays below ``least_good`` with at least ``least_labels`` labels.

Defined cases: a missing url, or one without ``://``, has an empty host and path; repeated rows are judged one by
one; rows without page_id keep their place and count as unlabelled; no labels at all allow every page that no rule
blocks; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

#: The production rules: (host and path, verdict). A rule fits its host and all subdomains.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

VALUE = r"^(?:[0-9]+(?:[._-][0-9]+)*|[0-9a-f]{16,}|.*[0-9]{4,}.*)(?:\.[a-z]{2,5})?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules see them."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        cut = rule.index("/")
        domain, start = rule[:cut], rule[cut:]
        out = F.when(((host == domain) | host.endswith("." + domain)) & path.startswith(start), rule).otherwise(out)
    return out


def template_tree(pages: DataFrame, z: float = 2.58) -> DataFrame:
    """(host, path, template) of the distinct paths in ``pages`` (host, path, n, labelled, bad)."""
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    now = pages.withColumn("segments", segments).withColumn("template", F.lit(""))
    level = 0
    while True:
        segment = F.get("segments", F.lit(level))
        own = now.withColumn("segment", F.when(F.lower(segment).rlike(VALUE), "*").otherwise(segment))
        child = own.where("segment IS NOT NULL").groupBy("host", "template", "segment").agg(F.sum("labelled").alias("cl"), F.sum("bad").alias("cb"))
        parent = child.groupBy("host", "template").agg(F.sum("cl").alias("pl"), F.sum("cb").alias("pb"), F.count("*").alias("siblings"))
        rate = F.col("pb") / F.greatest("pl", F.lit(1))
        spread = F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.01)) * (1 / F.greatest("cl", F.lit(1)) + 1 / F.greatest(F.col("pl") - F.col("cl"), F.lit(1))))
        apart = F.abs(F.col("cb") / F.greatest("cl", F.lit(1)) - (F.col("pb") - F.col("cb")) / F.greatest(F.col("pl") - F.col("cl"), F.lit(1))) > z * spread
        merge = (F.col("segment") == "*") | (F.col("siblings") > 1) & ~apart
        named = child.join(parent, ["host", "template"]).select("host", "template", "segment", F.when(merge, "*").otherwise(F.col("segment")).alias("name"))
        step = F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))
        now = cut_lineage(own.join(named, ["host", "template", "segment"], "left").withColumn("template", step).drop("segment", "name"))
        level += 1
        deeper = now.where(F.size("segments") > level)
        if deeper.isEmpty():
            break
        alone = deeper.groupBy("host", "template").agg(F.count("*").alias("paths")).where("paths = 1").select("host", "template", F.lit(True).alias("alone"))
        rest = F.transform(F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0))), lambda x: F.when(F.lower(x).rlike(VALUE), "*").otherwise(x))
        last = F.col("alone").isNotNull() & (F.size("segments") > level)
        now = cut_lineage(now.join(alone, ["host", "template"], "left").withColumn(
            "template", F.when(last, F.concat("template", F.lit("/"), F.array_join(rest, "/"))).otherwise(F.col("template"))).withColumn(
            "segments", F.when(last, F.slice("segments", 1, level)).otherwise(F.col("segments"))).drop("alone"))
        if now.where(F.size("segments") > level).isEmpty():
            break
    return now.select("host", "path", "template", "n", "labelled", "bad")


def judge_pages(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, least_good: float = 0.5,
                least_labels: int = 5, weight: float = 5.0) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every page; ``labels`` has page_id and bad (0 or 1)."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    one = (labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("page_id").cast("bigint").alias("page_id"))
           .agg(F.avg(F.col("bad").cast("double")).alias("bad")))
    paths = cut_lineage(rows.join(one, "page_id", "left").groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("bad").cast("double").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")))
    tree = template_tree(paths)
    whole = paths.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()
    base = (whole["b"] or 0.0) / max(whole["l"] or 0.0, 1.0)
    hosts = tree.groupBy("host").agg(((F.sum("bad") + weight * base) / (F.sum("labelled") + weight)).alias("host_bad"))
    leaves = (tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).join(hosts, "host")
              .select("host", "template", "l", (1 - (F.col("b") + weight * F.col("host_bad")) / (F.col("l") + weight)).alias("purity")))
    judged = cut_lineage(tree.select("host", "path", "template").join(leaves, ["host", "template"]))
    bad = (F.col("purity") < least_good) & (F.col("l") >= least_labels)
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = reduce(lambda acc, r: F.when(F.col("rule") == r[0], r[1]).otherwise(acc), rules, F.when(bad, "block").otherwise("allow"))
    # The judged paths are a written table: Spark broadcasts or shuffles it by its measured size.
    return (rows.join(judged, ["host", "path"], "left").withColumn("rule", rule)
            .select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity"))
