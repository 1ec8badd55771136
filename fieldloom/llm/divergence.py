r"""Source divergence audit by count-cell ranking: how far each source of a language is from the others, and by which terms.

Terms are the runs ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` of a text, A-Z lower-cased: ASCII letters and everything beyond
ASCII. A language keeps its V terms that stand in at least ``MIN_DOCS`` of its documents. A group is a (lang, source)
that occurs; group and language give a kept term with ``count`` occurrences p = 1 + floor(10^9 (count + 1) / (N + V)), N the sum of
the counts over kept terms. Two such values differ by f = floor((p - q)^2 / q).

f depends on two counts only, so it is never evaluated per term. Terms are grouped into cells: for a group against its
language the cell is (group count, language count); cells of one value merge, levels are ranked by their cumulative
number of terms, and only the terms of levels that start within the first ``TOP`` ranks are expanded, in UTF-8 order. For
two sources the cell is the pair of their counts. Terms that only one of them or neither has follow from the number of terms
per count of each source, so no row is made for an absent term.

Everything is whole-number arithmetic: long, and decimal(38) where a corpus of any size could pass 64 bits.

Defined cases: a missing text, lang or source is empty; each row is a document, so repeated rows count again; a
group without terms has N = 0; a language without kept terms (V = 0) has the value 0 for every pair and no term rows;
equal values rank in UTF-8 order of the item; an empty table gives no rows; extra columns are ignored. Terms are told apart by
64-bit hashes inside a run of 8 MB of text and by their bytes everywhere else. Texts are whole and cost a task memory in
proportion to their own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from . import bytewords as B
from .tables import lean, ship
from .vocabulary import COUNT_BYTES, count_spans, strings

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000

#: Bytes between terms: all of ASCII but its letters.
APART = np.ones(256, bool)
APART[128:] = False
APART[65:91] = False
APART[97:123] = False

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by (lang, source, term) of each run of texts; a row without term says that the group occurs."""
    for batch in batches:
        lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
        pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        groups, group = np.unique(pair, return_inverse=True)
        langs = lang.dictionary.take(pa.array(groups // max(1, len(source.dictionary))))
        sources = source.dictionary.take(pa.array(groups % max(1, len(source.dictionary))))
        none = np.zeros(len(groups), np.int64)
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(groups), pa.string()), pa.array(none), pa.array(none)], schema=_COUNTS)
        data, offsets = B.text_bytes(batch.column(2))
        for first, end, part, cuts in B.runs(data, offsets, COUNT_BYTES):
            part = B.FOLD[part]
            starts, ends, row = B.pieces(part, cuts, APART)
            found = count_spans(B.span_hashes(part, starts, ends), row, group[first:end])
            at = pa.array(found.group)
            yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), strings(part, starts[found.example], ends[found.example]),
                                              pa.array(found.n), pa.array(found.rows)], schema=_COUNTS)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of every term by group, and one row without term per group."""
    ship(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    raw = texts.mapInArrow(lean(_count), "lang string, source string, term string, n bigint, docs bigint")
    return raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, total, lead: kept terms by group with the language's count; groups themselves have no term.

    ``lead`` marks one row of each term of a language. The windows span the sources of one term.
    """
    term = W.partitionBy("lang", "term")
    counted = term_counts(docs).withColumns({
        "total": F.sum("n").over(term), "in_docs": F.sum("docs").over(term),
        "lead": (F.row_number().over(term.orderBy("source")) == 1).cast("bigint")})
    return counted.where(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).select("lang", "source", "term", "n", "total", "lead")


def scaled_share(count: Column, total: Column, terms: Column) -> Column:
    """p = 1 + floor(SCALE (count + 1) / (total + terms)), exact for counts of any size; 1 where nothing is kept."""
    wide = (count + 1).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.call_function("div", wide, F.nullif((total + terms).cast("decimal(28,0)"), F.lit(0).cast("decimal(28,0)")))
    return F.lit(1) + F.coalesce(whole, F.lit(0))


def divergence(p: Column, q: Column) -> Column:
    """f = floor((p - q)^2 / q); shares are at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _times(count: Column, value: Column) -> Column:
    return count.cast("decimal(18,0)") * value.cast("decimal(20,0)")


def group_totals(kept: DataFrame) -> DataFrame:
    """lang, source, group_n, lang_n, terms: every group with its N, its language's N and V."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.sum(F.when(F.col("term").isNotNull(), F.col("lead"))).alias("leads"))
    whole = sums.groupBy("lang").agg(F.sum("group_n").alias("lang_n"), F.coalesce(F.sum("leads"), F.lit(0)).alias("terms"))
    return sums.join(whole, "lang").select("lang", "source", "group_n", "lang_n", "terms")


def term_ranks(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of the terms a group uses more than its language does, to the rank ``top``."""
    place = ["lang", "source", "n", "total"]
    used = kept.where("term IS NOT NULL AND n > 0")
    p, q = scaled_share(F.col("n"), F.col("group_n"), F.col("terms")), scaled_share(F.col("total"), F.col("lang_n"), F.col("terms"))
    cells = used.groupBy(*place).agg(F.count("*").alias("held")).join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).where(
        "p > q").withColumn("value", divergence(F.col("p"), F.col("q")))
    falling = W.partitionBy("lang", "source").orderBy(F.desc("value"))
    levels = cells.groupBy("lang", "source", "value").agg(F.sum("held").alias("held"))
    first = levels.withColumn("level", F.row_number().over(falling)).where(F.col("level") <= top)
    before = F.coalesce(F.sum("held").over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = first.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value")
    wanted = cells.join(ranked, ["lang", "source", "value"]).select(*place, "value")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return used.join(wanted, place).select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", rank).where(F.col("rank") <= top)


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the sum of f over all kept terms, for every source and every other one of its language."""
    used = kept.where("term IS NOT NULL AND n > 0").select("lang", "source", "term", "n")
    zero = groups.select("lang", "source", "group_n", "terms", scaled_share(F.lit(0), F.col("group_n"), F.col("terms")).alias("none"))

    def side(name: str) -> DataFrame:
        return zero.select("lang", F.col("source").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("group_n", "terms", "none")])

    def share(name: str) -> Column:
        return scaled_share(F.col(f"n_{name}"), F.col(f"group_n_{name}"), F.col(f"terms_{name}"))

    def ways(a: Column, b: Column) -> Column:
        """Rows for both directions of a pair: source, item, value."""
        return F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), a.alias("value")),
                                 F.struct(F.col("b").alias("source"), F.col("a").alias("item"), b.alias("value")))).alias("way")

    # Every term as if neither had it, then each source's own terms as if the other had none, then the terms of both.
    neither = side("a").join(side("b"), "lang").where("a <> b").select(
        "lang", F.struct(F.col("a").alias("source"), F.col("b").alias("item"),
                         _times(F.col("terms_a"), divergence(F.col("none_a"), F.col("none_b"))).alias("value")).alias("way"))
    counts = used.groupBy("lang", F.col("source").alias("a"), F.col("n").alias("n_a")).agg(F.count("*").alias("held"))
    single = counts.join(side("a"), ["lang", "a"]).withColumn("p", share("a")).join(side("b"), "lang").where("a <> b")
    p, none_a, none_b = F.col("p"), F.col("none_a"), F.col("none_b")
    alone = single.select("lang", ways(_times(F.col("held"), divergence(p, none_b) - divergence(none_a, none_b)),
                                       _times(F.col("held"), divergence(none_b, p) - divergence(none_b, none_a))))
    left, right = (used.select("lang", "term", F.col("source").alias(s), F.col("n").alias(f"n_{s}")) for s in ("a", "b"))
    cells = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "n_a", "n_b").agg(F.count("*").alias("held"))
    shared = cells.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).withColumns({"p": share("a"), "q": share("b")})
    q = F.col("q")
    both = shared.select("lang", ways(
        _times(F.col("held"), divergence(p, q) - divergence(p, none_b) - divergence(none_a, q) + divergence(none_a, none_b)),
        _times(F.col("held"), divergence(q, p) - divergence(q, none_a) - divergence(none_b, p) + divergence(none_b, none_a))))
    parts = neither.unionByName(alone).unionByName(both).select("lang", "way.*")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources (``pair``) and the ``top`` terms (``term``) of every group."""
    kept = cut_lineage(kept_terms(docs, min_docs))
    groups = cut_lineage(group_totals(kept))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(kept, groups).withColumn("rank", rank)
    return pairs.withColumn("part", F.lit("pair")).unionByName(term_ranks(kept, groups, top).withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank")
