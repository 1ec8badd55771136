r"""Spelling variants by asymmetric q-chunks: words one edit apart, each led to its most frequent neighbour.

A run is a maximal match of ``[A-Za-zÀ-ÿ]+`` with A-Z lower-cased. Where 97 divides h, the CRC-32 of
``<doc_id>:<run>``, its code point h % length is deleted (a planted misspelling). Words are the results of at least
``LEAST_LENGTH`` code points that occur ``LEAST_COUNT`` times or more.

Two words are near if one inserted, deleted or replaced code point makes them equal. Of two words the shorter one (or either, if they
are of one length) is cut into two disjoint chunks, its halves; the other one gives the positional grams of that length. One
edit leaves a chunk whole, and the longer word holds it at the same place or one later, so an equi-join on the chunk finds
every pair; the parts left over are verified by edit distance. Grams at places that no chunk can meet are not made.

A chunk that more than ``CROWD`` grams share (a common prefix, a two-letter half of a short word) is not joined: what is left over
on both sides is an instance of the same problem, so it is cut into two chunks again and the key grows, until groups are small or
one letter is left, where the alphabet bounds a group. No pair is lost and no crowded group is ever expanded.

A word's form is its near word of largest n (ties: the first in code-point order) if that n is twice the word's own or more. The root follows
forms to the last, by pointer doubling; n at least doubles on every step, so there are no cycles.

Defined cases: a missing text has no words; a missing doc_id reads as empty; repeated rows count again; an empty table gives no rows; extra
columns are ignored; texts are whole and cost a task memory in proportion to their own length. Runs are told apart by
64-bit hashes inside 8 MB of text and by their bytes everywhere else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from . import bytewords as B
from .tables import join_sized, lean, ship
from .vocabulary import COUNT_BYTES, count_spans, strings

DELETE_EVERY = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
CROWD = 48

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = True
_LETTER[97:123] = True
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one more

#: Runs longer than this are summed one by one.
_SHORT = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the letter runs in UTF-8 bytes."""
    inside = _LETTER[data]
    lead = np.flatnonzero(data == _LEAD)
    inside[lead] = True
    inside[lead + 1] = True
    return B.pieces(inside.view(np.uint8), offsets, np.arange(256) == 0)


def crc_after(start: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span, going on from the CRC-32 of what stands before it."""
    size = ends - starts
    out = start.astype(np.uint32)
    for i in np.flatnonzero(size > _SHORT):
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(start[i]))
    order = np.argsort(-np.where(size > _SHORT, 0, size), kind="stable")
    state, at = ~start[order].astype(np.uint32), starts[order]
    alive = np.searchsorted(-np.where(size > _SHORT, 0, size)[order], -np.arange(_SHORT + 1), side="left")
    for j in range(_SHORT):
        m = alive[j]
        if m == 0:
            break
        state[:m] = CRC[(state[:m] ^ data[at[:m] + j]) & 0xFF] ^ (state[:m] >> 8)
    short = size[order] <= _SHORT
    out[order[short]] = ~state[short]
    return out


_FOUND = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _count(least: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = B.text_bytes(batch.column(1))
            for first, end, part, cuts in B.runs(data, offsets, COUNT_BYTES):
                part = B.FOLD[part]
                starts, ends, row = letter_runs(part, cuts)
                lead = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[first:end]], np.uint32)
                crc = crc_after(lead[row], part, starts, ends)
                hit = crc % every == 0
                points = B.code_points(part)
                whole = np.flatnonzero(~hit & (points[ends] - points[starts] >= least))
                found = count_spans(B.span_hashes(part, starts, ends)[whole], row[whole], np.zeros(end - first, np.int64))
                spans = whole[found.example]
                yield pa.RecordBatch.from_arrays([strings(part, starts[spans], ends[spans]), pa.array(found.n)], schema=_FOUND)
                cut = []
                for i in np.flatnonzero(hit):
                    word = part[starts[i]:ends[i]].tobytes().decode()
                    at = int(crc[i]) % len(word)
                    cut.append(word[:at] + word[at + 1:])
                cut = [w for w in cut if len(w) >= least]
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()), pa.array(np.ones(len(cut), np.int64))], schema=_FOUND)

    return run


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = DELETE_EVERY) -> DataFrame:
    """word, n: the words of all texts, after the planted deletions, with their occurrences."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    found = texts.mapInArrow(lean(_count(least_length, every)), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halves(rows: DataFrame, *also: str) -> DataFrame:
    """Both halves of what is open as a longer key: one half joins the key, the other stays open.

    ``extra`` is 1 on grams of a word that is one longer than the word cut into chunks; a chunk in its second half then stands one later.
    """
    half = F.floor((F.char_length("open") - F.col("extra")) / 2).cast("int")

    def way(mark: str, taken: Column, left: Column) -> Column:
        return F.struct(F.concat("key", F.lit(mark), taken).alias("key"), left.alias("open"))

    head = way("<", F.substring("open", F.lit(1), half), F.substring("open", half + 1, F.char_length("open")))
    tail = way(">", F.substring("open", half + F.col("extra") + 1, F.char_length("open")), F.substring("open", F.lit(1), half + F.col("extra")))
    return rows.select(*also, "word", "extra", F.explode(F.array(head, tail)).alias("way")).select(*also, "word", "extra", "way.*")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: unordered pairs of the distinct ``words`` (column word) that one edit makes equal."""
    size = F.char_length("word")
    chunks = _halves(words.select("word", F.lit(0).alias("extra"), F.concat(size.cast("string"), F.lit("|")).alias("key"), F.col("word").alias("open")))
    extra = F.explode(F.array(F.lit(0), F.lit(1))).alias("extra")
    grams = _halves(words.select("word", extra).select(
        "word", "extra", F.concat((size - F.col("extra")).cast("string"), F.lit("|")).alias("key"), F.col("word").alias("open")))
    found = None
    while True:
        # A key whose chunk has one letter left open is joined at any size: its words differ in two letters at most.
        loads = grams.groupBy("key").agg(F.count("*").alias("grams"), F.max(F.char_length("open") - F.col("extra")).alias("left"))
        crowded = cut_lineage(loads.where((F.col("grams") > crowd) & (F.col("left") > 1)).select("key"))
        left = chunks.select(F.col("word").alias("a"), "key", F.col("open").alias("open_a"))
        right = grams.select(F.col("word").alias("b"), "key", "extra", F.col("open").alias("open_b"))
        quiet = join_sized(right, crowded, "key", "left_anti")
        near = left.join(quiet, "key").where("(extra = 1 OR a < b) AND levenshtein(open_a, open_b, 1) = 1").select("a", "b")
        found = near if found is None else found.unionByName(near)
        if crowded.isEmpty():
            return found.distinct()
        chunks = _halves(cut_lineage(join_sized(chunks, crowded, "key", "left_semi")))
        grams = _halves(cut_lineage(join_sized(grams, crowded, "key", "left_semi")))


def follow(forms: DataFrame) -> DataFrame:
    """word, root: the last form on the way from each word of ``forms`` (word, form), by pointer doubling."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(now.join(ahead, "root", "left"))
        if step.where("next IS NOT NULL").isEmpty():
            return now
        now = step.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = DELETE_EVERY,
                      crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word."""
    words = cut_lineage(word_counts(docs, least_length, least_count, every))
    pairs = near_pairs(words.select("word"), crowd)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("p")).select("p.*")
    rated = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = rated.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("other_n"), "other")).alias("best")).select(
        "word", "n_near", F.col("best.other").alias("other"), (-F.col("best.col1")).alias("other_n"))
    twice = F.col("other_n") >= 2 * F.col("n")
    led = cut_lineage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(twice, F.col("other")).alias("form"), F.when(twice, F.col("other_n")).alias("form_n")))
    roots = follow(led.where("form IS NOT NULL"))
    return led.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
