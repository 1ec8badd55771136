"""Line dedup by pairwise alignment: shared line runs find the pairs, patience diff aligns them.

A line is compared without white space at its ends; lines without a word are skipped. A run is the shortest
row of lines from a start that has ``min_words`` words or more, so two documents with a common block of that
size share the run at its start. Each run met in two documents links every later holder to its first (the
smallest doc_id): a pair per holder, never all pairs, however frequent the run. For each pair the line hashes
are aligned, and blocks of aligned neighbouring lines with ``min_words`` words go from the later document.
Rare lines, unique on both sides, are the anchors. Blocks that one alignment cannot hold, because the two documents
have them in another order or a different number of times, are then looked up in the same holder and go too, so no
run that any earlier document holds stays. The first holder keeps its lines, so every text survives once.

Pairs are judged on the input, not on what other pairs left. Defined cases: a missing text is empty; a row
without doc_id loses nothing and is no partner; repeated rows of a doc_id are never paired with one another,
and each is judged by its own text; extra columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import bytewords as B
from .tables import join_sized, lean, ship

MASK_ROWS = 200_000


def _hash_lines(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, hashes, sizes, grams = [], [], [], []
            data, offsets = B.text_bytes(batch.column(2))
            for first, end, part, cuts in B.runs(data, offsets):
                starts, ends, _ = B.pieces(part, cuts, B.SPACE)
                low, high, row = B.lines(part, cuts)
                a, b = np.searchsorted(starts, low), np.searchsorted(starts, high)
                index = np.arange(len(row)) - np.searchsorted(row, row)
                full = np.flatnonzero(b > a)
                value = B.span_hashes(part, starts[a[full]], ends[b[full] - 1])
                row, index, words = row[full], index[full], (b - a)[full]
                total = np.concatenate([[0], np.cumsum(words)])
                stop = np.searchsorted(total, total[:-1] + min_words)  # lines of the run: i .. stop - 1
                inside = stop <= len(row)
                inside[inside] &= row[stop[inside] - 1] == row[inside]
                i = np.flatnonzero(inside)
                run_hash = np.zeros(len(i), np.uint64)
                length = stop[i] - i
                for n in np.unique(length):  # equal runs have equally many lines
                    pick = length == n
                    acc = np.zeros(pick.sum(), np.uint64)
                    for j in range(n):
                        acc = B.mix(acc + value[i[pick] + j])
                    run_hash[pick] = acc
                bounds = np.searchsorted(row, np.arange(end - first + 1))
                run_bounds = np.searchsorted(row[i], np.arange(end - first + 1))
                for k in range(end - first):
                    s = slice(bounds[k], bounds[k + 1])
                    places.append(index[s].astype(np.int32))
                    hashes.append(value[s].view(np.int64))
                    sizes.append(words[s].astype(np.int32))
                    grams.append(np.unique(run_hash[run_bounds[k]:run_bounds[k + 1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64())),
                 pa.array(sizes, pa.list_(pa.int32())), pa.array(grams, pa.list_(pa.int64()))], names=["doc_id", "version", "places", "hashes", "sizes", "runs"])

    return run


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of (left, right), given by rising right, whose left rises too."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (left, _) in enumerate(pairs):
        at = bisect_left(tops, left)
        back[k] = last[at - 1] if at else -1
        if at == len(tops):
            tops.append(left)
            last.append(k)
        else:
            tops[at], last[at] = left, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _gap(left: list, right: list, a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """Matches of left[a:b] and right[c:d]: equal ends first, then the n-th copy of a line with the n-th."""
    out = []
    while a < b and c < d and left[a] == right[c]:
        out.append((a, c))
        a, c = a + 1, c + 1
    while a < b and c < d and left[b - 1] == right[d - 1]:
        b, d = b - 1, d - 1
        out.append((b, d))
    if a < b and c < d:
        seen: Counter = Counter()
        place = {}
        for i in range(a, b):
            seen[left[i]] += 1
            place[left[i], seen[left[i]]] = i
        seen.clear()
        pairs = []
        for j in range(c, d):
            seen[right[j]] += 1
            i = place.get((right[j], seen[right[j]]))
            if i is not None:
                pairs.append((i, j))
        out += _rising(pairs)
    return out


def align(left: list, right: list) -> list[tuple[int, int]]:
    """Patience diff: aligned positions of two lists, anchored at values unique on both sides."""
    once_left, once_right = Counter(left), Counter(right)
    place = {v: i for i, v in enumerate(left) if once_left[v] == 1}
    anchors = _rising([(place[v], j) for j, v in enumerate(right) if once_right[v] == 1 and v in place])
    out, a, c = [], 0, 0
    for i, j in [*anchors, (len(left), len(right))]:
        out += _gap(left, right, a, i, c, j)
        if i < len(left):
            out.append((i, j))
        a, c = i + 1, j + 1
    return sorted(out, key=lambda p: p[1])


def _shortest(words: list[int], min_words: int) -> set[tuple[int, int]]:
    """The shortest rows with ``min_words`` words from each line on and back from each line. They fill every block."""
    total = [0, *accumulate(words)]
    onward = ((i, bisect_left(total, total[i] + min_words)) for i in range(len(words)))
    back = ((bisect_right(total, total[j] - min_words) - 1, j) for j in range(1, len(total)))
    return {(a, b) for a, b in (*onward, *back) if 0 <= a < b < len(total)}


def _moved(left: list, right: list, sizes: list[int], min_words: int, gone: set[int]) -> set[int]:
    """Lines of ``right`` outside ``gone`` in blocks that stand anywhere in ``left``."""
    known = set(left)
    shared = [x in known for x in right]
    if all(j in gone for j, x in enumerate(shared) if x):
        return set()
    size = dict(zip(right, sizes, strict=True))
    open_rows = [(a, b) for a, b in _shortest([w if x else 0 for w, x in zip(sizes, shared, strict=True)], min_words)
                 if all(shared[a:b]) and not gone.issuperset(range(a, b))]
    if not open_rows:
        return set()
    held = {tuple(left[a:b]) for a, b in _shortest([size.get(x, 0) for x in left], min_words)}
    return {j for a, b in open_rows if tuple(right[a:b]) in held for j in range(a, b)} - gone


def common_blocks(left: list, right: list, sizes: list[int], min_words: int) -> list[int]:
    """Positions in ``right`` of blocks of neighbouring lines with ``min_words`` words or more that ``left`` holds.

    Aligned blocks first, then those in another order.
    """
    gone: list[int] = []
    block: list[int] = []
    before = None
    for i, j in [*align(left, right), (-9, -9)]:
        if before is not None and (i, j) != (before[0] + 1, before[1] + 1):
            if sum(sizes[x] for x in block) >= min_words:
                gone += block
            block = []
        block.append(j)
        before = (i, j)
    return gone + sorted(_moved(left, right, sizes, min_words, set(gone)))


def _align_pairs(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for left, right, sizes, places in zip(*(batch[c].to_pylist() for c in ("left", "hashes", "sizes", "places")), strict=True):
                gone.append([places[j] for j in common_blocks(left, right, sizes, min_words)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["version"], pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "version", "gone"])

    return run


def repeated_lines(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """(doc_id, version, gone): line numbers from 0 that go; version is the hash of the row's text."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text")).where("doc_id IS NOT NULL")
    hashed = cut_lineage(rows.mapInArrow(lean(_hash_lines(min_words)), "doc_id bigint, version bigint, places array<int>, hashes array<bigint>, sizes array<int>, runs array<bigint>"))
    runs = hashed.select("doc_id", "version", F.explode("runs").alias("run"))
    first = (runs.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
             .where("first < last").select("run", "first"))
    pairs = runs.join(first, "run").where("doc_id > first").select("doc_id", "version", "first").distinct()
    lines = hashed.select("doc_id", "version", "places", "hashes", "sizes")
    both = (pairs.join(lines.dropDuplicates(["doc_id", "version"]), ["doc_id", "version"])
            .join(hashed.select(F.col("doc_id").alias("first"), F.col("version").alias("of"), F.col("hashes").alias("left")).dropDuplicates(["first", "of"]), "first"))
    found = both.select("doc_id", "version", "left", "hashes", "sizes", "places").mapInArrow(lean(_align_pairs(min_words)), "doc_id bigint, version bigint, gone array<int>")
    return (found.where(F.size("gone") > 0).groupBy("doc_id", "version")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")))


def drop_repeated_lines(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """All columns of ``docs`` with the shorter text, and n_lines and n_removed (bigint) behind them."""
    masks = cut_lineage(repeated_lines(docs, min_words))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    text = F.coalesce(F.col(names["text"]).cast("string"), F.lit(""))
    keyed = plain.withColumn("doc_id", F.col(names["doc_id"]).cast("bigint")).withColumn("version", F.xxhash64(text))
    joined = join_sized(keyed, masks, ["doc_id", "version"], "left", MASK_ROWS, "gone")
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col(names["text"])).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return joined.select(*[(left if c == "text" else F.col(n)).alias(c) for c, n in names.items()],
                         F.size(lines).cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"))
