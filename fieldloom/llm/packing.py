"""Packing: token sequences filled by cutting-stock patterns from column generation.

A document is its token ids and an end id. It is cut into full sequences and a tail. Piece lengths are
counted in steps of ``STEP`` tokens, so the histogram has capacity / STEP classes whatever the input.
A linear program over patterns (how many pieces of each class fill one sequence) covers the histogram:
column generation starts from one-class patterns, a knapsack dynamic program prices new columns by the
duals, and a simplex pivot enters the best one. Pattern counts are rounded down and the few pieces left,
a bounded number, are placed first-fit decreasing. Pieces are ranked inside their class, a rank falls into
a range of a pattern, and that names its sequence.

To the driver come only the class counts. Ranks are counted in chunks of ``CHUNK`` pieces with the chunk
totals carried over, so a class that holds most rows is split.

Defined cases: a missing or empty text is its end id alone; repeated rows are packed one by one; a missing
doc_id stays missing; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .tables import keyed_texts, lean

CAPACITY = 2048
STEP = 8
CHUNK = 200_000
END_ID = 1
CACHE = 150_000

# Letters and marks whose lower case and composition do not depend on their neighbours.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)\Z")


if array("I").itemsize != 4 or sys.byteorder != "little":
    raise RuntimeError("token ids are kept as little-endian 32-bit numbers")


@cache
def load_tokenizer(path: str):
    """The tokenizer, and the printable character that stands for each byte in its model."""
    from tokenizers import Tokenizer, pre_tokenizers

    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return Tokenizer.from_file(path), {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(33, 127), *range(192, 256)])}


class WordIds(dict):
    """Ids (little-endian 32-bit) of a space-free part of a text, kept for frequent parts.

    The tokenizer cuts at white space first, so a text is the sequence of its parts. A part of plain letters
    followed by punctuation goes straight to the model; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer, self.bytes = load_tokenizer(path)
        self.model = self.tokenizer.model
        self.units: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # a full cache is kept for one more round, so frequent parts survive
        self.old_units: dict[str, bytes] = {}

    def unit(self, text: str) -> bytes:
        known = self.units.get(text)
        if known is not None:
            return known
        known = self.old_units.get(text)
        if known is None:
            plain = text if text.isascii() else "".join([self.bytes[c] for c in text])  # printable ASCII stands for itself
            known = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
        if len(self.units) >= CACHE:
            self.units, self.old_units = {}, self.units
        self.units[text] = known
        return known

    def __missing__(self, part: str) -> bytes:
        out = self.old.get(part)
        simple = _SIMPLE.match(part) if out is None and len(part) <= 40 else None
        if out is not None:
            pass
        elif simple and not simple[2]:
            out = self.unit(part.lower()) if part else b""
        elif simple:
            out = b"".join([self.unit(x) for x in (simple[1].lower(), simple[2]) if x])
        else:
            out = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        if len(part) <= 24:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[part] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def _pieces(path: str, capacity: int):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)  # for this task only: workers live on and would keep it
        for batch in batches:
            total, starts, lengths, sums = [], [], [], []
            for text in batch.column(1):
                ids = words.encode(text.as_py()) + end
                n = len(ids) // 4
                at = list(range(0, n, capacity))
                total.append(n)
                starts.append(at)
                lengths.append([min(capacity, n - a) for a in at])
                sums.append([zlib.crc32(ids[4 * a:4 * (a + capacity)]) for a in at])
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), *(pa.array(x, many) for x in (starts, lengths, sums))],
                                             names=["doc_id", "doc_tokens", "starts", "lengths", "sums"])

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, doc_tokens, start, length, ids_crc32."""
    rows = keyed_texts(docs).mapInArrow(lean(_pieces(tokenizer, capacity)), "doc_id bigint, doc_tokens bigint, starts array<bigint>, lengths array<bigint>, sums array<bigint>")
    return (rows.select("doc_id", "doc_tokens", F.explode(F.arrays_zip("starts", "lengths", "sums")).alias("p"))
            .select("doc_id", "doc_tokens", F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"), F.col("p.sums").alias("ids_crc32")))


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the worth and the piece counts of the best pattern."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(sizes, room, side="right")
        best[room] = best[room - 1]
        if fits:
            value = best[room - sizes[:fits]] + worth[:fits]
            k = int(value.argmax())
            if value[k] > best[room] + 1e-12:
                best[room], choice[room] = value[k], k
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), counts


def fill_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that use up the demand of each size exactly: column generation, then rounding.

    Every step leaves a feasible plan, so the step bound limits time and never drops a piece.
    """
    n = len(sizes)
    if n == 0:
        return []
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    for step in range(steps):
        if step % 100 == 99:
            inverse = np.linalg.inv(columns)
        worth = inverse.sum(axis=0)
        value, pattern = best_pattern(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        amount, move = (inverse * demand).sum(axis=1), (inverse * pattern).sum(axis=1)  # no threads for so little
        ratio = np.where(move > 1e-9, np.maximum(amount, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = pattern
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
    amount = np.floor(np.linalg.solve(columns, demand) + 1e-6).astype(np.int64)
    left, plan = demand.astype(np.int64).copy(), []
    for k in np.argsort(-amount):
        pattern = columns[:, k].astype(np.int64)
        used = pattern > 0
        times = min(int(amount[k]), int((left[used] // pattern[used]).min()))
        if times > 0:
            plan.append((pattern, times))
            left -= pattern * times
    while left.any():  # what rounding left: first-fit decreasing, whole bins at a time
        pattern, room = np.zeros(n, np.int64), capacity
        for k in range(n - 1, -1, -1):
            take = min(int(left[k]), int(room // sizes[k]))
            pattern[k], room = take, room - take * sizes[k]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and its offset there; offsets run from 0 without gaps."""
    spark = docs.sparkSession
    grade = F.ceil(F.col("length") / STEP).cast("bigint")
    pieces = cut_lineage(cut_pieces(docs, tokenizer, capacity).withColumn("grade", grade))
    found = {r["grade"]: r["n"] for r in pieces.groupBy("grade").agg(F.count("*").alias("n")).collect()}  # capacity / STEP rows at most
    sizes = np.array(sorted(found), np.int64)
    demand = np.array([found[s] for s in sizes], float)
    used, base, ranges = dict.fromkeys(found, 0), 0, []
    for pattern, times in fill_patterns(sizes, demand, capacity // STEP):
        for k in np.flatnonzero(pattern):
            size, each = int(sizes[k]), int(pattern[k])
            ranges.append((size, used[size], used[size] + each * times, base, each))
            used[size] += each * times
        base += times
    plan = spark.createDataFrame(ranges, "grade bigint, low bigint, high bigint, base bigint, each bigint")

    chunks = max(1, math.ceil(sum(found.values()) / CHUNK))
    order = [F.xxhash64("doc_id", "start", "ids_crc32"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(chunks)))
    inside = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("grade", "chunk").orderBy(*order)).cast("bigint") - 1)
    totals = dealt.groupBy("grade", "chunk").agg(F.count("*").alias("n"))
    before = totals.select("grade", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("grade").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = inside.join(before, ["grade", "chunk"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = (ranked.join(F.broadcast(plan), "grade")  # patterns only: their number does not grow with the input
              .where("rank >= low AND rank < high").withColumn("sequence_id", F.expr("base + (rank - low) div each")))
    room = Window.partitionBy("sequence_id").orderBy(F.desc("grade"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(room), F.lit(0))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str) -> DataFrame:
    """sequence_id and its token ids, from documents with unique ids and their placed pieces."""
    spots = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("spots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out = []
            for text, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(words.encode(text) + end, "<u4").astype(np.int64)
                out += [(s["sequence_id"], s["offset"], ids[s["start"]:s["start"] + s["length"]]) for s in row]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))],
                                             names=["sequence_id", "offset", "ids"])

    parts = keyed_texts(docs).join(spots, "doc_id").select("text", "spots").mapInArrow(lean(run), "sequence_id bigint, offset bigint, ids array<bigint>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
