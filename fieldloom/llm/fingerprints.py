r"""Document fingerprints: bottom-k sketches of shingle hashes.

Words are the runs ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; a document's set holds the 64-bit hashes of its five-word shingles,
or of the whole sequence if it has fewer words. Its sketch is the ``K`` smallest hashes of the set; a set of fewer is held
whole. As text a sketch is its hashes in ascending order, 16 hexadecimal digits each, so equal texts have equal fingerprints.

The smallest hashes of a union are among the smallest of its parts: sketches of parts merge into the sketch of the whole, in any
order and grouping (``merge_fingerprints``). From two sketches follow

- ``resemblance`` |A and B| / |A or B|: among the K smallest of the union, the share that both hold (standard error at most 1 / (2 sqrt K));
- ``containment`` |A and B| / |A|: the share that B holds among A's hashes up to the largest value which both sketches know fully;
- ``distinct_shingles`` |A|: exact below K, else (K - 1) / (the K-th smallest hash as a part of the whole range).

Each measure is exact as long as the sets have at most K hashes. There is one form for columns (Spark functions over fingerprints) and
one for arrays inside tasks.

Defined cases: a missing text is empty and has the empty fingerprint; two empty sets resemble and contain each other fully, an
empty and another one not at all (the empty one is contained); repeated rows are fingerprinted one by one; an empty table
gives no rows; extra columns are ignored. A text costs a task memory in proportion to its own length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ordered import add_chunks
from ..session import cut_lineage
from . import bytewords as B
from .tables import BROADCAST_ROWS, keyed_texts, lean

K = 256
WORDS = 5
#: Bytes of text handled together in a task.
RUN_BYTES = 2 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle; a text of fewer words has its whole sequence as one."""
    data = B.FOLD[data]
    starts, ends, row = B.pieces(data, offsets, B.SPACE)
    hashes = B.span_hashes(data, starts, ends)
    first, found = B.grams(hashes, row, words)
    held = B.counts(row, len(offsets) - 1)
    begin = np.cumsum(held) - held
    parts, rows = [found], [row[first]]
    for n in range(1, words):
        few = np.flatnonzero(held == n)
        if len(few):
            at = (begin[few][:, None] + np.arange(n)).ravel()
            one, whole = B.grams(hashes[at], row[at], n)
            parts.append(whole)
            rows.append(row[at][one])
    return np.concatenate(parts), np.concatenate(rows)


def sketches(texts: pa.Array, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The k smallest distinct shingle hashes of each text, ascending."""
    out: list[np.ndarray] = []
    data, offsets = B.text_bytes(texts)
    for first, end, part, cuts in B.runs(data, offsets, RUN_BYTES):
        hashes, row = shingles(part, cuts, words)
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))[:len(row)]
        hashes, row = hashes[new], row[new]
        bounds = np.searchsorted(row, np.arange(end - first + 1))
        out += [hashes[a:min(b, a + k)].copy() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def overlap(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance of two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    fresh = np.append(True, ~twice)
    known = min(k, int(fresh.sum()))
    last = np.flatnonzero(fresh)[known - 1]
    return float(twice[:last + 1].sum()) / known


def covered(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set that the second one holds."""
    if not len(a):
        return 1.0
    limit = min([int(s[-1]) for s in (a, b) if len(s) == k], default=2**64 - 1)
    known = a[a <= np.uint64(limit)]
    return float(np.isin(known, b).mean()) if len(known) else 0.0


def cardinality(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[-1]) + 1)


def _hashes(fingerprint: Column) -> Column:
    return F.regexp_extract_all(fingerprint, F.lit("([0-9a-f]{16})"), F.lit(1))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated resemblance of two fingerprint columns."""
    x, y = _hashes(a), _hashes(b)
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, k)
    return F.when((a == "") & (b == ""), F.lit(1.0)).otherwise(F.size(F.array_intersect(union, F.array_intersect(x, y))) / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first fingerprint's set that the second one's holds."""
    x, y = _hashes(a), _hashes(b)

    def limit(s: Column) -> Column:
        return F.when(F.size(s) == k, F.element_at(s, -1)).otherwise(F.lit("f" * 16))

    bound = F.least(limit(x), limit(y))
    known = F.filter(x, lambda h: h <= bound)
    return F.when(a == "", F.lit(1.0)).when(F.size(known) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(known, y)) / F.size(known))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles behind a fingerprint column."""
    last = F.substring(a, -16, 16)
    place = sum((F.conv(F.substring(last, 1 + 8 * i, 8), 16, 10).cast("double") * 2.0 ** (32 * (1 - i)) for i in (0, 1)), F.lit(1.0))
    return F.when(F.length(a) < 16 * k, (F.length(a) / 16).cast("double")).otherwise(F.lit((k - 1) * 2.0**64) / place)


def fingerprint_texts(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_bytes(batch.column(1))
            for first, end, _, _ in B.runs(data, offsets, RUN_BYTES):
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([written(s) for s in sketches(part.column(1), k, words)], pa.string())],
                                                 names=["doc_id", "fingerprint"])

    return keyed_texts(docs).mapInArrow(lean(run), "doc_id bigint, fingerprint string")


def merge_fingerprints(prints: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """The fingerprint of each group's union of sets, one row per group, from the fingerprints of its parts.

    A task keeps only the k smallest distinct hashes of a group before they are dealt out, so a hot group sends k rows a task.
    """
    small = W.partitionBy(*keys).orderBy("hash")
    rows = prints.select(*keys, F.explode_outer(_hashes(F.col("fingerprint"))).alias("hash")).distinct()
    ranked = rows.withColumn("place", F.dense_rank().over(small.orderBy(F.col("hash").asc_nulls_last()))).where(F.col("place") <= k)
    return ranked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("hash")), "").alias("fingerprint"))


_EDITED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
           "kept_in_edited double, n_shingles double")


def _compare(k: int, words: int):
    """Rows of a task in order: each is compared with its edited text and with the row behind it."""
    names = [c.split()[0] for c in _EDITED.split(", ")]

    def judged(rows: list[tuple[int | None, str]], after: list[str]) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, after, strict=True)]
        own = sketches(pa.array([*texts, after[-1]], pa.large_string()), k, words)
        # Every row but the last of a chunk is followed by its own next one; only others are sketched again.
        apart = [i for i in range(len(rows) - 1) if after[i] != texts[i + 1]]
        again = dict(zip(apart, sketches(pa.array([after[i] for i in apart], pa.large_string()), k, words), strict=True))
        new = sketches(pa.array(edited, pa.large_string()), k, words)
        columns = ([i for i, _ in rows], [len(t) for t in texts], [sha256(e.encode()).hexdigest() for e in edited], [written(s) for s in own[:-1]],
                   [written(s) for s in new], [overlap(a, b, k) for a, b in zip(own, new)], [overlap(a, again.get(i, own[i + 1]), k) for i, a in enumerate(own[:-1])],
                   [covered(a, b, k) for a, b in zip(own, new)], [cardinality(s, k) for s in own[:-1]])
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        rows: list[tuple[int | None, str]] = []
        after: list[str] = []
        held = 0
        for batch in batches:
            for chunk, lent, doc, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                now = chunk.as_py(), lent.as_py(), doc.as_py(), text.as_py()
                if last is not None and last[0] == now[0] and not last[1]:
                    rows.append(last[2:])
                    after.append(now[3])
                    held += len(last[3]) + len(now[3])
                    if held >= RUN_BYTES:
                        yield judged(rows, after)
                        rows, after, held = [], [], 0
                last = now
        if rows:
            yield judged(rows, after)

    return run


def with_next(docs: DataFrame) -> DataFrame:
    """chunk, lent, doc_id, text: rows dealt by chunks of a descending order of doc_id, with the first row of the next chunk lent to each.

    Rows without doc_id come first; rows of one doc_id follow a hash of their texts, then the texts. Chunks follow the number of rows, also inside
    one doc_id. Behind the last chunk follows the first.
    """
    texts = keyed_texts(docs).withColumns({"down": -F.col("doc_id").cast("decimal(20,0)"), "tie": F.xxhash64("text")})
    placed = add_chunks(texts, ["down", "tie"], out="chunk")
    heads = placed.groupBy("chunk").agg(F.min(F.struct("down", "tie")).alias("head"))
    by_chunk = W.orderBy("chunk")  # one row per chunk
    lent = heads.withColumn("before", F.coalesce(F.lag("chunk").over(by_chunk), F.max("chunk").over(by_chunk.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    lent = cut_lineage(lent.select("chunk", F.col("head.tie").alias("tie"), F.col("head.down").alias("down"), "before"))
    lent = F.broadcast(lent) if lent.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lent
    p, q = placed.alias("p"), lent.alias("q")
    met = p.join(q, (F.col("p.chunk") == F.col("q.chunk")) & (F.col("p.tie") == F.col("q.tie")) & F.col("p.down").eqNullSafe(F.col("q.down")), "left")
    places = F.array(F.struct(F.col("p.chunk").alias("chunk"), F.lit(0).alias("lent")), F.struct(F.col("q.before").alias("chunk"), F.lit(1).alias("lent")))
    dealt = met.select(F.explode(F.filter(places, lambda x: x["chunk"].isNotNull())).alias("place"), "p.doc_id", "p.text", "p.down", "p.tie")
    return dealt.select("place.*", "doc_id", "text", "down", "tie")


def compare_edited(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that of the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document, in
    descending order of doc_id; after the last document comes the first. One shuffle moves the texts; no window holds them.
    """
    placed = with_next(docs)
    sorted_rows = placed.repartition("chunk").sortWithinPartitions("chunk", "lent", F.col("down").asc_nulls_first(), "tie", "text")
    return sorted_rows.select("chunk", "lent", "doc_id", "text").mapInArrow(lean(_compare(k, words)), _EDITED)
