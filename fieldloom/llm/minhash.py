r"""Near-duplicates: an inverted join over signature coordinates, links confirmed on full shingle sets.

A text is lower-cased (A-Z) and cut into words ``[^\x20\x09-\x0D]+``; its set holds the distinct
5-word shingles as 64-bit hashes. Texts with equal sets form a class; one of each goes on.

* Each class has ``COORDINATES`` minima. The first ``POSTED`` are posted as (coordinate, value) elements.
  Two sets of the threshold similarity agree in at least T posted coordinates (all but one in a million),
  so elements met once are dropped, a document with fewer than T others has no partner, and by the
  prefix rule only its rarest c - T + 1 elements need posting (rarest first).
* The posting list of an element is cut into blocks of about BLOCK documents. Inside a block collisions are counted
  over all coordinates (one byte each).
  Round one emits a spanning forest of the pairs above the match threshold in each block, never all pairs.
  Bridging rounds do the same with one document of each component of a list that has several blocks, until they
  find no link any more: a component of any number of near copies is put together from rows in proportion to it.
  The last round skips lists whose documents are linked already. In the others a group is a pair of blocks, at most
  about 2 * BLOCK documents: every remaining pair between different components is confirmed inside its group, in
  the first list that both share, and only links that join components are emitted. So no link is lost and no row
  stands for a pair that fails.
* Links are confirmed on the full sets; components come from alternating star steps.

Lists, signatures and sets belong to a text, keyed by (doc_id, digest of its set); links are made of doc_ids.

Defined cases: a text without words has an empty set and stands alone; rows that repeat a doc_id are one
document linked by any of its texts; a row without doc_id stands alone and is kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from . import bytewords as B
from .components import components
from .tables import join_sized, keyed_texts, lean, semi_join_ids

SHINGLE = 5
COORDINATES = 128
POSTED = 32
BLOCK = 1024
LOST = 1e-6

_RANDOM = np.random.RandomState(77003)
FLIP = _RANDOM.randint(0, 2**32, COORDINATES, dtype=np.uint64).astype(np.uint32)
SPREAD = (_RANDOM.randint(0, 2**31, COORDINATES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
MIX = np.uint32(0x9E3779B1)


def least_matches(coordinates: int, similarity: float) -> int:
    """The most matches that sets of this similarity fall short of with a chance below LOST."""
    below = 0.0
    for x in range(coordinates + 1):
        below += comb(coordinates, x) * similarity**x * (1 - similarity) ** (coordinates - x)
        if below > LOST:
            return x
    return coordinates


def _shingles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, shingle hashes in row order, n + 1 bounds of the rows."""
    data, offsets = B.text_bytes(texts)
    for first, end, part, cuts in B.runs(data, offsets):
        starts, ends, row = B.pieces(part, cuts, B.SPACE)
        hashes = B.span_hashes(B.FOLD[part], starts, ends)
        n_words = B.counts(row, end - first)
        at, gram = B.grams(hashes, row, SHINGLE)
        owner, value = [row[at]], [gram]
        for n in range(1, SHINGLE):
            short = n_words[row] == n
            if short.any():
                at, gram = B.grams(hashes[short], row[short], n)
                owner.append(row[short][at])
                value.append(gram)
        owner, value = np.concatenate(owner), np.concatenate(value)
        order = np.argsort(owner, kind="stable")
        yield first, value[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=end - first))])


def _mixed_bytes(minima: np.ndarray) -> np.ndarray:
    """One byte of each minimum that depends on all its bits: the high ones of a long text are nearly always zero."""
    return ((minima * MIX) >> np.uint32(24)).astype(np.uint8)


def _digest(own: np.ndarray) -> bytes | None:
    return blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, digest, posts, signs = [], [], [], []
        for _, value, bounds in _shingles(batch.column(1)):
            full = np.flatnonzero(np.diff(bounds))
            minima = np.zeros((len(bounds) - 1, COORDINATES), np.uint32)
            if len(full):
                x = (value >> np.uint64(32)).astype(np.uint32)
                for k in range(COORDINATES):
                    minima[full, k] = np.minimum.reduceat((x ^ FLIP[k]) * SPREAD[k], bounds[full])
            element = minima[:, :POSTED].astype(np.int64) | (np.arange(POSTED) << 32)
            for i in range(len(bounds) - 1):
                own = np.unique(value[bounds[i]:bounds[i + 1]])
                count.append(len(own))
                digest.append(_digest(own))
                posts.append(element[i])
            signs += [m.tobytes() for m in _mixed_bytes(minima)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(posts, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "posts", "sign"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(value[bounds[i]:bounds[i + 1]]) for _, value, bounds in _shingles(batch.column(1)) for i in range(len(bounds) - 1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))],
            names=["doc_id", "digest", "shingles"])


def _agreement(sign: np.ndarray) -> np.ndarray:
    """Matrix of the number of equal coordinates."""
    total = np.zeros((len(sign), len(sign)), np.uint8)
    for k in range(sign.shape[1]):
        column = sign[:, k]
        total += column[:, None] == column[None, :]
    return total


def _forest(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A maximum spanning forest over the pairs with at least ``least`` matches."""
    n = len(equal)
    best, parent, out = np.zeros(n, np.int16), np.full(n, -1), np.zeros(n, bool)
    edges = []
    for _ in range(n):
        open_best = np.where(out, -1, best)
        i = int(open_best.argmax())
        if parent[i] >= 0:
            edges.append((int(parent[i]), i))
        out[i] = True
        better = (equal[i] >= least) & (equal[i] > best) & ~out
        best[better], parent[better] = equal[i][better], i
    return edges


def _shared_before(elem: int, prefixes: list[np.ndarray]) -> np.ndarray:
    """Matrix of the documents that share a smaller posted element too, whose list takes the pair."""
    n = len(prefixes)
    owner = np.repeat(np.arange(n), [len(p) for p in prefixes])
    value = np.concatenate(prefixes)
    early = value < elem
    owner, (_, column) = owner[early], np.unique(value[early], return_inverse=True)
    out = np.zeros((n, n), bool)
    used = np.flatnonzero(np.bincount(column) > 1) if len(column) else []
    for at in range(0, len(used), 1024):
        place = np.full(column.max() + 1, -1)
        place[used[at:at + 1024]] = np.arange(len(used[at:at + 1024]))
        hit = place[column] >= 0
        matrix = np.zeros((n, 1024), np.float32)
        matrix[owner[hit], place[column[hit]]] = 1
        out |= matrix @ matrix.T > 0
    return out


def _links(need: np.ndarray, sets: list[np.ndarray], comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among the needed pairs (i < j), without those between components that are joined already."""
    size = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(ids, np.cumsum(size)[:-1])
    mark, comp, out = np.zeros(int(ids.max()) + 1, bool), comp.copy(), []
    for i in np.flatnonzero(need.any(axis=1)):
        j = np.flatnonzero(need[i] & (comp != comp[i]))
        if not len(j):
            continue
        mark[own[i]] = True
        both = np.add.reduceat(mark[np.concatenate([own[x] for x in j])], np.concatenate([[0], np.cumsum(size[j])[:-1]]), dtype=np.int64)
        mark[own[i]] = False
        for x in j[100 * both >= percent * (size[i] + size[j] - both)]:
            if comp[x] != comp[i]:
                out.append((int(i), int(x)))
                comp[comp == comp[x]] = comp[i]
    return out


def _matcher(least: int, percent: int | None = None):
    """Pairs of each group of rows that come in group order (elem, lo, hi).

    Without ``percent``: a spanning forest of the pairs with ``least`` matches, to be confirmed. With it:
    confirmed links between different components, from rows that carry prefix and shingles too. A doc_id may have
    several texts in a group; a row of a pair has its texts' digests beside the doc_ids, the smaller doc_id first.
    """
    Pair = tuple[int, bytes, int, bytes]

    def solve(group: pa.RecordBatch) -> list[Pair]:
        doc, text = group["doc_id"].to_numpy(), group["digest"].to_pylist()
        keep = [i for i in range(len(doc)) if i == 0 or doc[i] != doc[i - 1] or text[i] != text[i - 1]]
        group, doc, text = group.take(pa.array(keep)), doc[keep], [text[i] for i in keep]
        equal = _agreement(np.frombuffer(b"".join(group["sign"].to_pylist()), np.uint8).reshape(len(doc), -1))
        if percent is None:
            found = _forest(equal, least)
        else:
            comp, block = group["comp"].to_numpy(), group["block"].to_numpy()
            need = np.triu((equal >= least) & (comp[:, None] != comp[None, :]), 1)
            if group["lo"][0] != group["hi"][0]:
                need &= block[:, None] != block[None, :]
            if not need.any():
                return []
            need &= ~_shared_before(group["elem"][0].as_py(), [p.values.to_numpy() for p in group["prefix"]])
            found = _links(need, [x.values.to_numpy() for x in group["shingles"]], comp, percent)
        sides = ((i, j) if doc[i] < doc[j] else (j, i) for i, j in found if doc[i] != doc[j])
        return [(doc[i], text[i], doc[j], text[j]) for i, j in sides]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        found: list[Pair] = []

        def batch_of(pairs):
            columns = list(zip(*dict.fromkeys(pairs), strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.binary()) * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "a_text", "b", "b_text"])

        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows == 0:
                continue
            key = np.stack([batch[c].to_numpy() for c in ("elem", "lo", "hi")])
            bounds = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
            size = np.diff(bounds)
            two = bounds[:-1][size == 2] if percent is None else bounds[:0]
            if len(two):  # most lists by far
                doc = batch["doc_id"].to_numpy()
                sign = [np.frombuffer(b"".join(batch["sign"].take(pa.array(two + k)).to_pylist()), np.uint8).reshape(len(two), -1) for k in (0, 1)]
                good = two[((sign[0] == sign[1]).sum(axis=1) >= least) & (doc[two] < doc[two + 1])]
                text = [batch["digest"].take(pa.array(good + k)).to_pylist() for k in (0, 1)]
                found += zip(doc[good], text[0], doc[good + 1], text[1], strict=True)
            for at, n in zip(bounds[:-1], size, strict=True):
                if n > 2 or n == 2 and percent is not None:
                    found += solve(batch.slice(at, n))
            held = batch.slice(bounds[-1])
            if len(found) > 20_000:
                yield batch_of(found)
                found = []
        if held is not None and held.num_rows > 1:
            found += solve(held)
        yield batch_of(found)

    return groups


def _blocks_of(m: str) -> Column:
    """The number of blocks of a posting list of m documents."""
    return F.ceil(F.col(m) / BLOCK).cast("int")


def _dealt(rows: DataFrame, own: list[str]) -> DataFrame:
    """Rows of posting lists (elem, m) with the block that the text belongs to, one row for each."""
    return rows.withColumn("block", F.pmod(F.xxhash64(*own), _blocks_of("m")).cast("int"))


def _across(rows: DataFrame) -> DataFrame:
    """A row for each pair of blocks (lo, hi) of the list that the row's block is one of."""
    return (rows.withColumn("other", F.explode(F.sequence(F.lit(0), _blocks_of("m") - 1)))
            .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "m"))


def near_duplicates(docs: DataFrame, percent: int = 85, posted_share: float | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: similarity of ``percent`` / 100 or more links."""
    similarity = percent / 100 if posted_share is None else posted_share
    posted_least, least = least_matches(POSTED, similarity), least_matches(COORDINATES, similarity)
    texts = keyed_texts(docs)
    signed = cut_lineage(texts.mapInArrow(lean(_sign), "doc_id bigint, n_shingles bigint, digest binary, posts array<bigint>, sign binary"))
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    member = cut_lineage(known.select("doc_id", "digest").join(classes, "digest").select("doc_id", "rep", "digest"))
    own = ["doc_id", "digest"]  # one text
    reps = known.join(member.where("doc_id = rep").select(*own).distinct(), own).dropDuplicates(own)

    posted = reps.select(*own, F.explode("posts").alias("elem"))
    shared = posted.groupBy("elem").agg(F.count("*").alias("n")).where("n > 1")
    prefix = (posted.join(shared, "elem").groupBy(*own).agg(F.array_sort(F.collect_set(F.struct("n", "elem"))).alias("e"))  # at most POSTED a text
              .where(F.size("e") >= posted_least).select(*own, F.explode(F.slice("e", F.lit(1), F.size("e") - F.lit(posted_least - 1))).alias("e"))
              .select(*own, F.col("e.elem").alias("elem")))
    prefix = cut_lineage(prefix)
    size = prefix.groupBy("elem").agg(F.count("*").alias("m")).where("m > 1")
    lists = _dealt(prefix.join(size, "elem"), own)
    lists = cut_lineage(lists.join(reps.select(*own, "sign"), own))
    sets = cut_lineage(semi_join_ids(texts, lists.select("doc_id").distinct(), "doc_id").mapInArrow(lean(_sets), "doc_id bigint, digest binary, shingles array<bigint>"))

    def matched(rows: DataFrame, percent: int | None = None) -> DataFrame:
        ordered = rows.repartition("elem", "lo", "hi").sortWithinPartitions("elem", "lo", "hi", *own)
        return ordered.mapInArrow(lean(_matcher(least, percent)), "a bigint, a_text binary, b bigint, b_text binary").distinct()

    def side(name: str, shingles: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(name), F.col("digest").alias(f"{name}_text"), F.col("shingles").alias(shingles))

    def linked(rows: DataFrame) -> DataFrame:
        """Confirmed links of the forests inside the blocks of ``rows``."""
        both = F.size(F.array_intersect("left", "right"))
        pairs = matched(rows.select("elem", F.col("block").alias("lo"), F.col("block").alias("hi"), *own, "sign"))
        return (pairs.join(side("a", "left"), ["a", "a_text"]).join(side("b", "right"), ["b", "b_text"])
                .where(100 * both >= percent * (F.size("left") + F.size("right") - both)).select(F.col("a").alias("u"), F.col("b").alias("v")))

    def tied(rows: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id")).drop("root")

    def grown(links: DataFrame) -> DataFrame:
        return cut_lineage(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links)))

    copies = member.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    roots = cut_lineage(components(linked(lists).unionByName(copies)))

    several = lists.where(F.col("m") > BLOCK)  # lists of more than one block
    while True:
        first = tied(several).groupBy("elem", "comp").agg(F.min_by(F.struct(*own, "sign"), F.struct(*own)).alias("one")).select("elem", "one.*")
        first = cut_lineage(first)
        open_ = first.groupBy("elem").agg(F.count("*").alias("m")).where("m > 1")
        bridges = cut_lineage(linked(_dealt(first.join(open_, "elem"), own)))
        if bridges.isEmpty():
            break
        roots = grown(bridges)

    more = tied(lists.where("m > 2"))
    open_lists = more.groupBy("elem").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("elem")
    left = _across(more.join(open_lists, "elem", "left_semi"))
    whole = sets.join(prefix.groupBy(*own).agg(F.collect_set("elem").alias("prefix")), own)  # at most POSTED elements a text
    late = cut_lineage(matched(left.join(whole, own), percent).select(F.col("a").alias("u"), F.col("b").alias("v")))
    if not late.isEmpty():
        roots = grown(late)
    component = F.coalesce("root", "doc_id")
    return (signed.select("doc_id", "n_shingles").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those that are near copies of a smaller doc_id.

    Rows that repeat a doc_id are one document, and one of them (the least by its columns) stays.
    """
    rated = cut_lineage(near_duplicates(docs, percent))
    copies = rated.where("NOT kept").select("doc_id").distinct()
    again = cut_lineage(rated.where("doc_id IS NOT NULL AND kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values()).withColumn("doc_id", F.col(names["doc_id"]).cast("bigint"))
    kept = join_sized(plain, copies, "doc_id", "left_anti")
    if not again.isEmpty():
        first = join_sized(kept, again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*names.values())).alias("row")).select("row.*", "doc_id")
        kept = join_sized(kept, again, "doc_id", "left_anti").unionByName(first)
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
