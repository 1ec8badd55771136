r"""Substring dedup: repeated word k-mers as edges of a de Bruijn graph, compacted to paths that source coordinates verify.

1. Edges. A window of K consecutive words ``[^\x20\x09-\x0D]+`` is an edge between its first and last K - 1 words.
   An edge met in two documents is repeated; its source is the smallest doc_id it starts in, and it goes by the
   coordinate it has there (document, word). Each later occurrence gets that coordinate.
2. Walks. Occurrences that follow one another in a document and in its source are one walk along the source.
3. Paths. A node branches where a walk enters or leaves a source. What lies between two such borders is a
   nonbranching path (``repeated_paths``); a walk runs over whole paths, so its ends join with their borders.
4. Verification. A second hash of the words, independent of the one that found the edges, is summed up to every border of a path in the
   source and along every walk in the later document. Joins of walks and borders keep the walks that stand word for
   word at both coordinates; the words they cover go. The pass that sums also cuts the texts; texts with a walk that fails are cut again.

All edges of all documents go through one shuffle. A task sorts about ``FLUSH`` of them, settles what it sees
itself (a later document of the same task loses the window whatever others hold), and sends the rest packed by
ranges of the hash: one packed row per range instead of a row per word. Settled ones go to salted ranges, so
an edge that a third of all documents share meets others only once per task. The number of ranges follows
the size of the texts, so the work of one range has the same size for any input. Beyond ``AT_ONCE`` ranges they are
dealt in two steps, first to groups of ranges and then inside a group, so that packed rows stay long.

Hashes have 64 bits over whole words. Defined cases: a missing text has no words; a document under K words
loses nothing; a row without doc_id is no source and loses nothing; rows that repeat a doc_id are one document to
others, and each loses what its own text repeats of smaller doc_ids. Texts of a repeated doc_id are told apart by a
variant, 31 bits of their hash, kept above the 32 bits of a word's place; it is 0 where a doc_id has one row. Equal rows
have equal results. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from . import bytewords as B
from .tables import join_sized, keyed_texts, lean

FLUSH = 500_000
RANGE_CHARS = 8_000_000
AT_ONCE = 2048
WORD_BITS = (1 << 32) - 1
SUM_BITS = (1 << 62) - 1
SCHEMA = "part int, edges binary, docs binary, places binary, sources binary, source_places binary"
FOUND = "part int, docs binary, places binary, sources binary, source_places binary"
WALKS = "doc_id bigint, variant bigint, starts array<int>, ends array<int>, sources array<bigint>, source_variants array<bigint>, source_starts array<int>"
SUMS = ("doc_id bigint, variant bigint, start int, end int, source bigint, source_variant bigint, source_start int, total bigint, "
        "n_words bigint, n_removed bigint, kept_text string")
WALK = ["start", "end", "source", "source_variant", "source_start"]
BROADCAST_BYTES = 128 << 20
PACKED = [c.split()[0] for c in SCHEMA.split(", ")]


def _windows(texts: pa.Array, variant: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows: edge hashes, row, position of the first word in its text with the variant above."""
    data, offsets = B.text_bytes(texts)
    for first, end, part, cuts in B.runs(data, offsets):
        starts, ends, row = B.pieces(part, cuts, B.SPACE)
        at, edge = B.grams(B.span_hashes(part, starts, ends), row, k)
        begin = np.searchsorted(row, np.arange(end - first))
        yield edge, row[at] + first, at - begin[row[at]] + (variant[row[at] + first] << 32)


def _pack(values: np.ndarray) -> bytes:
    """Byte planes: sorted hashes and close ids then compress well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unpack(parts: list[bytes], kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(size, -1).T).view(kind).ravel() for p in parts])


def _first(edge: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """The occurrences by edge and document, each with the coordinate of the first one of its edge."""
    order = np.lexsort((doc, edge))  # stable, and places of a document come in order
    edge, doc, place = edge[order], doc[order], place[order]
    starts = np.flatnonzero(np.append(True, edge[1:] != edge[:-1]))
    size = np.diff(np.append(starts, len(edge)))
    return edge, doc, place, np.repeat(doc[starts], size), np.repeat(place[starts], size)


def _parts(hashed: np.ndarray, ranges: int) -> np.ndarray:
    return (((hashed >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _slices(part: np.ndarray) -> list[tuple[int, slice]]:
    """The parts of an ascending column and where each stands."""
    starts = np.flatnonzero(np.append(part[:1] == part[:1], part[1:] != part[:-1]))
    return [(int(part[a]), slice(a, b)) for a, b in zip(starts, [*starts[1:], len(part)], strict=bool(len(part)))]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)


def _deal(edge: np.ndarray, doc: np.ndarray, place: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Packed rows of one flush: ranges 0.. hold open edges, the salted ones behind hold settled places."""
    edge, doc, place, source, source_place = _first(edge, doc, place)
    open_, settled = doc == source, doc > source
    kept = edge[open_], doc[open_], place[open_]
    rows = [(r, *(_pack(c[cut]) for c in kept), b"", b"") for r, cut in _slices(_parts(kept[0], ranges))]
    if settled.any():
        rows.append((ranges + int(edge[0] % np.uint64(ranges)), b"", *(_pack(c[settled]) for c in (doc, place, source, source_place))))
    return _batch(rows, PACKED)


def _flushes(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """Columns of about ``FLUSH`` rows."""
    held, size = [], 0
    for columns in found:
        held.append(columns)
        size += len(columns[0])
        if size >= FLUSH:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            held, size, columns = [], 0, ()
            yield whole
            whole = None
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _edges(k: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for edge, row, place in _windows(batch.column(1), batch.column(2).to_numpy(), k):
                    yield edge, ids[row], place

        for columns in _flushes(found()):
            yield _deal(*columns, ranges)

    return run


def _deal_again(ranges: int):
    """Rows of groups of ranges, dealt to the ranges themselves; settled rows stay whole and are salted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled: list[tuple] = []

        def found():
            for batch in batches:
                for edges, docs, places, *sources in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                    if edges:
                        yield _unpack([edges], np.uint64), _unpack([docs], np.int64), _unpack([places], np.int64)
                    else:
                        settled.append((ranges + zlib.crc32(docs + places) % ranges, b"", docs, places, *sources))

        for columns in _flushes(found()):
            yield _deal(*columns, ranges)
            yield _batch(settled, PACKED)
            settled.clear()
        yield _batch(settled, PACKED)

    return run


def _by_document(doc: np.ndarray, columns: tuple[np.ndarray, ...], ranges: int) -> list[tuple]:
    """Packed rows by parts of the documents."""
    part = _parts(B.mix(doc.view(np.uint64)), ranges)
    order = np.lexsort((columns[0], doc, part))
    return [(r, *(_pack(c[order[cut]]) for c in (doc, *columns))) for r, cut in _slices(part[order])]


def _settle(ranges: int):
    """Of one range: occurrences of edges that start in a smaller doc_id, packed by parts of the documents."""

    def run(table: pa.Table) -> pa.Table:
        edges, *columns = (table[c].to_pylist() for c in PACKED[1:])
        if any(edges):
            doc, place = _unpack(columns[0], np.int64), _unpack(columns[1], np.int64)
            _, doc, place, source, source_place = _first(_unpack(edges, np.uint64), doc, place)
            later = doc > source
            doc, place, source, source_place = doc[later], place[later], source[later], source_place[later]
        else:
            doc, place, source, source_place = (_unpack(c, np.int64) for c in columns)
        return pa.Table.from_batches([_batch(_by_document(doc, (place, source, source_place), ranges), ["part", *PACKED[2:]])])

    return run


def _documents_again(ranges: int):
    """Rows of groups of document parts, dealt to the parts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (tuple(_unpack([v], np.int64) for v in row) for batch in batches
                 for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True))
        for doc, *columns in _flushes(found):
            yield _batch(_by_document(doc, tuple(columns), ranges), ["part", *PACKED[2:]])

    return run


def _walks(k: int):
    """Of one part of the documents: occurrences that advance together with their sources, one row each."""

    def run(table: pa.Table) -> pa.Table:
        doc, place, source, source_place = (_unpack(table[c].to_pylist(), np.int64) for c in PACKED[2:])
        order = np.lexsort((source_place, source, place, doc))  # variants of a document one after another
        doc, place, source, source_place = doc[order], place[order], source[order], source_place[order]
        once = np.append(True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]))  # equal rows meet here
        doc, place, source, source_place = doc[once], place[once], source[once], source_place[once]
        turn = np.append(True, (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] != 1) | (source[1:] != source[:-1]) | (source_place[1:] - source_place[:-1] != 1))
        first = np.flatnonzero(turn)
        last = np.append(first[1:], len(doc)) - 1
        own, variant = doc[first], place[first] >> 32
        new = np.append(own[:1] == own[:1], (own[1:] != own[:-1]) | (variant[1:] != variant[:-1]))
        bounds = pa.array(np.append(np.flatnonzero(new), len(own)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(v, kind)) for v, kind in (
            (place[first] & WORD_BITS, pa.int32()), ((place[last] & WORD_BITS) + k, pa.int32()), (source[first], pa.int64()),
            (source_place[first] >> 32, pa.int64()), (source_place[first] & WORD_BITS, pa.int32()))]
        return pa.table([pa.array(own[new]), pa.array(variant[new]), *lists], names=[c.split()[0] for c in WALKS.split(", ")])

    return run


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    """Powers modulo 2^64, by repeated squaring."""
    out, left = np.ones(len(exponent), np.uint64), exponent.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] *= np.uint64(base)
        base, left = base * base % 2**64, left >> np.uint64(1)
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: sums of the second hash along its walks, lifted to the place in the source, and up to the borders in it;
    behind them a row with its words, the words that the walks cover and what is left.

    The word at place i counts BASE^i times its hash, so the sum of a walk moved by d words is BASE^d times as large.
    """
    names = [c.split()[0] for c in SUMS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def rows(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names=names)

    for batch in batches:
        data, offsets = B.text_bytes(batch.column(1))
        *walk_columns, border_column = (batch.column(i) for i in range(3, 9))
        at = 0
        for first, end, part, cuts in B.runs(data, offsets):
            starts, ends, row = B.pieces(part, cuts, B.SPACE)
            bounds = np.searchsorted(row, np.arange(end - first + 1))
            hashes, raw = B.span_hashes(part, starts, ends, B.CHECK_CODES), part.tobytes()
            walked, bordered, count, gone, texts = [], [], [], [], []
            for i in range(end - first):
                s, e, h = (c[bounds[i]:bounds[i + 1]] for c in (starts, ends, hashes))
                stay, walks, borders = np.ones(len(s), bool), walk_columns[0][at].is_valid, border_column[at].is_valid
                if walks or borders:
                    sums = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(h * B.powers(B.BASE, len(h)), out=sums[1:])
                if walks:
                    begin, stop, source, variant, place = (c[at].values.to_numpy() for c in walk_columns)
                    along = (sums[stop] - sums[begin]) * _power(B.INVERSE, begin) * _power(B.BASE, place)
                    walked.append((np.full(len(begin), at), begin, stop, source, variant, place, along))
                    cover = np.zeros(len(s) + 1, np.int64)
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, stop, -1)
                    stay = np.cumsum(cover)[:-1] == 0
                if borders:
                    border = border_column[at].values.to_numpy()
                    bordered.append((np.full(len(border), at), border, sums[border]))
                count.append(len(s))
                gone.append(int((~stay).sum()))
                texts.append(b" ".join([raw[a:b] for a, b in zip(s[stay].tolist(), e[stay].tolist(), strict=True)]))
                at += 1
            for found, columns in ((walked, WALK), (bordered, ["start"])):
                if found:
                    of, *values, total = (np.concatenate(c) for c in zip(*found, strict=True))
                    known = {"doc_id": batch.column(0).take(pa.array(of)), "variant": batch.column(2).take(pa.array(of)),
                             "total": pa.array((total & np.uint64(SUM_BITS)).view(np.int64))}
                    yield rows(known | {c: pa.array(v) for c, v in zip(columns, values, strict=True)}, len(of))
            yield rows({"doc_id": batch.column(0).slice(at - len(count), len(count)), "variant": batch.column(2).slice(at - len(count), len(count)),
                        "n_words": pa.array(count), "n_removed": pa.array(gone), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())}, len(count))


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and variant: 0, or 31 bits of the text's hash where several rows have the doc_id."""
    texts = keyed_texts(docs)
    again = cut_lineage(texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("again")))
    if again.isEmpty():
        return texts.withColumn("variant", F.lit(0).cast("bigint"))
    marked = join_sized(texts, again, "doc_id", "left")
    return marked.select("doc_id", "text", F.when(F.col("again"), F.pmod(F.xxhash64("text"), F.lit(2**31))).otherwise(0).cast("bigint").alias("variant"))


def _walk_table(texts: DataFrame, k: int) -> DataFrame:
    texts = texts.where("doc_id IS NOT NULL")
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, math.ceil(chars / RANGE_CHARS))
    groups = ranges if ranges <= AT_ONCE else math.ceil(math.sqrt(ranges))
    edges = texts.mapInArrow(lean(_edges(k, groups)), SCHEMA)
    if groups < ranges:  # written first: a flush settles what it meets, so its rows must come in the same order in every attempt
        edges = cut_lineage(edges.repartition("part")).mapInArrow(lean(_deal_again(ranges)), SCHEMA)
    found = edges.groupBy("part").applyInArrow(_settle(groups), FOUND)
    if groups < ranges:
        found = found.repartition("part").mapInArrow(lean(_documents_again(ranges)), FOUND)
    return cut_lineage(found.groupBy("part").applyInArrow(_walks(k), WALKS))


def _walk_rows(walks: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(*(F.col(f"{c}s").alias(c) for c in WALK))
    return walks.select("doc_id", "variant", F.explode(zipped).alias("w")).select("doc_id", "variant", *(F.col(f"w.{c}") for c in WALK))


def _path_table(walks: DataFrame, k: int) -> DataFrame:
    last = F.col("source_start") + F.col("end") - F.col("start") - (k - 1)
    ends = F.explode(F.array(F.struct(F.col("source_start").alias("place"), F.lit(1).alias("turn")), F.struct(last.alias("place"), F.lit(-1).alias("turn"))))
    borders = _walk_rows(walks).select("source", "source_variant", ends.alias("e")).groupBy("source", "source_variant", F.col("e.place").alias("start")).agg(F.sum("e.turn").alias("turn"))
    order = Window.partitionBy("source", "source_variant").orderBy("start")
    paths = borders.withColumn("n_walks", F.sum("turn").over(order)).withColumn("end", F.lead("start").over(order) + (k - 1))
    return paths.where("n_walks > 0").select("source", "source_variant", "start", "end", "n_walks")


def _summed(texts: DataFrame, walks: DataFrame, borders: DataFrame | None = None) -> DataFrame:
    """``_sums`` of the texts with their walks and borders, which are broadcast up to ``BROADCAST_BYTES`` of counted arrays."""
    key, lists = ["doc_id", "variant"], [f"{c}s" for c in WALK]
    asked = walks.select(*key, F.struct(*lists).alias("walk"))
    asked = asked.withColumn("border", F.lit(None).cast("int")) if borders is None else asked.unionByName(borders, allowMissingColumns=True)
    asked = asked.groupBy(*key).agg(F.first("walk", ignorenulls=True).alias("walk"), F.collect_set("border").alias("borders"))
    asked = cut_lineage(asked.select(*key, *(f"walk.{c}" for c in lists), F.when(F.size("borders") > 0, F.col("borders")).alias("borders")))
    size = 64 + 28 * F.coalesce(F.size("starts"), F.lit(0)).cast("bigint") + 4 * F.coalesce(F.size("borders"), F.lit(0))
    small = (asked.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    joined = texts.join(F.broadcast(asked) if small else asked, key, "left").select("doc_id", "text", "variant", *lists, "borders")
    return joined.mapInArrow(lean(_sums), SUMS)


def _verified(texts: DataFrame, walks: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The walks that stand word for word at both coordinates, whose sums equal the difference of two borders; and the cut texts."""
    border = F.explode(F.array(F.col("start"), F.col("end") - (k - 1), F.col("start") + (k - 1), F.col("end")))
    borders = _path_table(walks, k).select(F.col("source").alias("doc_id"), F.col("source_variant").alias("variant"), border.alias("border"))
    sums = cut_lineage(_summed(texts, walks, borders))
    cut = sums.where("n_words IS NOT NULL").select("doc_id", "variant", "n_words", "n_removed", "kept_text")
    walked = sums.where("source IS NOT NULL").select("doc_id", "variant", *WALK, "total", (F.col("source_start") + F.col("end") - F.col("start")).alias("source_end"))
    known = sums.where("source IS NULL AND start IS NOT NULL").select(F.col("doc_id").alias("source"), F.col("variant").alias("source_variant"), F.col("start").alias("place"), F.col("total").alias("sum")).distinct()
    claim = ["source", "source_variant", "source_start", "source_end", "total"]
    claims = walked.select(*claim).distinct()
    for side in ("start", "end"):
        of_side = known.select("source", "source_variant", F.col("place").alias(f"source_{side}"), F.col("sum").alias(f"sum_{side}"))
        claims = claims.join(of_side, ["source", "source_variant", f"source_{side}"], "left")
    same = (F.col("sum_start") + F.col("total")).bitwiseAND(F.lit(SUM_BITS)) == F.col("sum_end")
    failed = cut_lineage(claims.where(~F.coalesce(same, F.lit(False))).select(*claim))
    if failed.isEmpty():
        return walked, cut
    key = ["doc_id", "variant"]
    right, again = walked.join(failed, claim, "left_anti"), cut_lineage(walked.join(failed, claim, "left_semi").select(*key).distinct())
    lists = F.array_sort(F.collect_set(F.struct(*WALK)))
    kept = right.join(again, key, "left_semi").groupBy(*key).agg(lists.alias("w")).select(*key, *(F.col(f"w.{c}").alias(f"{c}s") for c in WALK))
    anew = _summed(texts.join(again, key, "left_semi"), kept).where("n_words IS NOT NULL").select(*cut.columns)
    return right, cut.join(again, key, "left_anti").unionByName(anew)


def repeated_paths(docs: DataFrame, k: int = 13) -> DataFrame:
    """source, source_variant, start, end, n_walks: the nonbranching paths of repeated edges.

    A path is a span of words of the document ``source``, which is where its edges go by; ``n_walks`` walks of later
    documents run over all of it, and none enters or leaves inside. An edge that a task settles itself goes by the
    smallest document of that task, so one edge can lie on a path of each of several sources.
    """
    return _path_table(_walk_table(texts_of(docs), k), k)


def repeated_spans(docs: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, variant, starts, ends, paths: of each text (``texts_of``) the word spans that repeat windows of a smaller doc_id.

    ``paths`` are the verified walks as structs (start, end, source, source_start), each a span that stands word for
    word in the document ``source`` from the word ``source_start`` on; starts and ends are theirs.
    """
    texts = texts_of(docs)
    verified, _ = _verified(texts, _walk_table(texts, k), k)
    spans = verified.groupBy("doc_id", "variant").agg(F.sort_array(F.collect_set(F.struct("start", "end", "source", "source_start"))).alias("paths"))
    return spans.select("doc_id", "variant", F.col("paths.start").alias("starts"), F.col("paths.end").alias("ends"), "paths")


def remove_repeats(docs: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, for every row."""
    texts = texts_of(docs)
    _, cut = _verified(texts, _walk_table(texts, k), k)
    return cut.select("doc_id", "n_words", "n_removed", "kept_text")
