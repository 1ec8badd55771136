"""Benchmark decontamination: pigeonhole pieces find places, Myers' bit-parallel distance verifies them.

Texts are compared as words: runs of letters and digits, lower-cased (A-Z and Latin-1). A test item of n
words may differ by ``errors`` * n word edits, rounded down to e; it is cut into e + 1 pieces, of which one at
least is untouched in any such copy. Word n-grams of whole documents are looked up among the pieces, and the
surrounding words of each hit are searched for the item with Myers' algorithm over word bit masks.

Test items are read in blocks of about ``block_chars`` characters, one broadcast and one pass over the documents each,
so any number of items is handled. Defined cases: a missing text has no words; an item too short for an edit (under ten words
by default) is found where it stands word for word; items under ``min_words`` words match nothing, by default those without
words only; of places with equal distance the first counts; repeated items or rows are reported or dropped one by one; a missing
doc_id or item_id stays missing; a text costs a task memory in proportion to its own length; extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytewords as B
from .tables import keyed_texts, lean, ship

NOT_WORD = np.zeros(256, bool)
NOT_WORD[:128] = True
NOT_WORD[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = False


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 letters, which take two bytes."""
    out = B.FOLD[data]
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = wide[(data[wide] >= 0x80) & (data[wide] <= 0x9E) & (data[wide] != 0x97)]
    out[upper] += 0x20
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and their rows."""
    folded = fold(data)
    starts, ends, row = B.pieces(folded, offsets, NOT_WORD)
    return B.span_hashes(folded, starts, ends), row


@dataclass
class Items:
    """Test items ready for the search: words, budgets, and piece hashes by piece length."""

    ids: list[int]
    words: list[np.ndarray]
    budget: list[int]
    masks: list[dict[int, int]]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    maybe: dict[int, np.ndarray] = field(default_factory=dict)


def prepare(rows: list[tuple[int, str | None]], errors: float, min_words: int) -> Items:
    out = Items([], [], [], [])
    cut: dict[int, list[tuple[int, int, int]]] = {}
    texts = pa.array([t or "" for _, t in rows], pa.string())
    hashes, row = words_of(*B.text_bytes(texts))
    for k, (item, _) in enumerate(rows):
        words = hashes[np.searchsorted(row, k):np.searchsorted(row, k, side="right")]
        n = len(words)
        if n < min_words:
            continue
        e = int(errors * n)
        place = len(out.ids)
        masks: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            masks[w] = masks.get(w, 0) | 1 << i
        out.ids.append(item)
        out.words.append(words)
        out.budget.append(e)
        out.masks.append(masks)
        edges = [n * j // (e + 1) for j in range(e + 2)]
        for a, b in zip(edges, edges[1:], strict=False):
            _, gram = B.grams(words[a:b], np.zeros(b - a, np.int64), b - a)
            cut.setdefault(b - a, []).append((int(gram[0]), place, a))
    for n, found in cut.items():
        found.sort()
        value = np.array([f[0] for f in found], np.uint64)
        out.pieces[n] = (value, np.array([f[1] for f in found]), np.array([f[2] for f in found]))
        out.maybe[n] = np.zeros(1 << 16, bool)
        out.maybe[n][(value >> np.uint64(48)).astype(np.int64)] = True
    return out


def nearest(masks: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Myers' search: the least word distance of the pattern to any part of the text, and the first end with it."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, word in enumerate(text):
        equal = masks.get(word, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(horizontal | plus) & full, plus & horizontal
        score += (up & high > 0) - (down & high > 0)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def _search(items: Items, hashes: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, place of the item, distance, first word, end word), the best of each row and item."""
    hits = []
    for n, (value, item, offset) in items.pieces.items():
        at, gram = B.grams(hashes, row, n)
        likely = np.flatnonzero(items.maybe[n][(gram >> np.uint64(48)).astype(np.int64)])
        low, high = np.searchsorted(value, gram[likely]), np.searchsorted(value, gram[likely], side="right")
        for k in np.flatnonzero(high > low):
            for x in range(low[k], high[k]):
                hits.append((int(row[at[likely[k]]]), int(item[x]), int(at[likely[k]] - offset[x])))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    seen: dict[tuple[int, int], int] = {}
    for r, k, start in sorted(set(hits)):
        known = best.get((r, k))
        m, e = len(items.words[k]), items.budget[k]
        if known and known[0] == 0 or start + m + e <= seen.get((r, k), -1):
            continue
        first, last = np.searchsorted(row, r), np.searchsorted(row, r, side="right")
        # Wide enough for all hits of one place; a later hit beyond it is searched by itself.
        a, b = max(int(first), start - e), min(int(last), start + m + 2 * e)
        seen[r, k] = start + m + 2 * e
        text = hashes[a:b].tolist()
        distance, end = nearest(items.masks[k], m, text)
        if distance > e or known and known[0] <= distance:
            continue
        back: dict[int, int] = {w: int(f"{bits:0{m}b}"[::-1], 2) for w, bits in items.masks[k].items()}
        _, length = nearest(back, m, text[:end][::-1])
        best[r, k] = (distance, a + end - length, a + end)
    for (r, k), (distance, a, b) in best.items():
        first = int(np.searchsorted(row, r))
        yield r, k, distance, a - first, b - first


def item_blocks(items: DataFrame, errors: float, min_words: int, block_chars: int) -> Iterator[Items]:
    """The items in blocks of bounded size."""
    clean = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = clean.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    for k in range(blocks):
        rows = clean.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield prepare([(r["item_id"], r["text"]) for r in rows], errors, min_words)


def find_items(docs: DataFrame, items: DataFrame, errors: float = 0.1, min_words: int = 1, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, item_id, n_edits, start_word, end_word: the nearest place of every item within its budget."""
    texts, out = keyed_texts(docs), None
    for block in item_blocks(items, errors, min_words, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                found = []
                ids = batch.column(0).to_pylist()
                for first, _, part, cuts in B.runs(*B.text_bytes(batch.column(1))):
                    found += [(ids[first + r], block.ids[k], d, a, b) for r, k, d, a, b in _search(block, *words_of(part, cuts))]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_edits", "start_word", "end_word"])

        part = texts.mapInArrow(lean(run), "doc_id bigint, item_id bigint, n_edits bigint, start_word bigint, end_word bigint")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, errors: float = 0.1, min_words: int = 1, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item within its budget; nothing is shuffled."""
    ship(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema
    for block in item_blocks(items, errors, min_words, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, _, part, cuts in B.runs(*B.text_bytes(batch.column(at).cast(pa.string()))):
                    for r, *_ in _search(shared.value, *words_of(part, cuts)):
                        clean[first + r] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(lean(run), schema)
    return docs
