r"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a run of 16 or more characters ``[A-Za-z0-9+/_=.~-]`` with letters and digits. Candidates and
base spans carry a window: the bytes before, the candidate itself, the bytes behind. The network (byte embedding,
one convolution, rectified maxima inside and outside the candidate, one dense layer) is written in numpy. It is
trained on labelled findings: what base spans hold (behind the keyword) is secret, ordinary words and numbers of the same
documents are not; half of the secrets lose their leading context, so that the network also learns what a secret itself
looks like. A third of the findings is held out: a Platt curve calibrates the scores, and the threshold is the highest
one at which the held-out recall stays at ``recall``. Candidates from that probability on are added. A span longer than
the window is seen in overlapping windows that cover all its bytes, and its score is the highest of them.

All distinct findings train the network or are held out, in tasks; every candidate of every text is
scored. Defined cases: a missing text is empty; every row is scanned by itself, so repeated rows and missing ids change
nothing; with too few findings there is no model and nothing is added; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from . import bytewords as B
from .quality import platt
from .tables import keyed_texts, lean

KINDS = ["assign", "access", "hex", "model"]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")

NOT_HEX = np.ones(256, bool)
NOT_HEX[list(b"0123456789abcdef")] = False
DIGIT = np.zeros(256, bool)
DIGIT[list(b"0123456789")] = True
LETTER = np.zeros(256, bool)
LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
NOT_TOKEN = ~(DIGIT | LETTER)
NOT_TOKEN[list(b"+/_=.~-")] = False

LEFT, MIDDLE, RIGHT = 32, 56, 16
WIDTH = LEFT + MIDDLE + RIGHT
SCHEMA = ("doc_id bigint, rank array<int>, start array<bigint>, stop array<bigint>, c_start array<bigint>, c_stop array<bigint>, "
          "c_window array<array<binary>>, f_window array<binary>, f_label array<int>")


def windows(text: bytes, start: int, end: int) -> list[bytes]:
    """The bytes around and in a span, padded with zeros: one window, or several half a width apart that cover a long span."""
    out = []
    for at in range(start, max(start, end - MIDDLE) + MIDDLE // 2, MIDDLE // 2):
        a = max(start, min(at, end - MIDDLE))
        b = min(end, a + MIDDLE)
        out.append(text[max(0, a - LEFT):a].rjust(LEFT, b"\0") + text[a:b].ljust(MIDDLE, b"\0") + text[b:b + RIGHT].ljust(RIGHT, b"\0"))
    return out


def _base_spans(raw: bytes, points: np.ndarray, hex_runs: list[tuple[int, int]], assigned: bool, access: bool) -> list[tuple[int, int, int, int]]:
    """(rank, first byte, end byte, first byte of the secret itself) of the base patterns in one text."""
    out = [(2, a, b, a) for a, b in hex_runs]
    if assigned or access:
        text = raw.decode()
        wide = len(text) != len(raw)
        at = np.searchsorted(points, np.arange(len(text) + 1), side="right") - 1 if wide else None
        for rank, use, pattern in ((0, assigned, ASSIGN), (1, access, ACCESS)):
            for m in pattern.finditer(text) if use else ():
                if len(m[1]) >= 6 if rank == 0 else len(m[0]) >= 20:
                    places = (*m.span(), m.start(1 - rank))
                    out.append((rank, *(places if at is None else (int(at[x]) for x in places))))
    return out


def _apart(spans: list[tuple[int, int]], base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap no base span; both come in order, spans apart from each other."""
    if not spans or not base:
        return spans
    starts = np.array([b[1] for b in base])
    reach = np.maximum.accumulate([b[2] for b in base])
    own = np.array(spans)
    before = np.searchsorted(starts, own[:, 1])  # base spans that start before the span ends
    return [s for s, n in zip(spans, before.tolist(), strict=True) if n == 0 or reach[n - 1] <= s[0]]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(8)]
        for first, end, part, cuts in B.runs(*B.text_bytes(batch.column(1))):
            raw, points = part.tobytes(), B.code_points(part)
            digits, letters = (np.concatenate([[0], np.cumsum(t[part])]) for t in (DIGIT, LETTER))
            sign = np.concatenate([[0], np.cumsum((part == 58) | (part == 61))])
            a, b, row = B.pieces(part, cuts, NOT_HEX)
            long = b - a >= 24
            hex_of: dict[int, list] = {}
            for x, y, r in zip(a[long].tolist(), b[long].tolist(), row[long].tolist(), strict=True):
                hex_of.setdefault(r, []).append((x - int(cuts[r]), y - int(cuts[r])))
            a, b, row = B.pieces(part, cuts, NOT_TOKEN)
            long = (b - a >= 16) & (digits[b] > digits[a]) & (letters[b] > letters[a])
            run_of: dict[int, list] = {}
            for x, y, r in zip(a[long].tolist(), b[long].tolist(), row[long].tolist(), strict=True):
                run_of.setdefault(r, []).append((x - int(cuts[r]), y - int(cuts[r])))
            has_access = b"AKIA" in raw
            for r in range(end - first):
                lo, hi = int(cuts[r]), int(cuts[r + 1])
                assigned = sign[hi] > sign[lo]
                if not (assigned or has_access or r in hex_of or r in run_of):
                    for c in columns:
                        c.append([])
                    continue
                text, here = raw[lo:hi], points[lo:hi + 1] - points[lo]
                base = sorted(_base_spans(text, here, hex_of.get(r, []), assigned, has_access and b"AKIA" in text), key=lambda s: (s[1], s[0]))
                free = _apart(run_of.get(r, []), base)
                found = [w for _, _, e, s in base for w in windows(text, s, e)]
                label = [1] * len(found)
                if base:  # as many ordinary words and numbers of the same text
                    words = [m.span() for m in re.finditer(rb"[A-Za-z0-9@.:+-]{4,}", text)]
                    plain = _apart(words, base)
                    for k in range(min(len(plain), 2 * len(base))):
                        seen = windows(text, *plain[(k * 7919) % len(plain)])
                        found += seen
                        label += [0] * len(seen)
                for c, v in zip(columns, ([s[0] for s in base], [int(here[s[1]]) for s in base], [int(here[s[2]]) for s in base],
                                          [int(here[c[0]]) for c in free], [int(here[c[1]]) for c in free], [windows(text, *c) for c in free], found, label), strict=True):
                    c.append(v)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds, strict=True))],
                                         names=["doc_id", "rank", "start", "stop", "c_start", "c_stop", "c_window", "f_window", "f_label"])


EMBED, FILTERS, SPAN = 8, 24, 5
PLACES = WIDTH - SPAN + 1
INSIDE = (np.arange(PLACES) + SPAN // 2 >= LEFT) & (np.arange(PLACES) + SPAN // 2 < LEFT + MIDDLE)


@dataclass
class CharNet:
    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def forward(self, codes: np.ndarray):
        """Scores of windows (n, WIDTH) and what the backward step needs."""
        dots = self.embed[codes]
        patches = np.stack([dots[:, k:k + PLACES] for k in range(SPAN)], axis=2).reshape(len(codes) * PLACES, SPAN * EMBED)
        maps = (patches @ self.kernel + self.shift).reshape(len(codes), PLACES, FILTERS)
        tops = [np.where(mask[None, :, None], maps, -np.inf).argmax(axis=1) for mask in (INSIDE, ~INSIDE)]
        best = np.concatenate([np.take_along_axis(maps, t[:, None, :], 1)[:, 0] for t in tops], axis=1)
        return np.maximum(best, 0) @ self.dense + self.bias[0], (patches, tops, best)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        parts = [self.forward(codes[i:i + 512])[0] for i in range(0, len(codes), 512)]
        score = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -60, 60)))


def codes_of(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH).astype(np.int64)


NAMES = ("embed", "kernel", "shift", "dense", "bias")


def fresh_net() -> CharNet:
    rng = np.random.RandomState(5)
    return CharNet(rng.normal(0, 0.3, (256, EMBED)), rng.normal(0, 0.2, (SPAN * EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), np.zeros(1))


def fresh_moments(net: CharNet) -> tuple[dict, dict]:
    return tuple({n: np.zeros_like(getattr(net, n)) for n in NAMES} for _ in range(2))


def one_pass(net: CharNet, moments: tuple[dict, dict], step: int, codes: np.ndarray, y: np.ndarray, order: np.ndarray) -> int:
    """Adam on log loss over the findings in the given order, 64 at a time; changes the net and its moments, gives the steps so far."""
    first, second = moments
    for batch in np.array_split(order, max(1, len(order) // 64)):
        score, (patches, tops, best) = net.forward(codes[batch])
        miss = (1 / (1 + np.exp(-np.clip(score, -60, 60))) - y[batch]) / len(batch)
        grad = {"bias": np.array([miss.sum()]), "dense": np.maximum(best, 0).T @ miss}
        back = (miss[:, None] * net.dense) * (best > 0)
        maps = np.zeros((len(batch), PLACES, FILTERS))
        for k, top in enumerate(tops):
            part = back[:, k * FILTERS:(k + 1) * FILTERS]
            np.put_along_axis(maps, top[:, None, :], np.take_along_axis(maps, top[:, None, :], 1) + part[:, None, :], 1)
        flat = maps.reshape(-1, FILTERS)
        grad["shift"], grad["kernel"] = flat.sum(axis=0), patches.T @ flat
        spread = (flat @ net.kernel.T).reshape(len(batch), PLACES, SPAN, EMBED)
        grad["embed"] = np.zeros_like(net.embed)
        for k in range(SPAN):
            np.add.at(grad["embed"], codes[batch][:, k:k + PLACES].ravel(), spread[:, :, k].reshape(-1, EMBED))
        step += 1
        for n in NAMES:
            first[n] = 0.9 * first[n] + 0.1 * grad[n]
            second[n] = 0.999 * second[n] + 0.001 * grad[n] ** 2
            setattr(net, n, getattr(net, n) - 0.01 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8))
    return step


def fit_net(codes: np.ndarray, y: np.ndarray, epochs: int = 12, recall: float = 0.98) -> CharNet:
    """A network from findings in memory: two thirds train it, the held-out third gives calibration and threshold."""
    rng = np.random.RandomState(5)
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::3]] = True
    codes = codes.copy()
    codes[np.flatnonzero(y == 1)[1::2], :LEFT] = 0  # learn the secret without its keyword too
    net, step = fresh_net(), 0
    moments = fresh_moments(net)
    for _ in range(epochs):
        step = one_pass(net, moments, step, codes, y, rng.permutation(np.flatnonzero(~held)))
    score = np.concatenate([net.forward(codes[held][i:i + 512])[0] for i in range(0, held.sum(), 512)])
    calibrate(net, score, y[held], np.ones(held.sum()), recall)
    return net


def calibrate(net: CharNet, score: np.ndarray, y: np.ndarray, count: np.ndarray, recall: float) -> None:
    """Platt curve through counted held-out scores, and the highest threshold at which their recall stays at ``recall``."""
    net.slope, net.offset = platt(score, y, count)
    good = y == 1
    order = np.argsort(score[good], kind="stable")
    upto = np.cumsum(count[good][order])
    lowest = score[good][order][np.searchsorted(upto, int((1 - recall) * upto[-1]), side="right")]
    net.threshold = float(1 / (1 + np.exp(-np.clip(net.slope * lowest + net.offset, -60, 60))))


PER_SHARE, SHARES = 2048, 64  # findings of one share of a pass, and the most shares: larger tables have larger ones
CELL, SCORE_LIMIT = 256, 100.0  # held-out scores are counted in steps of 1/256


def _packed(net: CharNet, moments: tuple[dict, dict]) -> np.ndarray:
    return np.concatenate([np.ravel(x[n]) for x in ({n: getattr(net, n) for n in NAMES}, *moments) for n in NAMES])


def _unpacked(flat: np.ndarray) -> tuple[CharNet, tuple[dict, dict]]:
    net, at = fresh_net(), 0
    moments = fresh_moments(net)
    shapes = {n: getattr(net, n).shape for n in NAMES}
    own: dict[str, np.ndarray] = {}
    for x in (own, *moments):
        for n in NAMES:
            size = int(np.prod(shapes[n]))
            x[n] = flat[at:at + size].reshape(shapes[n]).copy()
            at += size
    return CharNet(**own), moments


def train_net(scanned: DataFrame, epochs: int = 12, recall: float = 0.98) -> CharNet | None:
    """A network from all distinct findings: every pass trains on each share of them in a task and averages the shares' networks.

    A hash holds a third of the findings out, and all of them are scored for the curve and the threshold. To the driver come
    the averaged networks (at most ``SHARES`` a pass, some thousand numbers each) and counts of held-out scores by cell.
    """
    lot = F.pmod(F.xxhash64("window", F.lit(1)), F.lit(6))
    findings = cut_lineage(scanned.select(F.explode(F.arrays_zip("f_window", "f_label")).alias("f")).select(
        F.col("f.f_window").alias("window"), F.col("f.f_label").alias("label")).distinct().withColumns(
        {"held": lot % 3 == 0, "bare": (F.col("label") == 1) & (lot < 3)}))  # half of the secrets lose their keyword
    sizes = {(r["label"], r["held"]): r["count"] for r in findings.groupBy("label", "held").count().collect()}
    if len(sizes) < 4 or min(sizes[c, False] + sizes[c, True] for c in (0, 1)) < 12:
        return None
    shares = min(SHARES, -(-(sizes[0, False] + sizes[1, False]) // PER_SHARE))
    train = findings.where(~F.col("held")).select("window", "label", "bare", F.pmod(F.xxhash64("window", F.lit(2)), F.lit(shares)).alias("share"))
    net, step = fresh_net(), 0
    moments = fresh_moments(net)
    for epoch in range(epochs):
        rows = train.groupBy("share").applyInArrow(_share_pass(_packed(net, moments), step, epoch), "share bigint, n bigint, step bigint, state binary").collect()
        rows.sort(key=lambda r: r["share"])
        total = sum(r["n"] for r in rows)
        net, moments = _unpacked(sum(np.frombuffer(bytes(r["state"])) * (r["n"] / total) for r in rows))
        step = round(sum(r["step"] * r["n"] for r in rows) / total)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes(batch)
            score = [net.forward(codes[i:i + 512])[0] for i in range(0, len(codes), 512)]
            place = np.floor(np.clip(np.concatenate([*score, np.zeros(0)]), -SCORE_LIMIT, SCORE_LIMIT) * CELL).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("label")], names=["cell", "label"])

    held = findings.where("held").select("window", "label", "bare").mapInArrow(lean(cells), "cell int, label int").groupBy("cell", "label").count()
    seen = sorted((r["cell"], r["label"], r["count"]) for r in held.collect())
    cell, y, count = (np.array(v, float) for v in zip(*seen, strict=True))
    calibrate(net, cell / CELL, y, count, recall)  # the lower edge of a cell: no held-out score in it is lost
    return net


def _codes(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    codes = codes_of(table.column("window").to_pylist())
    codes[np.array(table.column("bare").to_pylist(), bool), :LEFT] = 0
    return codes


def _share_pass(state: np.ndarray, step: int, epoch: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(sorted(range(len(table)), key=table.column("window").to_pylist().__getitem__)))  # any order of arrival
        net, moments = _unpacked(state)
        share = table.column("share")[0].as_py()
        rng = np.random.RandomState([5, epoch, share])
        done = one_pass(net, moments, step, _codes(table), np.array(table.column("label").to_pylist(), float), rng.permutation(len(table)))
        return pa.table({"share": pa.array([share], pa.int64()), "n": pa.array([len(table)], pa.int64()), "step": pa.array([done], pa.int64()),
                         "state": pa.array([_packed(net, moments).tobytes()], pa.binary())})
    return run


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: sorted arrays of struct(start, rank, stop); rank is the place in KINDS."""
    scanned = cut_lineage(keyed_texts(docs).mapInArrow(lean(_scan), SCHEMA))
    shared = docs.sparkSession.sparkContext.broadcast(train_net(scanned))  # some thousand numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            spans = batch.column(6).flatten()  # the windows of one candidate each, one at least
            keep = np.zeros(len(spans), bool)
            if net is not None and len(keep):
                score = net.probability(codes_of(spans.flatten().to_pylist()))
                count = pc.list_value_length(spans).to_numpy()
                keep = np.maximum.reduceat(score, np.cumsum(count) - count) >= net.threshold
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(6)).to_numpy())])
            rows = [keep[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(rows, pa.list_(pa.bool_()))],
                                             names=["doc_id", "rank", "start", "stop", "c_start", "c_stop", "secret"])

    wide = scanned.select("doc_id", "rank", "start", "stop", "c_start", "c_stop", "c_window").mapInArrow(
        lean(score), "doc_id bigint, rank array<int>, start array<bigint>, stop array<bigint>, c_start array<bigint>, c_stop array<bigint>, secret array<boolean>")
    base = F.transform(F.arrays_zip("rank", "start", "stop"), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop")))
    more = F.transform(F.filter(F.arrays_zip("c_start", "c_stop", "secret"), lambda s: s["secret"]),
                       lambda s: F.struct(s["c_start"].alias("start"), F.lit(KINDS.index("model")).alias("rank"), s["c_stop"].alias("stop")))
    return wide.select("doc_id", F.array_sort(base).alias("base"), F.array_sort(more).alias("added"))


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["stop"])), ",")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("bigint")
