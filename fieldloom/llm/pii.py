r"""Personal data, DataFrame functions only: base patterns, and weakly supervised spans beside them.

Base spans are the contract's patterns, written so that each text position is tried once: a run of
letters or digits is entered at its start (or where the last match ended, ``\G``) and never re-entered.
Positions come from ``split``: the gaps between matches and the matches add up to the offsets.

The method looks at more candidates (written-out addresses, local phone numbers, national ids, grouped
digits). Labelers vote on every candidate, base spans too: pattern, check digits and ranges, gazetteer,
words before, and neighbours that speak against. Votes and features are counted into patterns, whose number
is bounded by the votes; expectation-maximisation over these counts estimates how reliable each labeler is,
and its posteriors train a logistic span classifier over kind, shape and votes. Candidates that the classifier
accepts and that overlap no base span are added.

Defined cases: a missing text is empty and has no spans; every row is searched by itself, so repeated rows,
missing ids and clashing extra columns change nothing; an empty table gives an empty result. Texts of any
length are searched whole; matches are walked in blocks, so that a text of many matches takes time in proportion
to them (and to a small part of their square, from millions in one text on).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

KINDS = ["email", "ip", "card", "phone", "national_id"]
BASE_KINDS = KINDS[:4]

_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9])(?<![0-9][\x20-]))[0-9]++(?:[\x20-][0-9]++)*+(?<=[0-9][\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that every text with a span passes.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
WIDE = {
    "email": (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++", r"(?i)[\[(]at[\])]"),
    "phone": (r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
}
CONTEXT_CHARS = 24
GOOD_WORDS = {"email": "mail|contact|write|reach", "ip": "ip|addr|host|server|login", "card": "card|visa|master|amex|pay|credit",
              "phone": "phone|tel|call|mobile|fax|contact", "national_id": "ssn|social|national|id"}
BAD_WORDS = r"version|isbn|issue|order|sku|build|release|#$"
#: Common endings of addresses and country calling codes.
DOMAIN_ENDS = r"(?i)[. )\]](?:com|org|net|edu|gov|io|de|fr|es|uk|it|nl|ch)$"
CALLING_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SPANS = "array<struct<start:bigint,rank:int,end:bigint,value:string,context:string,base:boolean>>"
BLOCK = 128
VOTES = ["format", "check", "gazetteer", "before", "against"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the check-digit test."""
    ones = F.transform(F.reverse(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0))), lambda x: x.cast("int"))
    counted = F.transform(ones, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(counted, F.lit(0), lambda t, x: t + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return digits.between(14, 19) & luhn(_digits(value))
    if kind == "phone":
        return digits.between(10, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda s: _valid(kind, s["value"])


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, not wherever it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: Column) -> Column:
    """The items in runs of BLOCK: what copies a list once per item then copies a short one."""
    firsts = F.filter(F.sequence(F.lit(0), F.ceil(F.size(items) / BLOCK).cast("int")), lambda b: b * BLOCK < F.size(items))
    return F.transform(firsts, lambda b: F.slice(items, b * BLOCK + 1, BLOCK))


def _found(text: Column, kind: str, pattern: str, hint: str, base: bool) -> Column:
    """Matches as array<struct(start, rank, end, value, context, base)>, code points, in order."""
    rank = KINDS.index(kind)
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g"))
    blank = F.array().cast(SPANS)

    def step(a, x):
        start = a["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        row = F.struct(start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), end.cast("bigint").alias("end"), x["m"].alias("value"),
                       F.lower(F.right(x["g"], F.lit(CONTEXT_CHARS))).alias("context"), F.lit(base).alias("base"))
        return F.struct(end.cast("bigint").alias("at"), F.concat(a["out"], F.array(row)).alias("out"))

    def block(a, items):
        inside = F.aggregate(items, F.struct(a["at"].alias("at"), blank.alias("out")), step)
        return _let(inside, lambda w: F.struct(w["at"].alias("at"), F.concat(a["out"], F.array(w["out"])).alias("out")))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    walked = _let(zipped, lambda z: F.flatten(F.aggregate(_blocks(z), start, block)["out"]))
    return F.when(text.contains(hint) if hint == "@" else text.rlike(hint), walked).otherwise(blank)


def _apart(more: Column, base: Column) -> Column:
    """The spans of ``more`` that overlap no base span; base spans are skipped in runs by their outer bounds."""
    runs = _let(F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))), lambda sorted_: F.transform(
        _blocks(sorted_), lambda r: F.struct(F.array_min(r["start"]).alias("low"), F.array_max(r["end"]).alias("high"), r.alias("spans"))))

    def touches(m, b):
        return (b["start"] < m["end"]) & (m["start"] < b["end"])

    return _let(runs, lambda rs: F.filter(more, lambda m: ~F.exists(
        rs, lambda r: (r["low"] < m["end"]) & (m["start"] < r["high"]) & F.exists(r["spans"], lambda b: touches(m, b)))))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _features(s: Column) -> dict[str, Column]:
    """Votes and shape of one span."""
    value, context, rank = s["value"], s["context"], s["rank"]
    digits = F.length(_digits(value))

    def by_kind(of) -> Column:
        out = F.lit(False)
        for i, k in enumerate(KINDS):
            out = F.when(rank == i, of(k)).otherwise(out)
        return out

    checked = by_kind(lambda k: _valid(k, value) if k in BASE_KINDS and k != "phone" else ~value.rlike("^(?:000|666|9)|-00-|-0000$|555-01"))
    listed = by_kind(lambda k: {"email": value.rlike(DOMAIN_ENDS), "phone": value.rlike(CALLING_CODES) | value.rlike(r"^\(?[2-9]"),
                                "ip": ~value.rlike(r"^(?:0|255)\."), "card": value.rlike("^[3-6]")}.get(k, F.lit(False)))
    near = by_kind(lambda k: context.rlike(GOOD_WORDS[k]))
    return {"format": _vote(s["base"], F.lit(False)), "check": _vote(checked, ~checked), "gazetteer": _vote(listed, ~listed & (rank <= 3)),
            "before": _vote(near, F.lit(False)), "against": _vote(F.lit(False), context.rlike(BAD_WORDS) | context.rlike("[0-9a-z]$")),
            "kind": rank, "shape": F.when(digits == 0, 0).when(digits < 9, 1).when(digits < 13, 2).otherwise(3)}


FEATURES = [*VOTES, "kind", "shape"]


def label_model(patterns: list[dict], rounds: int = 40) -> tuple[dict, float, list[float]]:
    """Expectation-maximisation over vote patterns with counts: reliabilities, prior, posteriors.

    Each labeler speaks truly with its own reliability and is silent at random; labelers err independently.
    """
    trust, prior = dict.fromkeys(VOTES, 0.8), 0.7
    post = [prior] * len(patterns)
    for _ in range(rounds):
        for i, p in enumerate(patterns):
            odds = math.log(prior / (1 - prior))
            for v in VOTES:
                odds += p[v] * math.log(trust[v] / (1 - trust[v]))
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        weight = sum(p["n"] for p in patterns)
        prior = min(0.99, max(0.01, (sum(p["n"] * q for p, q in zip(patterns, post, strict=True)) + 1) / (weight + 2)))
        for v in VOTES:
            spoke = sum(p["n"] for p in patterns if p[v])
            right = sum(p["n"] * (q if p[v] > 0 else 1 - q) for p, q in zip(patterns, post, strict=True) if p[v])
            trust[v] = min(0.98, max(0.55, (right + 8) / (spoke + 10)))  # no worse than chance: keeps the labels' sense
    return trust, prior, post


def span_classifier(patterns: list[dict], post: list[float], passes: int = 300, ridge: float = 0.01) -> dict[tuple[str, int], float]:
    """Logistic weights of each feature value, fitted to the posteriors of the counted patterns."""
    weights: dict[tuple[str, int], float] = {("bias", 0): 0.0}
    for p in patterns:
        weights.update({(f, p[f]): 0.0 for f in FEATURES})
    total = sum(p["n"] for p in patterns) or 1
    for _ in range(passes):
        slope = {k: ridge * w for k, w in weights.items()}
        for p, q in zip(patterns, post, strict=True):
            keys = [("bias", 0), *((f, p[f]) for f in FEATURES)]
            miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[k] for k in keys))))) - q
            for k in keys:
                slope[k] += miss * p["n"] / total
        for k in weights:
            weights[k] -= 0.5 * slope[k]
    return weights


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, base and added: sorted arrays of struct(start, rank, end, value), rank being the place in KINDS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    raw = [_found(F.col("text"), k, BASE[k], HINT[k], True).alias(k) for k in BASE_KINDS]
    wide = [_found(F.col("text"), k, p, h, False).alias(f"wide_{k}") for k, (p, h) in WIDE.items()]
    base = F.concat(*[F.filter(F.col(k), _checker(k)) for k in BASE_KINDS])
    more = F.concat(*[F.col(f"wide_{k}") for k in WIDE])
    seen = row.select("doc_id", *raw, *wide).select("doc_id", base.alias("base"), more.alias("more"))
    free = _apart(F.col("more"), F.col("base"))

    def keyed(spans: Column) -> Column:
        return F.array_sort(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["value"].alias("value"),
            F.concat_ws("/", *[v.cast("string") for v in _features(s).values()]).alias("key"))))

    spans = cut_lineage(seen.select("doc_id", "base", free.alias("more")).select("doc_id", keyed(F.col("base")).alias("base"), keyed(F.col("more")).alias("more")))
    counted = spans.select(F.explode(F.concat("base", "more")).alias("s")).groupBy(F.col("s.key").alias("key")).agg(F.count("*").alias("n"))
    patterns = [dict(zip(FEATURES, map(int, r["key"].split("/")), strict=True), n=r["n"], key=r["key"]) for r in counted.orderBy("key").collect()]  # bounded by the votes
    _, _, post = label_model(patterns)
    weights = span_classifier(patterns, post)
    taken = F.lit([p["key"] for p in patterns if _probability(weights, p) >= threshold] or [""])
    return spans.select("doc_id", _trim(F.col("base")).alias("base"), _trim(F.filter("more", lambda m: F.array_contains(taken, m["key"]))).alias("added"))


def _probability(weights: dict, p: dict) -> float:
    return 1 / (1 + math.exp(-(weights[("bias", 0)] + sum(weights.get((f, p[f]), 0.0) for f in FEATURES))))


def _trim(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["value"].alias("value")))


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("bigint")
