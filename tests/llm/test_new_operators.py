"""Source divergence, spelling variants and fingerprints against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import divergence, fingerprints, spelling
from fieldloom.llm.queries import SQL
from tests.llm.conftest import DOC_SCHEMA, prose


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ---------------------------------------------------------------- source divergence

def brute_divergence(rows, min_docs=3, top=200):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(t for _, _, terms in own for t in set(terms))
        kept = {t for t, n in docs.items() if n >= min_docs}
        count = {s: Counter() for _, s, _ in own}
        for _, s, terms in own:
            count[s].update(t for t in terms if t in kept)
        whole = sum(count.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s, c in count.items():
            pairs = [(-sum((share(c, t) - share(d, t)) ** 2 // share(d, t) for t in kept), o.encode(), o) for o, d in count.items() if o != s]
            terms = [(-((share(c, t) - share(whole, t)) ** 2 // share(whole, t)), t.encode(), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(items)]
    return sorted(out)


def lang_docs(spark, rows, schema="doc_id long, lang string, source string, text string"):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


ODD_TERMS = ["the", "The", "été", "Été", "ﬀ", "日本", "a", "x1y", "\x7f", "İ", "zebra", "é"]


@pytest.mark.parametrize("top", [3, 200])
def test_divergence_matches_plain_counts(spark, top):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None]),
             " ".join(rng.choices(ODD_TERMS, k=rng.randrange(0, 25)))) for _ in range(160)]
    rows += [("en", "s1", "long " * 30_000), ("en", "s9", None), ("xx", "s1", "alone"), ("xx", "s2", ""), ("en", "s1", "the the"), ("en", "s1", "the the")]
    got = divergence.audit_sources(lang_docs(spark, rows).withColumn("term", F.lit(1)).withColumn("n", F.lit("clash")), top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, top=top)


def test_divergence_breaks_ties_by_utf8_inside_one_large_level(spark):
    rows = [("en", s, " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(500))) for s in ("a", "a", "a")] + [("en", "b", "other words")] * 3
    assert sorted(map(tuple, divergence.audit_sources(lang_docs(spark, rows)).collect())) == brute_divergence(rows)


def test_divergence_share_is_exact_beyond_64_bits(spark):
    n, total = 5 * 10**14, 9 * 10**15
    row = spark.range(1).select(divergence.scaled_share(F.lit(n), F.lit(total), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (total + 7)


def test_divergence_of_nothing(spark):
    assert divergence.audit_sources(lang_docs(spark, [])).count() == 0
    assert sorted(map(tuple, divergence.audit_sources(lang_docs(spark, [("en", "a", "one"), ("en", "b", None)])).collect())) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


# ---------------------------------------------------------------- spelling variants

def brute_spelling(rows, least_length=5, least_count=3, every=97):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= least_length and c >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out, form = {}, {}
    for w in n:
        close = [u for u in n if u != w and near(w, u)]
        best = min(close, key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(close)

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], out[w], n.get(form[w], 0)) for w in n)


def spelled(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@pytest.mark.parametrize("crowd", [1, 2, 48])
@pytest.mark.parametrize("letters", ["ab", "abéÿ"])
def test_spelling_matches_all_pairs(spark, letters, crowd):
    rng = random.Random(len(letters))
    words = ["".join(rng.choices(letters, k=rng.randrange(3, 9))) for _ in range(150)]
    rows = [(i if i % 7 else None, " ".join(rng.choices(words, k=60)).upper() if i % 5 == 0 else "-".join(rng.choices(words, k=60))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "é×÷ ÀÖØöøÿ aaaaa"), (53, "ab" * 40_000), (7, rows[1][1]), (7, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    assert spelled(spelling.spelling_variants(docs, crowd=crowd, every=5)) == brute_spelling(rows, every=5)


def test_spelling_follows_chains_and_long_words(spark):
    long = "abcdefghijklmnopqrstuvwxyz" * 4
    count = {"caaaa": 3, "cbaaa": 6, "cbbaa": 12, "cbbba": 24, "cbbbb": 48, long: 4, long + "x": 9, long[1:]: 8}
    rows = [(1, " ".join(w for w, n in count.items() for _ in range(n)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelled(spelling.spelling_variants(docs, crowd=1))
    assert got == brute_spelling(rows)
    assert {r[2] for r in got if r[0].startswith("c")} == {"cbbbb"}


def test_spelling_of_a_crowded_prefix_makes_no_quadratic_join(spark):
    """Words that share their first half: keys grow until groups are small."""
    rng = random.Random(3)
    words = sorted({"common" + "".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)})
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), crowd=48)
    cut = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cut[i, w[:i] + w[i + 1:]].add(w)
    want = {(a, b) for group in cut.values() for a in group for b in group if a < b}
    assert {tuple(r) for r in got.collect()} == want


def test_crc_goes_on_from_a_prefix():
    words = [b"", b"a", b"abc" * 40, "été".encode(), b"word"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    lead = np.array([zlib.crc32(b"12:")] * len(words), np.uint32)
    assert spelling.crc_after(lead, data, ends - [len(w) for w in words], ends).tolist() == [zlib.crc32(b"12:" + w) for w in words]


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["op11_divergence", "op12_spelling"])
def test_sql_text_agrees(spark, name, tmp_path):
    from fieldloom.llm.queries import QUERIES

    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(0, 300), 90), rng.choice(["en", "fr"]), rng.choice(["s1", "s2", "s3"]), 0) for i in range(60)]
    spark.createDataFrame([*rows, (60, None, None, None, 0), (61, "Ünïcode ünïcode ünïcodé", "en", "s1", 0)], DOC_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        found = con.execute(SQL[name])
        names = [d[0] for d in found.description]
        want = sorted(map(str, found.fetchall()))
    got = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == want


# ---------------------------------------------------------------- fingerprints

def shingle_set(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def edited_texts(rows):
    """(text, edited, next) in descending order of doc_id; callers give unique ids."""
    order = [t or "" for _, t in sorted(rows, key=lambda r: -r[0])]
    ids = sorted((i for i, _ in rows), reverse=True)
    return {i: (t, t[:len(t) - len(t) // 2] + order[(k + 1) % len(order)][:len(t) // 2], order[(k + 1) % len(order)]) for k, (i, t) in enumerate(zip(ids, order))}


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def fingerprint_rows():
    rng = random.Random(8)
    rows = [(i * 3, prose(rng, rng.randrange(0, 120), 50)) for i in range(300)]
    return rows + [(1, None), (2, ""), (4, "é"), (5, "Ünï çöd 日本 𝄞𝄞 x"), (7, "one two"), (8, "ONE  two"), (10, rows[5][1]), (11, rows[5][1]), (-4, "w " * 9)]


def test_fingerprints_are_exact_for_small_sets(spark, make_docs):
    rows = fingerprint_rows()
    got = {r.doc_id: r for r in fingerprints.compare_edited(make_docs(rows).withColumn("chunk", F.lit("x")).withColumn("tie", F.lit(1))).collect()}
    want = edited_texts(rows)
    assert len(got) == len(rows)
    for i, (text, edited, after) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(edited.encode()).hexdigest()), i
        assert r.near_edited == pytest.approx(likeness(shingle_set(text), shingle_set(edited)))
        assert r.near_next == pytest.approx(likeness(shingle_set(text), shingle_set(after)))
        assert len(r.fingerprint) == 16 * len(shingle_set(text)) and r.n_shingles == len(shingle_set(text))
        assert len(r.edited_fingerprint) == 16 * len(shingle_set(edited))
    assert got[10].fingerprint == got[11].fingerprint == got[15].fingerprint


def test_fingerprints_of_repeated_and_missing_ids(spark, make_docs):
    rows = [(7, "same words in every row here")] * 400 + [(7, "other words stand in this row")] * 3 + [(None, "no id at all in here")] * 200 + [(9, "the last one of them all")]
    got = fingerprints.compare_edited(make_docs(rows)).collect()
    assert len(got) == len(rows)
    last = next(r for r in got if r.doc_id == 9)
    assert last.edited_sha256 in {sha256((rows[-1][1][:12] + t[:12]).encode()).hexdigest() for t in ("same words in every row here", "other words stand in this row")}
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == 7) >= 400
    assert fingerprints.compare_edited(make_docs([])).count() == 0
    only = fingerprints.compare_edited(make_docs([(3, "just a single document of words")])).first()
    assert (only.near_next, only.n_chars) == (1.0, 31)


def test_sketch_estimates_large_sets():
    rng = random.Random(1)
    common, left, right = (prose(rng, n, 4000) + " " for n in (6000, 3000, 9000))
    extra = [" ".join(str(rng.random()) for _ in range(n)) + " " for n in (6000, 3000, 9000)]
    texts = [extra[0] + extra[1] + left, extra[0] + extra[2] + right + common]
    a, b = fingerprints.sketches(pa.array(texts))
    x, y = map(shingle_set, texts)
    assert len(a) == len(b) == fingerprints.K
    assert fingerprints.overlap(a, b) == pytest.approx(likeness(x, y), abs=0.1)
    assert fingerprints.covered(a, b) == pytest.approx(len(x & y) / len(x), abs=0.15)
    assert fingerprints.cardinality(a) == pytest.approx(len(x), rel=0.2)


def test_merged_parts_equal_the_whole_and_columns_equal_arrays(spark):
    rng = random.Random(4)
    parts = [(i, rng.choice(["a", "b", None]), " ".join(f"p{rng.randrange(60)}" for _ in range(rng.randrange(0, 90)))) for i in range(60)]
    parts += [(99, "empty", ""), (98, "empty", None)]
    df = spark.createDataFrame(parts, "doc_id long, source string, text string")
    k = 32
    prints = fingerprints.fingerprint_texts(df, k).join(df.select("doc_id", "source"), "doc_id")
    got = {r.source: r.fingerprint for r in fingerprints.merge_fingerprints(prints, ["source"], k).collect()}
    for source in ("a", "b", None, "empty"):
        hashes = np.concatenate([fingerprints.shingles(*_bytes(t))[0] for _, s, t in parts if s == source])
        assert got[source] == fingerprints.written(np.unique(hashes)[:k])
    one, two = got["a"], got["b"]
    arrays = {n: np.frombuffer(bytes.fromhex(v), ">u8").astype(np.uint64) for n, v in (("x", one), ("y", two), ("z", ""))}
    texts = {"x": one, "y": two, "z": ""}
    for m in "xyz":
        for n in "xyz":
            row = spark.createDataFrame([(texts[m], texts[n])], "a string, b string").select(
                fingerprints.resemblance(F.col("a"), F.col("b"), k), fingerprints.containment(F.col("a"), F.col("b"), k), fingerprints.distinct_shingles(F.col("a"), k)).first()
            assert list(row) == pytest.approx([fingerprints.overlap(arrays[m], arrays[n], k), fingerprints.covered(arrays[m], arrays[n], k), fingerprints.cardinality(arrays[m], k)])


def _bytes(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return data, np.array([0, len(data)])


# ---------------------------------------------------------------- cases that earlier rounds cut

def test_short_items_are_found_word_for_word(spark, make_docs):
    from fieldloom.llm import decontaminate

    items = spark.createDataFrame([(1, "what is two plus two"), (2, ""), (3, None), (4, "two plus three")], "item_id long, text string")
    docs = make_docs([(0, "so, What is two plus two? four"), (1, "what is two and two"), (2, None)])
    got = [tuple(r) for r in decontaminate.find_items(docs, items).collect()]
    assert got == [(0, 1, 0, 1, 6)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [1, 2]


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_place_of_items_that_repeat_themselves(spark, make_docs):
    from fieldloom.llm import decontaminate

    rng = random.Random(12)
    items, docs = [], []
    for k in range(12):
        block = [f"w{rng.randrange(6)}" for _ in range(rng.randrange(5, 13))]
        item = block * 2
        items.append((k, " ".join(item)))
        broken = list(item)
        broken[rng.randrange(len(broken))] = "changed"
        docs.append((k, " ".join(broken[:len(block)] + item + [f"x{rng.randrange(9)}" for _ in range(5)] + broken)))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_items(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, text in docs:
        words = text.split()
        for k, item in items:
            pattern = item.split()
            least = min(word_distance(pattern, words[a:b]) for a in range(len(words)) for b in range(a + 1, min(len(words), a + 2 * len(pattern)) + 1))
            if least <= len(pattern) // 10:
                r = got[d, k]
                assert r.n_edits == least and word_distance(pattern, words[r.start_word:r.end_word]) == least
            else:
                assert (d, k) not in got


def test_pieces_over_64_words(spark, make_docs):
    from fieldloom.llm import decontaminate

    text = " ".join(f"word{i}" for i in range(150))
    got = decontaminate.find_items(make_docs([(5, "before " + text)]), spark.createDataFrame([(1, text)], "item_id long, text string"), errors=0.0)
    assert [tuple(r) for r in got.collect()] == [(5, 1, 0, 1, 151)]


def test_bad_branch_at_any_depth(spark):
    from fieldloom.llm import urls

    deep = "/".join("abcdefgh")
    rows = [(i, f"http://h.com/{deep}/{'bad' if i % 2 else 'good'}/p{i % 7}x") for i in range(120)] + [(500, "http://h.com/" + "/".join(f"s{i}" for i in range(300)))]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "page_id long, bad int")
    got = {r.page_id: r for r in urls.judge_pages(pages, labels).collect()}
    assert {got[i].verdict for i in range(0, 120, 2)} == {"allow"} and {got[i].verdict for i in range(1, 120, 2)} == {"block"}
    assert got[500].verdict == "allow" and got[500].template.count("/") == 300


def test_roles_with_control_marks_are_reversible(spark):
    from fieldloom.llm import chat

    rng = random.Random(7)
    marks = ["]", "[", "<", "\\", " ", "] ", "x", "[/ROLE]", "\n", "</s>", "\\]"]
    rows = [(c, t, "".join(rng.choices(marks, k=rng.randrange(1, 5))), "".join(rng.choices(marks, k=rng.randrange(6)))) for c in range(60) for t in range(3)]
    rows += [(100, 0, "x] y", "z")]
    made = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = {}
    for c, _, role, text in sorted(rows):
        want[c] = want.get(c, "") + f"{role}\n{text}\n"
    got = {r.conv_id: r.turns_sha256 for r in chat.read_back(made).collect()}
    assert got == {c: sha256(w.encode()).hexdigest() for c, w in want.items()}
    with pytest.raises(Exception, match="turn order"):
        chat.read_back(made.orderBy(F.desc("seq"))).collect()


def test_repeated_labelled_ids_give_one_row_each(spark, make_docs):
    from fieldloom.llm import quality

    docs = make_docs([(1, f"text {i}") for i in range(500)] + [(2, "other")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert sorted(map(tuple, quality.labelled_sample(docs, labels, 5).select("doc_id", "text").collect())) == [(1, "text 0"), (2, "other")]
