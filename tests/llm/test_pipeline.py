"""Decontamination against a full edit-distance table, and the pipeline on planted documents."""

import os
import random
import re

import pytest
from llm.conftest import prose
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from fieldloom.llm import decontaminate, minhash

WORD = re.compile(r"[^\W_]+")


def nearest_by_table(item, text):
    """The least word edit distance of the item to any part of the text."""
    above = [0] * (len(text) + 1)
    for i, w in enumerate(item, start=1):
        row = [i]
        for j, v in enumerate(text, start=1):
            row.append(min(above[j - 1] + (w != v), above[j] + 1, row[-1] + 1))
        above = row
    return min(above)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[k] = "other" + str(rng.randrange(99))
        elif kind == 1:
            del words[k]
        else:
            words.insert(k, "more")
    return words


def test_nearest_equals_the_table():
    rng = random.Random(3)
    for _ in range(300):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 70))]
        text = [rng.randrange(6) for _ in range(rng.randrange(60))]
        masks = {}
        for i, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << i
        assert decontaminate.nearest(masks, len(item), text)[0] == nearest_by_table(item, text)


@pytest.mark.parametrize("block_chars", [8_000_000, 900])
def test_find_items(spark, make_docs, block_chars):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randrange(8, 60))) for i in range(14)] + [(90, "too short"), (91, None), (92, "")]
    texts = ["", None, "É " * 2000]
    for i in range(60):
        words = prose(rng, 80).split()
        if i % 3:
            part = edited(rng, items[i % 14][1].split(), i % 6)
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() if i % 2 else w + "," for w in part]
        texts.append(" ".join(words) if i % 4 else "\n".join(words))
    docs = make_docs([*texts, (3, texts[4])])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = decontaminate.find_items(docs.withColumn("item_id", F.lit(5)), bench, block_chars=block_chars).collect()
    want = {}
    for i, t in enumerate(texts):
        words = WORD.findall((t or "").lower())
        for k, s in items:
            own = WORD.findall((s or "").lower())
            if len(own) >= 8 and (d := nearest_by_table(own, words)) <= len(own) // 10:
                want[i, k] = d
    got = {(r.doc_id, r.item_id): r.n_edits for r in found if r.doc_id != 3}
    assert got == {k: d for k, d in want.items() if k[0] != 3} and len(want) > 20
    for r in found:
        if r.doc_id == 3:
            continue
        words = WORD.findall((texts[r.doc_id] or "").lower())[r.start_word:r.end_word]
        own = WORD.findall(dict(items)[r.item_id].lower())
        assert abs(len(words) - len(own)) <= r.n_edits and nearest_by_table(own, words) == r.n_edits
    clean = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, block_chars=block_chars).where("doc_id <> 3").collect()}
    assert clean == set(range(len(texts))) - {i for i, _ in want} - {3}
    assert decontaminate.find_items(docs, bench.limit(0)).count() == 0 and decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.find_items(docs.limit(0), bench).count() == 0


@pytest.fixture(scope="module")
def planted(spark, make_docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    rng = random.Random(11)
    items = [prose(rng, 30) for _ in range(5)]
    texts = {}
    for i in range(40):  # clean
        texts[i] = prose(rng, 120) + "\n" + prose(rng, 60)
    for i in range(40, 60):  # junk, in two styles
        texts[i] = " ".join(w + rng.choice(["###", "$$$"]) for w in prose(rng, 100).split()) if i % 2 else "again and again " * 60
    for i in range(60, 70):  # exact copies
        texts[i] = texts[i - 60]
    for i in range(70, 80):  # near copies on one line
        words = texts[i - 50].replace("\n", " ").split()
        words[7] = "changed"
        texts[i] = " ".join(words)
        texts[i - 50] = texts[i - 50].replace("\n", " ")
    for i in range(80, 85):  # benchmark passages
        texts[i] = prose(rng, 80) + " " + items[i - 80] + " " + prose(rng, 80)
    for i in range(85, 90):  # a passage of an earlier document on lines of its own
        texts[i] = prose(rng, 90) + "\n" + texts[i - 85].split("\n")[1] + "\n" + prose(rng, 70)
    for i in range(200, 300):  # what the model learns from
        texts[i] = prose(rng, 100) if i % 2 else " ".join(w + rng.choice(["###", "$$$"]) for w in prose(rng, 100).split())
    make_docs(sorted(texts.items())).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(200, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def test_stages_keep_clean_documents_and_drop_planted_ones(spark, planted):
    folder, texts = planted
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = set(range(40))
    assert not kept["quality"].keys() & set(range(40, 60)) and kept["quality"].keys() >= clean | set(range(60, 90))
    assert not kept["line_dedup"].keys() & set(range(60, 70)) and all(kept["line_dedup"][i] == texts[i] for i in clean)
    for i in range(85, 90):
        assert texts[i - 85].split("\n")[1] not in kept["line_dedup"][i] and len(kept["line_dedup"][i].split("\n")) == 2
    assert not kept["near_dedup"].keys() & set(range(70, 80)) and kept["near_dedup"].keys() >= clean | set(range(80, 90))
    assert not kept["decontamination"].keys() & set(range(80, 85)) and kept["decontamination"].keys() >= clean | set(range(85, 90))


def test_run_equals_the_stages(spark, planted):
    folder, _ = planted
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = out.collect()
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and {r.doc_id for r in rows} >= set(range(40))


def test_empty_tables_pass_all_stages(spark, planted):
    folder, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_pipeline_threshold_is_at_least_point_eight(spark, make_docs):
    rng = random.Random(1)
    base = prose(rng, 200).split()
    far = list(base)
    for k in range(0, 200, 12):
        far[k] = "else"
    kept = minhash.keep_one(make_docs([" ".join(base), " ".join(far)]), 80)
    assert kept.count() == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_every_text_query_runs(spark):
    names = [n for n in entry.queries() if not n.startswith("q_")]
    assert {n.split("_")[0] for n in names} == {"pipeline", *(f"op{i}" for i in range(1, 14))}
    for n in names:
        assert entry.queries()[n](spark, "/root/testdata/sf0.001").count() > 0, n
