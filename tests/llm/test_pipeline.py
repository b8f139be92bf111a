"""The pipeline's stages, each on its own input, against brute force."""

from __future__ import annotations

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(6)]
    docs, labels, bad, copies, leaks = [], [], set(), set(), set()
    for i in range(240):
        text = " ".join(word() for _ in range(80))
        if i % 8 == 0:
            text = " ".join(f"{w.upper()}***" for w in text.split())
            bad.add(i)
        docs.append([i, text])
        labels.append((i, int(i not in bad), 0))
    for i in range(240, 260):
        docs.append([i, docs[(i - 240) * 8 + 1][1] + " more"])
        copies.add(i)
    for i in range(260, 266):
        docs.append([i, " ".join(word() for _ in range(40)) + " " + items[i - 260][1] + " end"])
        leaks.add(i)
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, bad, copies, leaks


def test_stages_and_run(spark, tables):
    folder, rows, bad, copies, leaks = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    every = {r[0] for r in rows}
    one = pipeline.quality_stage(spark, docs, folder)
    assert one.columns == docs.columns and ids(one) == every - bad
    two = pipeline.near_dup_stage(spark, docs, folder)
    assert two.columns == docs.columns and ids(two) == every - copies
    three = pipeline.decontaminate_stage(spark, docs, folder)
    assert three.columns == docs.columns and ids(three) == every - leaks
    four = pipeline.mixing_stage(spark, docs, folder)
    assert four.columns == docs.columns and ids(four) <= every
    out = pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} <= every - bad - copies - leaks and len({r.shard for r in out}) == 24
    text = {r[0]: r[1] for r in rows}
    assert all(r.text == text[r.doc_id] and r.source == f"s{r.doc_id % 4}" for r in out)


def test_shards_are_written(spark, tables, tmp_path):
    pipeline.write(spark, tables[0], f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out").select("shard", "slot", "text").collect()
    assert len({(r.shard, r.slot) for r in got}) == len(got) > 100 and all(r.text for r in got)


def test_stages_take_odd_tables(spark, tables):
    folder = tables[0]
    odd = [(1, None, None, None, None), (1, "", "en", "a", 0), (None, "words of a text", "en", "a", 1), (2, "words of a text", "en", None, 1), (2, "words of a text", "en", None, 1)]
    for rows in (odd, []):
        df = spark.createDataFrame(rows, SCHEMA)
        for _, stage in pipeline.STAGES:
            assert stage(spark, df, folder).count() <= 4 * len(rows)


def test_entry_has_all_eleven():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in pipeline.STAGES] and len(pipeline.STAGES) == 5
