"""The corpus pipeline against plain versions of its stages."""

from __future__ import annotations

import pyarrow.parquet as pq

import corpus_pipeline
from vesper.llm import pii
from vesper.llm._session import saved
from vesper.llm.queries import DEMO_KEY

from . import brute
from .test_operators import SF


def test_stages(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, made = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), name, keep=True)
        made[name] = docs.collect()
        if name != "pack":
            assert docs.columns == columns
    assert len(made["language_id"]) == len(rows)
    groups = brute.near_duplicates([(r["doc_id"], r["text"]) for r in rows])
    assert {r["doc_id"] for r in made["near_dedup"]} == {i for i, j in groups.items() if i == j}
    items = [" ".join(brute.words(x["text"])) for x in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    clean = {r["doc_id"] for r in made["near_dedup"] if not any(f" {b} " in f" {' '.join(brute.words(r['text']))} " for b in items if b)}
    assert {r["doc_id"] for r in made["decontaminate"]} == clean
    keyed = pii.Keyed(DEMO_KEY)
    before = {r["doc_id"]: r["text"] for r in made["decontaminate"]}
    assert all(r["text"] == pii.rewrite(keyed, before[r["doc_id"]], {})[0] and r["n_chars"] == len(r["text"]) for r in made["pii"])
    assert {r["doc_id"] for r in made["pack"]} == clean
    again = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["ids_crc32"])
    assert sorted(map(key, again)) == sorted(map(key, made["pack"]))


def test_one_row_of_repeated_ones_stays(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (3, "", "en", "s", 0), (4, None, "en", "s", 0), (None, "x y z", "en", "s", 5)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "3", "4", "None"]
