"""Recall of planted cases, held-out figures, and what the pipeline does with odd rows."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vesper.llm import _session, decontaminate, packing, pii, queries, secrets, substring_dedup

from . import brute
from .test_operators import SF, _bpe, documents, prose, table  # noqa: F401


def edited(words: list[str], rate: float, r: random.Random) -> list[str]:
    return [prose(r.randint(0, 1 << 30), 1) + "x" if r.random() < rate else w for w in words]


def test_fuzzy_passages_are_found_at_all_rates_that_count(spark):
    """80 pairs of documents for each rate of replaced words; some first documents have been copied whole by others, so that seeds have many holders."""
    r, rows, planted = random.Random(12), [], {}
    for rate in (0.03, 0.06, 0.1, 0.15):
        for i in range(80):
            n, key = r.choice((60, 80, 100)), len(rows)
            shared = prose(r.randint(0, 1 << 30), n).split()
            rows.append((key, f"{prose(3 * key + 1, 60)} {' '.join(shared)} {prose(3 * key + 2, 50)}", "en", "s"))
            rows.append((key + 1, f"{prose(7 * key + 3, 45)} {' '.join(edited(shared, rate, r))} {prose(7 * key + 4, 70)}", "en", "s"))
            planted[key, key + 1] = (rate, {key: (60, 60 + n), key + 1: (45, 45 + n)})
            if i % 4 == 0:
                rows.append((key + 2, f"{prose(9 * key + 5, 30)} {' '.join(shared)} {prose(9 * key + 6, 30)}", "en", "s"))
    rows += [(100_000 + i, prose(50_000 + i, 200), "en", "s") for i in range(200)]
    got: dict = {}
    for x in substring_dedup.passages(table(spark, rows)).collect():
        got.setdefault(x["doc_id"], []).append((x["start_word"], x["end_word"]))
    assert not [i for i in got if i >= 100_000]
    for rate in (0.03, 0.06, 0.1, 0.15):
        found = [all(any(min(b, e) - max(a, s) >= 0.8 * (b - a) for s, e in got.get(i, [])) for i, (a, b) in spans.items()) for q, spans in planted.values() if q == rate]
        assert np.mean(found) >= 0.9, (rate, np.mean(found))


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    got = queries.op7_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("toxic is not null").select("score", "toxic").collect()
    ones, zeros = (np.array([r["score"] for r in got if r["toxic"] == y]) for y in (1, 0))
    assert len(ones) > 20 and (ones[:, None] > zeros[None, :]).mean() > 0.9


def test_verdicts_by_owners(spark):
    values = {"one": "Lk19Jh28Gf37Ds46Aq55Mn64", "two": "Zx81Qw27Er36Ty45Ui54Op63", "many": "Pq71Rs62Tu53Vw44Xy35Za26"}
    rows = [(i, f"a {values['one']}", "en", "me") for i in range(4)] + [(10 + i, f"a {values['two']}", "en", f"o{i}") for i in range(2)] + [(20 + i, f"token = {values['many']}", "en", f"o{i}") for i in range(7)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(table(spark, rows), F.col("text"), F.col("doc_id"), F.col("source"), [F.col("doc_id")]).collect()}
    assert [s["kind"] for s in got[0]] == ["owned"] and got[10] == []
    assert [(s["kind"], s["verdict"], s["owners"]) for s in got[20]] == [("assign", "example", 7)]


def test_slots_are_one_to_one_and_names_of_any_script():
    item = "Then Bob has 30 apples and Mary has 7 pears so how many fruits do Bob and Mary have together now".encode()
    good = decontaminate.verify(b"Then Tom has 12 apples and Anna has 5 pears so how many fruits do Tom and Anna have together now", item)
    same = decontaminate.verify(b"Then Tom has 12 apples and Tom has 5 pears so how many fruits do Tom and Tom have together now", item)
    assert good["coverage"] == 1.0 and same["run"] < good["run"]
    greek = decontaminate.verify("Then Πέτρος has 12 apples and Иван has 5 pears so how many fruits do Πέτρος and Иван have together now".encode(), item)
    assert greek["coverage"] == 1.0


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, t bigint, node int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, 2) for i, t in rows], COLUMNS)


def test_texts_of_one_key_are_documents_of_their_own(spark):
    docs = rows_of(spark, [(1, prose(1, 60)), (1, prose(2, 60)), (1, prose(1, 60)), (None, prose(1, 60)), (None, prose(3, 60)), (None, prose(3, 60)), (2, None), (2, None), (3, ""), (4, prose(2, 60))])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted([("1", prose(1, 60)), ("1", prose(2, 60)), ("None", prose(3, 60)), ("2", ""), ("2", ""), ("3", "")])
    assert all(r["key"] == "k" and r["node"] == 2 for r in got)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table_and_on_extra_columns(spark, name, stage):
    docs = rows_of(spark, [(1, prose(1, 60)), (None, None), (2, "")])
    assert stage(spark, docs.where("false"), SF).collect() == []
    out = stage(spark, docs, SF)
    assert name == "pack" or out.columns == docs.columns
    out.collect()


def test_a_stage_leaves_tables_of_other_queries(spark):
    docs = rows_of(spark, [(i, prose(i, 40)) for i in range(5)])
    cut = packing.pieces(docs, F.col("text"), [F.col("doc_id")], path=_bpe()[0], pattern=_bpe()[1], end=2, capacity=1024)
    unfinished = packing.pack(cut, 1024)
    corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    corpus_pipeline.replace_personal_data(spark, docs, SF).collect()
    assert unfinished.count() == 5
    with _session.scope() as own:
        packing.pack(cut, 1024).collect()
    assert own
    _session.release(spark, own)
    assert not own


def test_surrogates_over_a_corpus_are_distinct_and_constant(spark, documents):
    keyed, seen = pii.Keyed(queries.DEMO_KEY), {}
    got = {r["doc_id"]: r for r in queries.op1_pii_surrogates(spark, SF).collect()}
    for i, t, *_ in documents:
        want, spans = pii.rewrite(keyed, t or "", {})
        assert (got[i]["text"] or "") == want and got[i]["entities"] == ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
        for e in pii.entities(t or ""):
            made = pii._surrogate(keyed, (t or ""), e, {})
            kind, norm = ("phone", e[3][-10:]) if e[2] == "phone" else e[2:]
            plain = "".join(c for c in made.lower() if c.isalnum())[-10 if kind == "phone" else 0 :]
            assert seen.setdefault((kind, norm), plain) == plain and plain != "".join(c for c in norm.lower() if c.isalnum())
    assert len(set((k, v) for (k, _), v in seen.items())) == len(seen) > 10


def test_secret_query_like_the_definition(spark, documents):
    got = {r["doc_id"]: r for r in queries.op6_secret_scan(spark, SF).collect()}
    for i, t, *_ in documents:
        want = brute.secrets(t)
        assert got[i]["base_sha256"] == sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(got[i]["spans"].split(",")) | {""}
