"""Corpus pipeline: language, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a table: the columns of ``documents`` for all stages
but the last, which returns the packed pieces. A stage works on all that the one before has kept.

Defined results: extra columns of ``docs`` are kept, null keys and texts are allowed, and rows that share a key but not a
text are documents of their own. Of rows that repeat key and text, the second stage keeps one, but for texts without words,
which are near nothing. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesper.llm import decontaminate, language_id, near_dedup, packing, pii
from vesper.llm._session import fold, release, saved, scope, ship, table
from vesper.llm.queries import DEMO_KEY


CAPACITY = 1024
END = 2

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that the last stage called wrote for itself.
_before: set = set()


def _stage(function: Stage) -> Stage:
    """A stage begins when the one before is written: what that one wrote for itself goes, and nothing else."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        release(spark, _before)
        with scope() as own:
            out = function(spark, docs, sf_dir)
        _before.update(own)
        return out

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    return run


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; the others stay as they are."""
    model = language_id.fit(docs.where(fold("doc_id", 5) != 0))
    return language_id.predict(docs, model, output="_language").where(~F.col("_language.rejected")).select(*docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of smallest key, and one row of it where rows repeat."""
    kept = near_dedup.representatives(docs).select(F.col("key").alias("_key"), F.col("t").alias("_t"), F.col("rows").alias("_rows"))
    kept = saved(kept, "kept")
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_key")) & (F.xxhash64("text") == F.col("_t")))
    if kept.where("_rows > 1").isEmpty():
        return out.select(*docs.columns)
    once = out.where("_rows > 1").dropDuplicates(["doc_id", "_t"])
    return out.where("_rows = 1").unionByName(once).select(*docs.columns)


@_stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = decontaminate.contaminated(docs.withColumn("_row", F.struct("doc_id", F.xxhash64("text").alias("t"))), table(spark, sf_dir, "benchmark"), key="_row")
    bad = saved(leaks.select(F.col("_row.doc_id").alias("_leak"), F.col("_row.t").alias("_t")).distinct(), "leaks")
    same = F.col("doc_id").eqNullSafe(F.col("_leak")) & (F.xxhash64("text") == F.col("_t"))
    return docs.join(bad, same, "left_anti").select(*docs.columns)


@_stage
def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts get surrogates for personal data; n_chars follows the text."""
    out = pii.replace(docs, DEMO_KEY, spans=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    cut = packing.pieces(docs, F.col("text"), [F.col("doc_id")], path=str(public_tokenizers.path("byte_bpe_50k.json")), pattern=public_tokenizers.PATTERN, end=END, capacity=CAPACITY)
    return packing.pack(cut, CAPACITY)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("pii", replace_personal_data),
    ("pack", pack_sequences),
]

#: Hash signatures, trained centroids and tokenizer ids have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage returns is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
