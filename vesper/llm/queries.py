"""Queries of the training-data operators over the driver's tables: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, language_id, licenses, near_dedup, ogg, packing, pii, secrets, substring_dedup, toxicity, vector_codes, vector_dedup
from ._session import fold, table


#: Key of the registered queries alone; who publishes the results uses a secret one.
DEMO_KEY = b"registered queries, not a secret"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the whole text with surrogates, the number of replaced entities and their kinds and places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.replace(docs, DEMO_KEY)
    said = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"])), ",")
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), said.alias("entities"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and contained license templates of every document."""
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every document that holds a benchmark item, with coverage, run, place and changed slots."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = fold("doc_id", 5)
    model = language_id.fit(docs.where(remainder != 0))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as 8-bit samples in Ogg, read back, with digests of both forms and a feature string."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    docs = docs.withColumn("n_bytes", F.octet_length("raw").cast("long"))
    padded = F.expr("rpad(raw, cast(greatest(64, 64 * ceil(n_bytes / 64)) as int), X'00')")
    out = ogg.decode(ogg.encode(docs.select("doc_id", "n_bytes", padded.alias("given")), F.col("given"), note=F.encode(F.col("n_bytes").cast("string"), "UTF-8")), F.col("media"))
    feature = F.concat_ws(
        ";",
        F.format_string("pages=%d", "read.pages"),
        F.format_string("packets=%d", "read.packets"),
        F.format_string("streams=%d", "read.streams"),
        F.format_string("damaged=%d", "read.damaged"),
        F.format_string("seconds=%.6f", "read.seconds"),
        F.format_string("mean=%.6f", "read.mean"),
        F.format_string("rms=%.6f", "read.rms"),
        F.format_string("crossings=%d", "read.crossings"),
    )
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("read.payload").cast("long").alias("payload_bytes"),
        F.sha2("read.payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(read.payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and method spans of every document; a document stands for a repository, its source for the owner."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    got = secrets.scan(docs, F.col("text"), F.col("doc_id"), F.col("source"), [F.col("doc_id")])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    verdicts = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long").alias(f"n_{v}")
    return got.select("doc_id", *map(count, secrets.KINDS[:3]), "base_sha256", said.alias("spans"), *map(verdicts, ("live", "shared", "example")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = fold("doc_id", 4)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder != 2))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per passage of 50 words or more that documents share, but for edits, with the documents that had it before."""
    return substring_dedup.passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_dedup.near_duplicates(docs)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece of every document: its place in its document and in its sequence."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, F.col("text"), [F.col("doc_id")], path=str(public_tokenizers.path("byte_bpe_50k.json")), pattern=public_tokenizers.PATTERN, end=2, capacity=1024)
    return packing.pack(cut, 1024)


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per source, order of five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    text = F.col("text")
    parts = filter_audit.histograms(docs, "doc_id", F.col("source"), filter_audit.text_filters(text), text, labels, (F.col("quality") == 1, F.col("toxic") == 1))
    return filter_audit.audit(parts, 5, ["good_lost", "toxic_lost"])


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every embedding that is whole."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every embedding."""
    out = vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def queries() -> dict:
    return {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_license_scan": op2_license_scan,
        "op3_decontamination": op3_decontamination,
        "op4_language_id": op4_language_id,
        "op5_ogg_media": op5_ogg_media,
        "op6_secret_scan": op6_secret_scan,
        "op7_toxicity": op7_toxicity,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_near_dedup": op9_near_dedup,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_filter_interactions": op11_filter_interactions,
        "op12_vector_codes": op12_vector_codes,
        "op13_embedding_near_dedup": op13_embedding_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.oracle(),
        "op9_near_dedup": near_dedup.oracle(),
        "op11_filter_interactions": filter_audit.oracle(),
        "op12_vector_codes": vector_codes.oracle(),
        "op13_embedding_near_dedup": vector_dedup.oracle(),
    }
