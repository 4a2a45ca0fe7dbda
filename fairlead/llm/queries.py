"""The queries of this subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm import bpe, html_extract, jaccard_join, lexical, lm_score, media, packing, pii, quality_classifier, quality_rules, spelling, sql, vantage, warc
from fairlead.llm.common import table

#: Arrow batches of the queries over whole texts: long documents come in small batches.
BATCH_ROWS = 1000
TOKENIZER = "word_bpe_49k.json"
#: How far nearest-neighbour search relaxes its pruning.
FACTOR = 2.0


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return table(spark, sf_dir, "documents").select(*columns)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path(TOKENIZER), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
    return rows.drop("text")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability"]
    return quality_rules.judge(documents(spark, sf_dir, "doc_id", "text"), columns=["doc_id"]).select("doc_id", *columns)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path(TOKENIZER))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.detect_pii(documents(spark, sf_dir, "doc_id", "text")).drop("text")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select(
        "doc_id",
        *map(of, pii.KINDS),
        F.sha2(joined("base_spans"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        (F.size("spans") - F.size("base_spans")).cast("long").alias("n_added"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, model).select("doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.to_media(documents(spark, sf_dir, "doc_id", "text")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read_archives(warc.write_archives(warc.with_revisits(pages))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir, "doc_id", "text", "lang"), group="lang")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir, "doc_id", "text"), spoil_every=97)


def op12_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.neighbours(table(spark, sf_dir, "embeddings"), factor=FACTOR)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), documents(spark, sf_dir, "doc_id", "text"))


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op2 SQL can say: all but the verdict."""
    return op2_quality_rules(spark, sf_dir).drop("kept", "quality_probability")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op4 SQL can say: how many base identifiers of each kind."""
    return op4_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.KINDS))


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op8 SQL can say: the payload that comes back from the images."""
    return op8_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op10 SQL can say: the base scores."""
    rows = op10_lm_score(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 2).alias("base_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_bpe, op2_quality_rules, op3_packing, op4_pii, op5_quality_classifier, op6_jaccard_join, op7_html_extract, op8_media, op9_warc, op10_lm_score]
    own += [op11_spelling, op12_vantage, op13_lexical]
    own += [rules_base, pii_counts, media_payload, lm_base]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
