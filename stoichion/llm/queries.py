"""One query for each operator, over its whole tables, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoichion.llm import bagminhash, byte_bpe, decontamination, labelled, license_scan, line_rules, merkle, nbsvm, ngram_lm, secret_scan, sentence_spans, token_frames, toxic_gru, whitening
from stoichion.llm.keys import workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.scan(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_decontamination": op4_decontamination}


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bagminhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_representative"))


QUERIES["op9_near_duplicates"] = op9_near_duplicates


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES["op3_line_rules"] = op3_line_rules


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.remove_repeats(docs).select("doc_id", "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("changed"), "text")


QUERIES["op5_sentence_spans"] = op5_sentence_spans


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secret_scan.RULES
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), rules=rules, keep=["doc_id"])
    base = F.filter("spans", lambda x: x["rule"] < len(secret_scan.BASE))
    of = lambda i: F.size(F.filter("spans", lambda x: x["rule"] == i)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(secret_scan.span_text(base, rules), 256).alias("base_sha256"), secret_scan.span_text("spans", rules).alias("spans"),
    )


QUERIES["op6_secret_scan"] = op6_secret_scan


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "tokens")
    token_frames.write_tokens(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), folder)
    return token_frames.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def bpe_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    vocabulary = _vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), vocabulary), vocabulary)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(_table(spark, sf_dir, "documents"))


QUERIES |= {"op7_token_frames": op7_token_frames, "op8_byte_bpe": op8_byte_bpe}


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = nbsvm.fit(docs, labels, "quality", labelled.fold("doc_id", 5) != 0)
    scored = nbsvm.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", labelled.in_fold("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


QUERIES["op1_quality"] = op1_quality


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxic_gru.fit(docs, labels, "toxic", labelled.fold("doc_id", 3) != 1)
    scored = toxic_gru.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", labelled.in_fold("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


QUERIES["op2_toxicity"] = op2_toxicity


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",")
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), spans.alias("spans"))


QUERIES["op10_license_scan"] = op10_license_scan


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = _table(spark, sf_dir, "documents").select(*fields)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.try_add(F.col("n_chars"), F.lit(1))
    rows = docs.select(
        F.col("lang").alias("g"), F.col("doc_id").alias("key"), merkle.leaf(*fields).alias("leaf"),
        F.when(tampered & F.col("n_chars").isNotNull(), merkle.leaf("doc_id", "source", "lang", more, "text")).alias("seen"),
    )
    found = merkle.proofs(merkle.build(rows, workspace(spark, "manifest")))
    found = found.withColumn("folded_root", merkle.folded(merkle.hexed(F.coalesce("seen", "hash"))))
    hexed = lambda c, name: merkle.hexed(c).alias(name)
    return found.select(
        F.col("key").alias("doc_id"), hexed("hash", "leaf"), hexed("subroot", "subroot"), hexed("root", "root"),
        F.sha2(merkle.siblings(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == merkle.hexed("root")).alias("verified"),
    )


QUERIES["op12_merkle_manifest"] = op12_merkle_manifest


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = whitening.whiten(vectors, "embedding", workspace(spark, "whitening"))
    each = found.select("row.vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("k")).alias("explained"), "identity_error")


QUERIES["op11_whitening"] = op11_whitening


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ngram_lm.score(docs, labelled.fold("doc_id", 10) != 0, workspace(spark, "lm"))
    docs = found.select("row.doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return docs.select("doc_id", labelled.in_fold("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES["op13_lm_scores"] = op13_lm_scores
