"""The registered queries of this folder: operators over whole tables, results as digests where asked for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import bpe, lines, main_text, minhash, mixing, privacy, quality, repeats, secrets, sql, token_counts, token_files, vectors, whitening
from timberline.llm.common import WORD, table, text_of
from timberline.session import new_path

TOKEN_LIMIT = 1024
#: Of the registered query only; real use gives its own secret.
SURROGATE_KEY = "timberline-demo-key"


def op1_columns(scanned: DataFrame) -> DataFrame:
    return scanned.select(F.col("id").alias("doc_id"), "s.n_assign", "s.n_access", "s.n_hex",
                          F.sha2(F.col("s.base").cast("binary"), 256).alias("base_sha256"), "s.spans")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op1_columns(secrets.scan(docs, secrets.fit(docs)))


def op2_columns(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return op2_columns(bpe.encode(table(spark, sf_dir, "documents"), ranks, decoded=True))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    token_files.write_ids(token_files.encode_in_order(docs, public_tokenizers.path("byte_bpe_50k.json")), path)
    stored = token_files.read_ids(spark, path, docs.schema["doc_id"].dataType.simpleString())
    return stored.select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_columns(found: DataFrame) -> DataFrame:
    return found.select("doc.doc_id", "n_lines", "n_dropped", "text", "classes")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_columns(lines.dedup_lines(table(spark, sf_dir, "documents")))


def op5_columns(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id",
                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_columns(vectors.near_vectors(table(spark, sf_dir, "embeddings")))


def op6_columns(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_columns(minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, model).select("doc.doc_id", "q.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return planned.select("doc.doc_id", "size", "source_size", "target",
                          (F.col("size") * F.col("copies")).alias("taken"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.pseudonymize(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    kinds = ("email", "phone", "ip", "card", "ssn", "name")
    return found.select("doc.doc_id", "text", *(F.coalesce(F.try_element_at("n", F.lit(k)), F.lit(0)).alias(f"n_{k}") for k in kinds))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_repeated_words(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: every tenth text, by the checksum of its id, repeats a stretch of its words from some word on.
    A null id has no checksum and leaves the text as it is."""
    rows = docs.select("doc_id", text_of("text").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    g = F.floor(F.col("h") / 10)
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0))
    rows = rows.select("doc_id", "text", g.alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    a = (F.col("g") % F.col("n")).cast("int")
    rows = rows.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("left", F.col("n") - F.col("a"))
    rows = rows.withColumn("p", (1 + F.floor(F.col("left") / (3 + F.col("g") % 8))).cast("int"))
    stretch = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(stretch, F.ceil(F.col("left") / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("left"))), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op12_columns(found: DataFrame) -> DataFrame:
    top = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"),
                   lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    rows = found.select("*", top.alias("top"))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return rows.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_columns(repeats.periodic_runs(op12_repeated_words(table(spark, sf_dir, "documents"))))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {"op12_periodic_runs": op12_periodic_runs, "op13_main_text": op13_main_text, "op11_whitening": op11_whitening, "op4_line_dedup": op4_line_dedup, "op10_surrogates": op10_surrogates, "op5_near_vectors": op5_near_vectors, "op6_near_duplicates": op6_near_duplicates, "op1_secret_scan": op1_secret_scan, "op7_quality_rules": op7_quality_rules, "op8_mix_sources": op8_mix_sources, "op3_token_files": op3_token_files, "op2_byte_bpe": op2_byte_bpe, "op9_token_counts": op9_token_counts}
SQL: dict[str, str] = {"op8_mix_sources": sql.OP8}
