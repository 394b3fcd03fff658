"""Registered queries of the operators: whole tables in, contract columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import oracle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripweave.llm.decontamination import contained_items

    documents, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    found = contained_items(documents, items)
    return found.withColumn("containment", F.round("containment", 6))


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripweave.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), 8)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripweave.llm.substring_dedup import remove_repeated

    return remove_repeated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripweave.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripweave.llm.language_id import held_out
    from tripweave.llm.maxent_lm import score_corpus

    kept_back = held_out(parts=10)
    found = score_corpus(table(spark, sf_dir, "documents"), kept_back)
    return found.withColumn("held_out", kept_back)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripweave.llm.language_id import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripweave.llm.chat import format_chats, learned_text, parsed

    log = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("seq"),
        "role",
        "text",
    )
    marked = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("seq"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    events = log.unionByName(marked).withColumns(
        {"kind": F.lit("message"), "message_id": F.lit(None).cast("string")}
    )
    read = format_chats(events).withColumn("turns", parsed(F.col("formatted")))
    learned = learned_text(F.col("formatted"), F.col("loss_spans"))
    told = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        learned.alias("learned"),
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripweave.llm.url_filter import judge_urls

    rules = (
        ("block", "net", "/"),
        ("allow", "example.net", "/en/"),
        ("block", "example.com", "/de/"),
        ("allow", "org", "/fr/"),
    )
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripweave.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tripweave.llm.bpe import encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    return encode(table(spark, sf_dir, "documents"), path).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tripweave.llm.token_counts import count_prefixes

    path, limit = public_tokenizers.path("byte_bpe_50k.json"), 512
    found = count_prefixes(table(spark, sf_dir, "documents"), path, budgets=(limit,))
    return found.select(
        "doc_id",
        "n_bytes",
        F.coalesce(F.try_element_at("prefix_counts", F.lit(-1)), F.lit(0)).cast("long").alias("n_tokens"),
        (F.col("n_tokens") > limit).alias("over_limit"),
        F.get("cut_chars", F.lit(0)).alias("chars_within_limit"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripweave.llm.importance import resample

    documents, target = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return resample(documents, target).select("doc_id", "n_features", "weight", "score", "rank")


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tripweave.llm.alignment import align_texts, link_counts
    from tripweave.llm.common import stored

    names = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    aligned = align_texts(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, names))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = stored(aligned.withColumn("groups_sha256", digest).drop("groups"), "alignments")
    return link_counts(aligned, keep=("groups_sha256",))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_benchmark_decontamination,
    op2_jump_sharding,
    op3_substring_dedup,
    op4_simhash_near_dedup,
    op5_lm_scoring,
    op6_language_id,
    op7_chat_formatting,
    op8_url_filters,
    op9_exact_dedup,
    op10_bpe,
    op11_token_counts,
    op12_importance_resampling,
    op13_cross_tokenizer_alignment,
    pipeline,
)


def queries() -> dict:
    return {query.__name__: query for query in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
