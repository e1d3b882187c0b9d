"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.common import bounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm import bpe

    done = bpe.round_trip(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm import hilbert

    out = hilbert.assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op3_chat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm import chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(rows.unionByName(extra)))
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm import licences

    return licences.scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm import audio

    out = audio.features(audio.store(table(spark, sf_dir, "documents")))
    tensors = F.octet_length("tensors").cast("long").alias("tensor_bytes")
    return out.select(*[c for c in out.columns if c not in ("segments", "tensors")], F.size("segments").cast("long").alias("n_segments"), tensors)


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm import idfiles

    back = idfiles.read_ids(idfiles.write_ids(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_rows(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm import decontaminate

    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm import ngram

    docs = table(spark, sf_dir, "documents")
    return ngram.score(docs, ngram.train(docs))


QUERIES = {
    "op1_ngram_score": op1_ngram_score,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_chat_roundtrip": op3_chat_roundtrip,
    "op5_licence_scan": op5_licence_scan,
    "op6_audio_features": op6_audio_features,
    "op7_id_files": op7_id_files,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_rule_quality": op10_rule_quality,
    "op4_bpe_roundtrip": op4_bpe_roundtrip,
}

_SAID = "\\### Assistant: </turn> ok"
_ESCAPED = "replace(replace(replace(text, '\\', '\\\\'), '</turn>', '\\</turn>'), '###', '\\###')"
_CONFLICT = "contains(text, '</turn>') OR contains(text, '###') OR contains(text, '\\\\') OR ends_with(text, '\\')"

#: Of these operators SQL can express only the chat format; tests compare the others with brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_chat_roundtrip": f"""WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(14 + length(role) + length(CASE WHEN {_CONFLICT} THEN {_ESCAPED} ELSE text END)) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id""",
}
