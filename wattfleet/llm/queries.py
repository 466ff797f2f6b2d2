"""One query for each operator over its whole table; ORACLES holds the SQL of those that have one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfleet.llm import (
    chat, decontaminate, impact_search, infill, licenses, lines, packing, pii, quality, repair, simhash, sql, substrings, token_files,
)
from wattfleet.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_distance=3)
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A conversation of control strings beside those of the table.
    marks = spark.sql(
        "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(marks)
    read = chat.format_chats(rows).select(
        "conv_id", "formatted", chat.turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = token_files.write_tokens(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    read = token_files.read_tokens(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(_table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *[F.col(f"stats.{c}") for c in counts], "base_failed", "kept", "probability")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))

    def listed(column: str, kind: str) -> Column:
        return F.transform(column, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    base = F.concat(*[listed(kind, kind) for kind in pii.KINDS])

    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, listed("found", pii.FOUND)), ",").alias("spans"),
    )


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), 2)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated or given another role by the checksum of their place."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    marked = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(place) % 20).alias("code"))
    return marked.where("code <> 0").select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, pieces = repair.repair(damaged(conversations))

    def copies(n: Column, *faults: str | None) -> Column:
        of = F.coalesce("fault", F.lit("")).isin([f or "" for f in faults])
        return F.sum(F.when(of, n).otherwise(F.lit(0).cast("long")))

    n = F.col("copies")
    counts = found.groupBy("conversation").agg(
        repair.gaps("turn").alias("gaps"), copies(n, "blank").alias("blank"),
        (copies(n, "duplicate") + copies(n - 1, None, "truncated")).alias("duplicate"), copies(F.lit(1).cast("long"), "truncated").alias("truncated"),
    )
    told = F.transform(F.sort_array(F.collect_list(F.struct("part", "no", "audit"))), lambda x: x["audit"])
    edits = pieces.groupBy("conversation").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(told, "").alias("audit"))
    hashes = repair.digests(repair.repaired(found, pieces)).select("conversation", F.col("sha256").alias("repaired_sha256"))
    parts = conversations.select(F.col("conv_id").alias("conversation")).distinct()
    for part in (counts, edits, hashes):
        parts = parts.unionByName(part, allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return parts.groupBy(F.col("conversation").alias("conv_id")).agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(_table(spark, sf_dir, "documents"), unit="token", seed="1", plain_percent=10, spm_percent=20)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.when(impact_search.usable(F.col("embedding")), whole).alias("vector"))
    index = impact_search.build_index(vectors, "vec_id", "vector")
    found = impact_search.search(index, vectors.where(F.col("vec_id") % 50 == 0), 5, "vec_id", "vector")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_lines": op2_lines,
    "op3_chat": op3_chat,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_files": op5_token_files,
    "op6_quality": op6_quality,
    "op7_licenses": op7_licenses,
    "op8_personal_data": op8_personal_data,
    "op9_packing": op9_packing,
    "op10_substrings": op10_substrings,
    "op11_repair": op11_repair,
    "op12_infill": op12_infill,
    "op13_top_k": op13_top_k,
}

ORACLES: dict[str, str] = {
    "op3_chat": sql.OP3,
    "op4_decontaminate": sql.OP4,
    "op11_repair": sql.OP11,
    "op12_infill": sql.OP12,
    "op13_top_k": sql.OP13,
}
