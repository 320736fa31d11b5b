"""The thin registered queries ``opN_<name>`` over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton_dedup, byte_bpe, edit_lines, gray_simhash, histogram_shards, kd_topk, prefix_tokens, repair_search, secret_ledger, suffix_decontam, suffix_doubling, target_resampling, weak_quality


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prefix_tokens.prefix_token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), budget=4096)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "fits_chars")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.scan_secrets(table(spark, sf_dir, "documents"))
    named = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(named, 256).alias("base_sha256"), named.alias("spans"))


def op3_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weak_quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("p_quality", 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"), "keep")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_decontam.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id", "n_words", suffix_decontam.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), suffix_decontam.is_contaminated().alias("contaminated")
    )


def op5_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_topk.top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), k=10)


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.length(text) + 1).cast("long").alias("bytes"), F.crc32(text).alias("text_crc32"))
    key = histogram_shards.hashed_key(F.col("doc_id"), F.col("text_crc32"))
    sharded = histogram_shards.shards_by_bytes(rows, key, F.col("bytes"), n_shards=16, tie_cols=("doc_id", "text_crc32"), spread=True)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gray_simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, most=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = automaton_dedup.repeated_passages(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edit_lines.deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_doubling.repeated_bytes(table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations``, some dropped, emptied, without sentence ends, repeated or in the role of the user, by a CRC of conversation and turn."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.expr("sequence(1, if(code = 3, 2, 1))")).alias("copy")).drop("copy")


def repaired(conversations: DataFrame) -> DataFrame:
    """A row for each conversation of the table: what is wrong with its damaged rows, and the repair."""
    summary, rows = repair_search.repair(damaged(conversations))
    ids = conversations.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id")
    keyed = lambda df, name: df.select(F.col("conv_id").alias(name), *[c for c in df.columns if c != "conv_id"])
    out = ids.join(keyed(summary, "s_"), F.col("conv_id").eqNullSafe(F.col("s_")) & F.col("audit").isNotNull(), "left")
    out = out.join(keyed(repair_search.digests(rows), "d_"), F.col("conv_id").eqNullSafe(F.col("d_")) & F.col("repaired_sha256").isNotNull(), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_secret_scan": op2_secret_scan,
    "op3_weak_quality": op3_weak_quality,
    "op4_decontamination": op4_decontamination,
    "op5_kd_topk": op5_kd_topk,
    "op6_histogram_shards": op6_histogram_shards,
    "op7_gray_simhash": op7_gray_simhash,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_line_dedup": op10_line_dedup,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_target_resampling": op13_target_resampling,
}

#: The buckets of words in SQL: CRC-32 by a table of bytes made of the polynomial.
RESAMPLING = r"""WITH tbl AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
w AS (SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark)),
v AS (SELECT word, xor(list_reduce([4294967295] || list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), tbl),
n AS (SELECT side, id, bucket, count(*) AS n FROM w JOIN v USING (word) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM n GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + 10000) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000))))::BIGINT AS gain FROM b),
d AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM n JOIN g USING (bucket) WHERE side = 's' GROUP BY 1),
x AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u FROM documents LEFT JOIN d ON d.id = doc_id),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FILTER (n_features >= 20) * 10 // 100 FROM y) THEN place END AS rank FROM r"""

ORACLE_SQL: dict[str, str] = {"op13_target_resampling": RESAMPLING}
