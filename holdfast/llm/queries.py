"""Named queries of the training-data operators, with production parameters, and their SQL where SQL has one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from holdfast.llm import byte_bpe, exact_radix, html_wrappers, minhash, packing, periodic_runs, records, rp_forest, suffixes, token_counts, topk, toxicity, whitening
from holdfast.sources.tables import read_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), percent=85)


def op2_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    left = suffixes.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep_text=False), ranks))


def op4_records(spark: SparkSession, folder: str) -> DataFrame:
    found = records.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.count_tokens(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


def op8_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_wrappers.extract(table(spark, folder, "pages"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_rp_forest(spark: SparkSession, folder: str) -> DataFrame:
    return rp_forest.nearest(table(spark, folder, "embeddings"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    rows = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if model else F.array().cast("array<double>")
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of one document in ten, by the crc32 of its id, end in copies of some of their words.

    Of n words those from a = g % n on repeat the first p = 1 + floor((n - a) / (3 + g % 8)) of them, g being the crc32 without its last digit.
    """
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    planted = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, folder, "documents")))
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_exact(spark: SparkSession, folder: str) -> DataFrame:
    text = exact_radix.normalised(F.col("text"))
    return exact_radix.exact_duplicates(table(spark, folder, "documents"), text, also={"text_sha256": F.sha2(text, 256)})


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash, op2_suffixes, op3_byte_bpe, op4_records, op5_token_counts, op6_toxicity, op7_topk, op8_html, op9_packing, op10_rp_forest,
        op11_whitening, op12_runs, op13_exact,
    )
}

#: Integer scores of every query with every other row.
TOPK = """
WITH rows AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: Documents equal but for the case of A-Z.
EXACT = """
WITH texts AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), classes AS (
    SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM texts JOIN classes USING (t)
"""

ORACLES: dict[str, str] = {"op7_topk": TOPK, "op13_exact": EXACT}
