"""The registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutml.llm import chunk_bpe, collocations, decontaminate, jaccard, langid, packing, quality, secrets, sharding, token_align, topk, toxicity, url_filter
from scoutml.llm.common import stored, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan(table(spark, sf, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", *[count(k) for k in secrets.KINDS],
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"),
    )


@query
def op2_harmonic_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf, "documents"))
    return packing.piece_checksums(pieces)


@query
def op3_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf, "documents"))


@query
def op4_language_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.train(docs, table(spark, sf, "labels")).score(docs)
    return scored.select(
        "doc_id", langid.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf, "pages"))


ORACLE["op6_url_filter"] = url_filter.ORACLE_SQL


@query
def op7_chunked_bpe(spark: SparkSession, sf: str) -> DataFrame:
    coded = chunk_bpe.decode_documents(chunk_bpe.encode_documents(table(spark, sf, "documents")))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_quality_mcd(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(table(spark, sf, "documents"))


@query
def op9_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


ORACLE["op9_exact_topk"] = topk.ORACLE_SQL


@query
def op10_rendezvous_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.place(table(spark, sf, "documents"), shards=24)


@query
def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    found = token_align.align_documents(table(spark, sf, "documents"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    weighed = token_align.weigh_links(stored(found.withColumn("groups_sha256", digest).drop("groups")))
    return weighed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contaminated_words(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE["op12_decontamination"] = decontaminate.ORACLE_SQL


@query
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.top_phrases(collocations.collocations(table(spark, sf, "documents")))


ORACLE["op13_collocations"] = collocations.ORACLE_SQL
