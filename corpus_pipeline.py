"""From raw documents to packed token ids: language ID, n-gram Jaccard join, benchmark decontamination,
mixing to target weights, token output. Every stage but the last returns the columns of its input.

Nulls, empty and long texts, repeated rows, empty tables and other columns are handled as the operators say;
documents with a null doc_id pass the near-duplicate stage, as they have no name to be kept by. doc_ids are whole numbers.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodsight.llm.bit_pack import token_digests
from floodsight.llm.decontaminate import clean_documents
from floodsight.llm.frames import broadcast_checked
from floodsight.llm.language import known_language, learn
from floodsight.llm.mixing import mix
from floodsight.llm.ngram_join import text_components
from floodsight.session import settle


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Null, empty and letterless texts go."""
    return known_language(docs, learn(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that with the smallest doc_id. Of
    texts in one group that share this doc_id, that with the smallest hash stays, and of rows equal in doc_id and text one,
    any of them."""
    found = settle(text_components(docs, size=5, percent=80).where("doc_id IS NOT NULL"), "components")
    grouped = found.where("component IS NOT NULL AND doc_id = component_id").groupBy("component", "doc_id")
    kept = grouped.agg(F.min("text_key").alias("text_key")).select("doc_id", "text_key")
    kept = kept.union(found.where("component IS NULL").select("doc_id", "text_key")).distinct()
    kept = settle(kept.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")), "kept")
    own = docs.select(F.struct("*").alias("doc")).withColumns({"own_id": F.col("doc.doc_id").cast("long"), "own_key": F.xxhash64(F.col("doc.text").cast("string"))})
    same = (F.col("own_id") == F.col("kept_id")) & (F.col("own_key") == F.col("kept_key"))
    out = own.join(broadcast_checked(kept), same, "left_semi")
    if found.groupBy("doc_id", "text_key").count().where("count > 1").take(1):
        out = out.dropDuplicates(["own_id", "own_key"])
    return out.select("doc.*").union(docs.where(F.col("doc_id").cast("long").isNull()))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by the weights of domains and languages, each document once at most. Texts without words cost
    nothing; rows equal in doc_id and text stay or go together."""
    return mix(docs, F.expr("all_tokens * 4 div 5"), epochs=1).select("doc.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, written in blocks and read back: a digest of each row, those with a null or repeated doc_id too."""
    return token_digests(docs)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]
ORACLE_SQL = None  # language models, tokens and tiles have no SQL form; tests/llm holds them against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
