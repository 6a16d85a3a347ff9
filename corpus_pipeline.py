"""The corpus pipeline: toxicity, near-dedup, decontamination, surrogates, byte-level BPE, a stage each.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents. Rows with a null id pass the near-dedup and
decontamination stages, as nothing links or finds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import discard, left_out, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learnt from the labels of documents that are still there, doesn't reject."""
    from quire.llm.toxicity import learn_from, score_documents

    model = learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "text"), model).where("predicted = 0").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id."""
    from quire.llm.near_dedup import near_duplicates

    return left_out(docs, near_duplicates(docs).where("not kept").select("doc_id"), "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    from quire.llm.decontamination import contained

    gone = contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return left_out(docs, written(gone, "contained"), "doc_id")


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars is that of the new text."""
    from quire.llm.privacy import pseudonymise
    from quire.llm.queries import SURROGATE_KEY

    out = pseudonymise(docs, SURROGATE_KEY, n_entities="_n")
    return out.withColumn("n_chars", F.when(F.col("_n") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts' tokens, and whether they decode to the text again."""
    import public_tokenizers

    from quire.llm.bpe import encode_documents

    out = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return out.select("doc_id", "lang", "source", "n_chars", "text", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("surrogates", surrogates), ("byte_bpe", byte_bpe)]

#: No SQL: lexicon learning, exact near-duplicate components and keyed surrogates aren't expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        after = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        docs = before = after
    return docs
