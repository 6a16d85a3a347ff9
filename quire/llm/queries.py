"""The queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Key of the surrogates in the registered queries; deployments pass a secret of their own.
SURROGATE_KEY = b"registered queries"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.bpe import encode_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.language import held_out, identify, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import held_out, learn_from, score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_from(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.unigram import count_tokens

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "score")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.decontamination import contained

    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.passages import shared_passages

    return shared_passages(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.privacy import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY).select("doc_id", "n_entities", "text")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_near_dedup": op2_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_passages": op4_passages,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_surrogates": op7_surrogates,
    "op8_language": op8_language,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": """
with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') as w from documents where doc_id is not null and text is not null),
i as (select item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') as w from benchmark where item_id is not null and text is not null),
i5 as (select distinct item_id, least(len(w), 5) as n, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda k: array_to_string(w[k:k + least(len(w), 5) - 1], ' '))) as s from i where len(w) > 0),
sizes as (select item_id, n, count(*) as size from i5 group by all),
d5 as (select distinct doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) as s from d, (select distinct n from sizes) where len(w) >= n),
hits as (select doc_id, item_id, count(*) as shared from d5 join i5 using (n, s) group by all)
select doc_id, item_id, shared, shared / size as containment from hits join sizes using (item_id) where shared >= size * 0.75 - 1e-9
""",
}


def queries() -> dict:
    return dict(QUERIES) | {"pipeline": lambda spark, sf_dir: importlib.import_module("corpus_pipeline").run(spark, sf_dir)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
