"""The registered queries of the operators: each on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from liengrid.llm import (
    bpe_automaton,
    language_id,
    line_dedup,
    minhash,
    mixing_model,
    packing,
    prefix_trie,
    secret_scan,
    shallot,
    token_counts,
    toxicity,
    vector_search,
    winnowing,
)

TOKENIZER_FOLDER = "/opt/tokenizers"


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed package, or of TOKENIZER_FOLDER."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{TOKENIZER_FOLDER}/{name}"
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(divisor: int) -> str:
    """Whether a document is held out: crc32 of its id as text leaves 2; not for a null id."""
    return f"coalesce(crc32(cast(doc_id as string)) % {divisor} = 2, false) as held_out"


def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "lang", _remainder(4))
    model = language_id.fit(documents.where("not held_out"))
    return language_id.identify(documents.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def toxic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").selectExpr("doc_id", "text", _remainder(4))
    model = toxicity.fit(documents.where("not held_out"), _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(documents, model).select("doc_id", "held_out", "score", "predicted")


def fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(documents)


def token_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    made = bpe_automaton.encode_documents(documents, tokenizer_file("word_bpe_49k.json"), digests=True)
    return made.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").selectExpr("doc_id", "text", _remainder(7))
    return mixing_model.score_documents(documents)


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.cluster(_table(spark, sf_dir, "embeddings"))


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_neighbours": vector_neighbours,
    "op2_near_duplicates": near_duplicates,
    "op3_language": language,
    "op4_toxicity": toxic_texts,
    "op5_fuzzy_lines": fuzzy_lines,
    "op6_token_counts": token_numbers,
    "op7_benchmark_hits": benchmark_hits,
    "op8_secrets": secrets,
    "op9_bpe_automaton": encoded,
    "op10_model_scores": model_scores,
    "op11_centroid_clusters": centroid_clusters,
    "op12_packed_sequences": packed_sequences,
    "op13_prefix_trie": conversation_trie,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
