"""Queries on conversation structure, whitened embeddings and packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulegrain.llm import conversation_repair, packing, whitening
from rulegrain.llm.registry import query
from rulegrain.llm.storage import read_table


@query("op11_conversation_repair")
def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    whole = turns.select("conv_id").distinct()
    fixed = conversation_repair.repair(conversation_repair.damaged(turns))
    return conversation_repair.with_unrepaired(whole, fixed)


@query("op12_embedding_whitening")
def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op13_packing")
def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
