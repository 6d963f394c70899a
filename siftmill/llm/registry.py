"""The queries of this subpackage, with the parameters they have in production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, dedup, divergence, lexical, media, packing, pii, sharding, simhash, similarity, token_files, toxicity, urlfilter
from . import pipeline as stages

#: (verdict, host/path)
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_pii(spark, sf_dir):
    return pii.found_in(_table(spark, sf_dir, "documents"))


def op3_sharding(spark, sf_dir):
    return sharding.interleaved(_table(spark, sf_dir, "documents"), shards=8)


def op4_token_files(spark, sf_dir):
    return token_files.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op5_packing(spark, sf_dir):
    return packing.packed_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, limit=2048)


def op6_url_filters(spark, sf_dir):
    return urlfilter.judged(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_byte_bpe(spark, sf_dir):
    return bpe.codec_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_media(spark, sf_dir):
    return media.media_features(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return similarity.similarity_classes(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_simhash(spark, sf_dir):
    return simhash.fingerprint_classes(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark, sf_dir):
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op13_source_divergence(spark, sf_dir):
    return divergence.audited(_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return stages.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_pii, op3_sharding, op4_token_files, op5_packing, op6_url_filters, op7_byte_bpe, op8_media, op9_jaccard_join, op10_exact_dedup, op11_simhash, op12_ranked_search, op13_source_divergence, pipeline)
}
ORACLE_SQL: dict[str, str] = {"op6_url_filters": urlfilter.ORACLE_SQL, "op10_exact_dedup": dedup.ORACLE_SQL, "op12_ranked_search": lexical.ORACLE_SQL, "op13_source_divergence": divergence.ORACLE_SQL}
