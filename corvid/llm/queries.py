"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, scratch_root
from .collocations import collocations
from .concat_packing import concat_pack
from .exact_dedup import exact_dedup
from .html_text import extract_pages
from .jaccard_join import jaccard_join
from .language_id import fit_languages, held_out, identify_languages
from .line_dedup import line_dedup, line_digests, with_bitmaps
from .merkle import merkle_proofs
from .mixing import mix_sources
from .packing import pack
from .quality_rules import quality_rules
from .sharding import ShardStore
from .tokens import token_counts

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
#: Parts in which the documents of op5 arrive.
ARRIVALS = 4


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"), keep="max")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_read(spark, sf_dir, "documents"))["components"]


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "off_target")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_read(spark, sf_dir, "pages"))


def op5_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ARRIVALS parts as small shards, tiers are compacted after each, the rest at the end; the newest manifest is read back."""
    store = ShardStore(spark, f"{scratch_root(spark)}/shards-{uuid.uuid4().hex}", target=128 << 20)
    docs = _read(spark, sf_dir, "documents")
    for i in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == i))
        store.compact()
        store.vacuum(grace=0)  # nobody else reads this store
    version = store.compact(final=True)
    store.vacuum(grace=0)
    shards = store.shards()
    if not shards:
        return _read(spark, sf_dir, "documents").selectExpr("doc_id", "0L as n_bytes", "0 as shard_id", "0L as shard_rows", "0L as shard_bytes", "0 as version").limit(0)
    table = spark.createDataFrame([(s.path, i, s.rows, s.size, version) for i, s in enumerate(shards)], "shard string, shard_id int, shard_rows long, shard_bytes long, version int")
    rows = store.read().select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "shard")
    return rows.join(table, "shard").select("doc_id", "n_bytes", "shard_id", "shard_rows", "shard_bytes", "version")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), TOKENIZER)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), TOKENIZER)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_bits"]
    return quality_rules(_read(spark, sf_dir, "documents")).select(*cols)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return arrow_map(with_bitmaps(docs, line_dedup(docs)), line_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    filters = fit_languages(docs.where(~F.coalesce(held_out(), F.lit(False))), "text", "lang", "doc_id")
    rows = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return identify_languages(rows, filters, extra=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def op11_concat_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat_pack(_read(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_proofs(_read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_exact_dedup, op2_jaccard_join, op3_mix_sources, op4_main_text, op5_shard_compaction, op6_pack, op7_token_counts, op8_quality_rules, op9_line_dedup, op10_language_id, op11_concat_pack, op12_merkle_manifest, op13_collocations)
    return {f.__name__: f for f in every}
