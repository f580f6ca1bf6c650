"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing and packing, in this order.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents; further columns of docs are not read. Ids
may be null or repeat: rows are what the stages decide on. Without documents every stage returns no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import arrow_map, discard, scratch_scope, stored
from corvid.llm.jaccard_join import jaccard_join
from corvid.llm.line_dedup import kept_texts, line_dedup, with_bitmaps
from corvid.llm.mixing import mix_sources
from corvid.llm.packing import pack
from corvid.llm.quality_rules import POLICIES, quality_rules

TOKENIZER = "word_bpe_49k.json"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """The columns of docs and _row, a stored number that no two rows share, whatever their doc_id."""
    return stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go: null and empty texts have too few words, repeated rows are judged each.

    The verdict is part of the row, so nothing is joined.
    """
    verdict = quality_rules(docs.select(F.struct(*COLUMNS).alias("doc_id"), "text"), POLICIES["v1"])
    return verdict.where("kept").select("doc_id.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the one of the largest doc_id, null counting as one below all; n_chars follows the text.

    Every row stays, also one that loses all its lines; a null text stays null with its n_chars. Rows that repeat
    an id and text lose the same lines.
    """
    marked = with_bitmaps(docs.select(*COLUMNS), line_dedup(docs)).select("doc_id", "text", "keep_bitmap", "lang", "source", "n_chars")
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ["doc_id", "text", "lang", "source", "n_chars"])
    kept = arrow_map(marked, kept_texts, fields)
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", length).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, null last; of rows that repeat it, one.

    Texts without words, null ones too, link with nothing, so all of them stay.
    """
    keyed = _keyed(docs, "pipeline-linked")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    with scratch_scope(spark):
        labels = jaccard_join(keyed, id_col="_row")["components"].select(F.col("doc_id").alias("_row"), "component_id")
        kept = keyed.select("doc_id", "_row").join(labels, "_row").groupBy("component_id").agg(least.alias("least")).select("least._row")
        kept = stored(kept, "pipeline-kept", outlives=True)
    # The same join at every size: small lists of rows would be broadcast, large ones can't be.
    return keyed.join(kept.hint("merge"), "_row", "left_semi").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it, 0 to 3; documents without words are taken 0 times.

    A null source is a source of its own. Rows that repeat an id are taken each by its own number of copies.
    """
    keyed = _keyed(docs, "pipeline-mixed")
    with scratch_scope(spark):
        copies = stored(mix_sources(keyed, extra=("_row",)).where("copies > 0").select("_row", "copies"), "pipeline-copies", outlives=True)
    taken = keyed.join(copies.hint("merge"), "_row")
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 4096 tokens; repeated documents are packed each time, null texts as empty ones."""
    return pack(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("mix_sources", mixing_stage),
    ("pack", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's own tables are deleted when its result is written, and that when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark):
            after = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", outlives=True)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)


#: Mixing and packing solve for rates and places, which SQL can't express; tests/llm checks the stages against brute force.
ORACLE_SQL = None
