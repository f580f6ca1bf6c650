"""Quality rules: every rule is evaluated once into a ledger of failure bits and measurements; policies are masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (bit, name, condition of failure over the measurements), in the order of the bits.
RULES = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "10 * n_symbols > n_words"),
    (3, "duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    (4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    (5, "digits", "2 * n_digits > word_chars"),
    (6, "bullet_lines", "n_lines >= 4 and 10 * n_bullet_lines > 9 * n_lines"),
    (7, "ellipsis_lines", "n_lines >= 4 and 10 * n_ellipsis_lines > 3 * n_lines"),
)
BASE_MASK = 0b00011


@dataclass(frozen=True)
class Policy:
    """A version and the bits of the rules that reject a document under it."""

    version: str
    mask: int


POLICIES = {"base": Policy("base", BASE_MASK), "v1": Policy("v1", 0b11111), "v2": Policy("v2", 0b11111111)}


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    d = d.select(
        "doc_id",
        "_text",
        F.expr(r"array_remove(split(_text, '[\\x20\\x09-\\x0D]+'), '')").alias("_words"),
        F.expr(r"filter(split(_text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("_lines"),
    )
    d = d.select(
        "doc_id",
        F.expr("size(_words)").cast("long").alias("n_words"),
        F.expr(r"length(_text) - regexp_count(_text, '[\\x20\\x09-\\x0D]')").cast("long").alias("word_chars"),
        F.expr(r"regexp_count(_text, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.expr("size(_lines)").cast("long").alias("n_lines"),
        F.expr("size(_lines) - size(array_distinct(_lines))").cast("long").alias("n_dup_lines"),
        F.expr(r"regexp_count(_text, '[0-9]')").cast("long").alias("n_digits"),
        F.expr(r"size(filter(_lines, x -> x rlike '^[\\x20\\x09-\\x0D]*[-*•‣◦]'))").cast("long").alias("n_bullet_lines"),
        F.expr(r"size(filter(_lines, x -> x rlike '([.]{3}|…)[\\x20\\x09-\\x0D]*$'))").cast("long").alias("n_ellipsis_lines"),
        F.expr("if(size(_words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(_words) - 3), i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))))").alias("_windows"),
    )
    # Windows that occur twice are neighbours once sorted; their starts, sorted again, give the words they cover.
    covered = """
        transform(array(array_sort(transform(_windows, (h, i) -> struct(h, i)))), s ->
          transform(array(array_sort(transform(
              filter(s, (x, i) -> coalesce(x.h = get(s, i - 1).h, false) or coalesce(x.h = get(s, i + 1).h, false)), x -> x.i))), p ->
            aggregate(transform(p, (a, i) -> least(3, coalesce(get(p, i + 1) - a, 3))), 0L, (a, b) -> a + b))[0])[0]
    """
    repeats = F.expr(f"if(size(array_distinct(_windows)) = size(_windows), 0L, {covered})")
    return d.withColumn("n_repeat_words", repeats).drop("_windows")


def quality_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of every row and rule_bits, in which bit b says that rule b fails.

    A null or empty text has no words and fails few_words. Repeated rows are measured each; a null id stays
    null. Only the two named columns are read. The whole plan is one scan without a shuffle: n log n in the
    words of a text, also for very long ones, and linear memory.
    """
    m = _measured(docs, id_col, text_col)
    bits = " | ".join(f"(cast({cond} as int) << {bit})" for bit, _, cond in RULES)
    # A filter on the ledger would otherwise be pushed below it with all its expressions in place of their columns,
    # and they would run once for each use. Nothing moves through a generator's own columns.
    return m.select(F.inline(F.array(F.struct(*m.columns, F.expr(bits).alias("rule_bits")))))


def stored_ledger(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ledger to path, a folder that all executors share, unless one is there; policies and ablations read it from there.

    Texts are measured once, however many policies follow.
    """
    spark = docs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        quality_ledger(docs, id_col, text_col).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """base_failed, the verdict kept, and the policy's version, from the stored bits alone.

    Every row of the ledger gets its verdict, repeated ones and those of null ids too; null bits give null verdicts. An empty
    ledger gives an empty result.
    """
    failed = F.col("rule_bits").bitwiseAND(F.lit(policy.mask | BASE_MASK)) != 0
    base = F.col("rule_bits").bitwiseAND(F.lit(BASE_MASK)) != 0
    return ledger.withColumns({"base_failed": base, "kept": ~failed, "policy_version": F.lit(policy.version)})


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule: documents that fail it, and those that would be kept without it under the policy.

    The ledger collapses to at most 2**len(RULES) distinct bit sets before anything else happens. Repeated rows count
    each; rows with null bits count in neither column; an empty ledger gives an empty result.
    """
    sets = ledger.groupBy("rule_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(name).alias("rule")) for b, name, _ in RULES]))
    mask = policy.mask | BASE_MASK
    fails = F.expr("(rule_bits & (1 << r.bit)) != 0")
    only = F.expr(f"(rule_bits & {mask}) = ({mask} & (1 << r.bit)) and (rule_bits & (1 << r.bit) & {mask}) != 0")
    return sets.withColumn("r", rules).groupBy("r.bit", "r.rule").agg(F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_kept_without"))


def quality_rules(docs: DataFrame, policy: Policy = POLICIES["v1"], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger of all rows with a policy's verdict: base_failed, kept and policy_version beside the measurements.

    Null and empty texts fail few_words; repeated rows are judged each; a null id stays null; an empty table gives an
    empty result. Only the two named columns are read.
    """
    return apply_policy(quality_ledger(docs, id_col, text_col), policy)
