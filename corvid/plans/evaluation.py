"""Evaluation plans: paraphrase jobs, turn jobs, and the scores of a regression head in long form."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bound, faithful, prf
from ..operators.curves import best_of, threshold_curves
from ..operators.conversations import assistant_turns
from ..operators.ranking import per_group_cap
from ..sources.scratch import shared_folder

# The threshold grid of the regression scores and the least gold activation that counts.
SMALL_THRESHOLDS = (1e-4, 5e-4, 1e-3, 2e-3, 5e-3, 7.5e-3)
GOLD_EPS = 1e-4


def threshold_grid(small: Sequence[float] = SMALL_THRESHOLDS) -> list[float]:
    return [*small, *[round(0.01 * i, 2) for i in range(1, 20)], *[round(0.20 + 0.05 * i, 2) for i in range(13)]]


# Paraphrases


def paraphrase_jobs(records: DataFrame, styles: Sequence[str], variants: int) -> DataFrame:
    """One job for each record, answered question and variant, with the style that the variant takes."""
    turns = records.select("file", "line", F.expr("filter(sequence(1, size(conversations) - 1), i -> get(conversations, i).from = 'gpt' and get(conversations, i - 1).from = 'human')").alias("at"), "conversations")
    jobs = turns.where("size(at) > 0").select("file", "line", F.explode("at").alias("turn"), "conversations").select("file", "line", "turn", F.expr("get(conversations, turn - 1).value").alias("q"), F.expr("get(conversations, turn).value").alias("a"))
    style = F.element_at(F.array(*map(F.lit, styles)), (F.col("variant") % len(styles)).cast("int") + 1)
    return jobs.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1)))).withColumn("style", style)


def parse_output(text: Column) -> Column:
    """struct(q, a) of an output: tagged <Q>/<A> parts, else its first line that is a JSON object with both; else null."""
    tagged = r"(?s)<Q>(.*?)</Q>\s*<A>(.*?)</A>"
    q, a = F.trim(F.regexp_extract(text, tagged, 1)), F.trim(F.regexp_extract(text, tagged, 2))
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^[\s`]+|[\s`]+$", ""))
    objects = F.transform(F.filter(lines, lambda x: x.startswith("{") & x.endswith("}")), lambda x: F.struct(F.trim(F.get_json_object(x, "$.q")).alias("q"), F.trim(F.get_json_object(x, "$.a")).alias("a")))
    first = F.get(F.filter(objects, lambda o: o["q"].isNotNull() & o["a"].isNotNull()), 0)
    return F.when(text.rlike(tagged), F.struct(q.alias("q"), a.alias("a"))).otherwise(first)


def accepted(jobs: DataFrame, outputs: DataFrame, names: dict[str, str], surfaces: dict[str, str]) -> DataFrame:
    """Jobs with their final texts: a faithful output, or the original where there is none; faithful says which.

    Both the answer and the question of an output have to keep the numbers, names and concepts of the original.

    outputs: file, line, turn, variant, attempt, text. Of several faithful attempts the first one counts; jobs
    without one are those that a further attempt should take.
    """
    out = _judged(jobs, outputs.withColumn("o", parse_output(F.col("text"))), names, surfaces)
    return out.select(*_JOB, "q", "a", "faithful")


_JOB = ["file", "line", "turn", "variant"]


def _judged(jobs: DataFrame, parsed: DataFrame, names: dict[str, str], surfaces: dict[str, str]) -> DataFrame:
    """jobs with the first faithful one of their parsed outputs (key, attempt, o) in place of q and a, and faithful."""
    o = jobs.select(*_JOB, "q", "a").join(parsed.where("o is not null").select(*_JOB, "attempt", "o"), _JOB)
    good = o.where(bound([F.col("o"), F.col("q"), F.col("a")], lambda o, q, a: faithful(a, o["a"], names, surfaces) & faithful(q, o["q"], names, surfaces)))
    best = good.groupBy(*_JOB).agg(F.min_by("o", "attempt").alias("o"))
    return jobs.join(best, _JOB, "left").withColumns({"q": F.coalesce("o.q", "q"), "a": F.coalesce("o.a", "a"), "faithful": F.col("o").isNotNull()}).drop("o")


def rewritten(jobs: DataFrame, generate: Callable[[DataFrame], DataFrame], names: dict[str, str], surfaces: dict[str, str], retries: int = 2) -> DataFrame:
    """Jobs with their final texts after up to 1 + retries rounds; each round takes the jobs that have no faithful output yet.

    generate gets file, line, turn, variant, q, a, style, attempt, temperature and seed, and returns the key and text.
    Temperatures rise from 0.7 by 0.15 a round, and seeds differ by job and round but not between runs. A
    round's outputs are written to the shared folder, so a generator runs once for each job and round, and so are its
    verdicts: each output is judged once, in its own round.
    """
    spark, out = jobs.sparkSession, None
    for attempt in range(retries + 1):
        asked = jobs.withColumns({"attempt": F.lit(attempt), "temperature": F.lit(round(0.7 + 0.15 * attempt, 2)), "seed": F.pmod(F.xxhash64(F.lit(attempt), *_JOB), F.lit(1 << 31))})
        path = shared_folder(spark, f"outputs-{attempt}")
        generate(asked).select(*_JOB, parse_output(F.col("text")).alias("o")).write.parquet(path)
        got = spark.read.parquet(path).withColumn("attempt", F.lit(attempt))
        path = shared_folder(spark, f"judged-{attempt}")
        _judged(jobs, got, names, surfaces).write.parquet(path)
        judged = spark.read.parquet(path)
        done, jobs = judged.where("faithful"), judged.where("not faithful").drop("faithful")
        out = done.select(*_JOB, "q", "a", "faithful") if out is None else out.unionByName(done.select(*_JOB, "q", "a", "faithful"))
        if attempt == retries or jobs.isEmpty():
            break
    return out.unionByName(jobs.select(*_JOB, "q", "a", F.lit(False).alias("faithful")))


def regrouped(turns: DataFrame) -> DataFrame:
    """Turns by record and variant, in order, and whether all of them are faithful."""
    g = turns.groupBy("file", "line", "variant").agg(F.array_sort(F.collect_list(F.struct("turn", "q", "a"))).alias("turns"), F.bool_and("faithful").alias("nat_all_faithful"))
    return g


# Turn jobs


def turn_jobs(turns: DataFrame, per_type: int | None = None) -> DataFrame:
    """Assistant turns as jobs with history, question and gold; at most per_type of a turn type, in hash order."""
    jobs = assistant_turns(turns).where("question is not null").withColumnRenamed("text", "gold")
    if per_type is None:
        return jobs
    jobs = jobs.withColumn("_id", F.concat_ws(":", "conv_id", "turn"))
    return per_group_cap(jobs, "turn_type", "_id", per_type).drop("_id")


def with_predictions(jobs: DataFrame, preds: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Jobs with saved predictions; the last of several wins, and missing ones are ''."""
    last = preds.groupBy(*keys).agg(F.max_by("pred", order).alias("pred"))
    return jobs.join(last, list(keys), "left").withColumn("pred", F.coalesce("pred", F.lit("")))


def overlap_by_type(jobs: DataFrame, train: DataFrame) -> DataFrame:
    """For each turn type the meshes of its jobs, those of them in train, and their rate; every mention of a mesh counts.

    Jobs without meshes add nothing; a type without any mesh has the rate 0.
    """
    ids = jobs.select("turn_type", F.explode_outer("mesh_indices").alias("index"))
    # Mentions of a mesh combine first, so a mesh that very many jobs name is one row of the join.
    counts = ids.groupBy("turn_type", "index").agg(F.count("index").alias("c"))
    seen = counts.join(train.select("index").distinct().withColumn("hit", F.lit(1)), "index", "left")
    sums = seen.groupBy("turn_type").agg(F.coalesce(F.sum(F.col("c") * F.col("hit")), F.lit(0)).alias("in_train"), F.sum("c").alias("total"))
    return sums.withColumn("rate", F.coalesce(F.try_divide("in_train", "total"), F.lit(0.0)))


# Regression scores; long form: row_id, index, muscle, pred, gold


def active_bins(long: DataFrame, eps: float = GOLD_EPS) -> DataFrame:
    """index and n_act_bin from the gold activations: 0, 1, 2 or 3+."""
    n = long.groupBy("index").agg(F.max("n").alias("n")) if "n" in long.columns else long.groupBy("index", "muscle").agg(F.max("gold").alias("gold")).groupBy("index").agg(F.count_if(F.col("gold") > eps).alias("n"))
    return n.select("index", F.when(F.col("n") >= 3, "3+").otherwise(F.col("n").cast("string")).alias("n_act_bin"))


def set_matches(long: DataFrame, threshold: float | Column, eps: float = GOLD_EPS, keys: Sequence[str] = ("row_id", "index")) -> DataFrame:
    """A row for each prediction: whether its active set is the gold's, and the counts of both."""
    p, g = F.col("pred") > threshold, F.col("gold") > eps
    return long.groupBy(*keys).agg(F.bool_and(p == g).alias("exact"), F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"))


def exact_scores(matches: DataFrame, groups: Sequence[str] = ("row_id",)) -> DataFrame:
    sums = matches.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("n_exact"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.withColumns({"em": F.col("n_exact") / F.col("n"), "f1": prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]})


def best_threshold(long: DataFrame, grid: Sequence[float] | None = None, metric: str = "em") -> DataFrame:
    """For each row_id the threshold of the best metric, em or f1, with all scores there; the smaller one among equals."""
    return best_of(threshold_curves(long, grid or threshold_grid(), eps=GOLD_EPS), ["row_id"], metric)


def dead_muscles(long: DataFrame, threshold: float, eps: float = GOLD_EPS) -> DataFrame:
    """For each row_id: muscles whose predictions never pass the threshold, meshes whose gold needs one, and the rest's exact share."""
    dead = long.groupBy("row_id", "muscle").agg((F.max("pred") <= threshold).alias("dead"))
    lost = long.join(F.broadcast(dead), ["row_id", "muscle"]).groupBy("row_id", "index").agg(F.bool_or(F.col("dead") & (F.col("gold") > eps)).alias("blocked"))
    j = set_matches(long, threshold, eps).join(lost, ["row_id", "index"])
    out = j.groupBy("row_id").agg(F.count_if("blocked").alias("n_blocked"), F.avg((~F.col("blocked")).cast("int")).alias("em_ceiling"), F.coalesce(F.avg(F.when(~F.col("blocked"), F.col("exact").cast("int"))), F.lit(0.0)).alias("em_reachable"))
    names = dead.groupBy("row_id").agg(F.array_sort(F.collect_set(F.when(F.col("dead"), F.col("muscle")))).alias("dead_muscles"))
    return out.join(names, "row_id")


def constant_baselines(gold: DataFrame, train: DataFrame) -> DataFrame:
    """Long-form predictions of zeros and of the training mean for every gold row (index, muscle, gold)."""
    mean = train.groupBy("muscle").agg(F.avg("gold").alias("pred"))
    a = gold.select(F.lit("zeros").alias("row_id"), "index", "muscle", F.lit(0.0).alias("pred"), "gold")
    return a.unionByName(gold.join(F.broadcast(mean), "muscle").select(F.lit("train_mean").alias("row_id"), "index", "muscle", "pred", "gold"))
