"""The registered queries over the provided tables, each beside the DuckDB SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..functions.geometry import features_of
from ..functions.spans import Vocabulary, spans_of
from ..operators import bootstrap, conversations, curves, index, mesh, metrics, nearest, probe, ranking, statistics
from ..operators.bootstrap import weighted_sql
from ..streaming.resume import first_settled, windowed_counts
from . import evaluation, probe_items
from .span_sql import greedy_sql, span_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT o_orderkey, o_orderkey // 1000 AS verts_shard, o_orderkey % 1000 AS row_in_shard FROM orders")
def q_shard_address(spark, d):
    return index.shard_address(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("""SELECT d.doc_id, source, lang, quality, toxic, d.doc_id // 1000 AS verts_shard, d.doc_id % 1000 AS row_in_shard
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_index_left_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return index.shard_address(index.pruned_left_join(docs, table(spark, d, "labels"), "doc_id", ["quality", "toxic"]), "doc_id")


@query("SELECT quality, toxic, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY quality, toxic")
def q_label_counts_null(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return index.value_counts(index.pruned_left_join(docs, table(spark, d, "labels"), "doc_id", ["quality", "toxic"]), "quality", "toxic")


@query("""WITH c AS (SELECT CASE WHEN l_tax > 0.075 THEN 'FAILED' WHEN l_quantity > 47 THEN 'INVALID'
  WHEN l_discount > 0.085 OR l_quantity < 4 THEN 'MARGINAL' ELSE 'VALID' END AS label,
  CASE WHEN l_tax > 0.075 THEN 'tax' WHEN l_quantity > 47 THEN 'quantity'
  ELSE concat_ws(';', CASE WHEN l_discount > 0.085 THEN 'discount' END, CASE WHEN l_quantity < 4 THEN 'few' END) END AS reason FROM lineitem)
SELECT label, reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM c GROUP BY label, reason""")
def q_validity_ladder(spark, d):
    c = F.col
    label, reason = index.ladder(
        [("FAILED", "tax", c("l_tax") > 0.075), ("INVALID", "quantity", c("l_quantity") > 47)],
        [("discount", c("l_discount") > 0.085), ("few", c("l_quantity") < 4)],
    )
    return index.with_shares(index.value_counts(table(spark, d, "lineitem").select(label.alias("label"), reason.alias("reason")), "label", "reason"))


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def q_valid_semi(spark, d):
    return index.valid_only(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").where("quality = 1"), "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_valid_anti(spark, d):
    return index.missing_from(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("""SELECT n.o_orderkey, n.o_orderkey - 1 AS base_index, round(n.o_totalprice - b.o_totalprice, 2) AS delta,
abs(n.o_totalprice - b.o_totalprice) < 1000 AS negligible
FROM orders n LEFT JOIN orders b ON b.o_orderkey = n.o_orderkey - 1""")
def q_neighbor_delta(spark, d):
    out = index.neighbor_delta(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", F.col("o_orderkey") - 1, ["o_totalprice"])
    return out.select("o_orderkey", "base_index", F.round("d_o_totalprice", 2).alias("delta"), (F.abs("d_o_totalprice") < 1000).alias("negligible"))


@query("SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def q_pair_grid(spark, d):
    return index.pairs(table(spark, d, "nation"), "n_nationkey", ["n_name"]).select(F.col("n_name_a").alias("first"), F.col("n_name_b").alias("second"))


@query("SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, md5(text) AS digest FROM documents GROUP BY text")
def q_dedup_keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return index.keep_first(docs, ["text"], ["doc_id"]).select("doc_id", "source", F.md5("text").alias("digest"))


_SPLIT = """SELECT doc_id, lang, CASE WHEN r <= floor(n * 0.05::DOUBLE) THEN 'val' WHEN r <= floor(n * 0.05::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)"""


@query(_SPLIT)
def q_stratified_split(spark, d):
    return ranking.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(f"SELECT lang, split, count(*) AS n FROM ({_SPLIT}) GROUP BY ROLLUP (lang, split)")
def q_split_crosstab(spark, d):
    return q_stratified_split(spark, d).rollup("lang", "split").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY l_orderkey),
b AS (SELECT o_orderkey, o_orderpriority, CASE WHEN k <= 1 THEN '1' WHEN k = 2 THEN '2' ELSE '3+' END AS bin FROM orders JOIN c ON o_orderkey = l_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, md5(o_orderkey::VARCHAR), o_orderkey) AS r FROM b)
SELECT o_orderkey, bin FROM r WHERE r <= CASE bin WHEN '1' THEN 34 ELSE 33 END""")
def q_balanced_sample(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("k"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(counts, "o_orderkey").withColumn("bin", probe_items.n_act_bin(F.col("k")))
    return ranking.balanced_sample(orders, "bin", ranking.quotas(100, ["1", "2", "3+"]), F.col("o_orderpriority") == "1-URGENT", "o_orderkey").select("o_orderkey", "bin")


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 20000""")
def q_source_quota(spark, d):
    return ranking.quota_prefix(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 20_000).select("doc_id", "source")


@query("""SELECT doc_id, source, CAST(row_number() OVER (ORDER BY r, source) AS INT) AS position FROM (SELECT doc_id, source, r FROM (
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) ORDER BY r, source LIMIT 150)""")
def q_round_robin(spark, d):
    return ranking.round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 150)


@query("""SELECT conv_id, turn, question, n_history, ordinal FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER b AS question,
count(*) OVER b AS n_history, CAST(sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS ordinal FROM conversations
WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant'""")
def q_turn_wise(spark, d):
    return conversations.assistant_turns(table(spark, d, "conversations")).select("conv_id", "turn", "question", "n_history", "ordinal")


@query("""SELECT conv_id, turn, string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS history FROM conversations""")
def q_turn_history(spark, d):
    return conversations.with_history(table(spark, d, "conversations"), "role").select("conv_id", "turn", "history")


@query("""SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR), event_id) AS r FROM events) WHERE r <= 20""")
def q_per_type_cap(spark, d):
    return ranking.per_group_cap(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 20)


@query("""SELECT l_orderkey, bool_and(l_suppkey % 2 = 0) AS in_all, arg_min(l_suppkey % 2 = 0, l_linenumber * 100000 + l_suppkey) AS in_primary, bool_or(l_suppkey % 2 = 0) AS in_any
FROM lineitem GROUP BY l_orderkey""")
def q_split_policy(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_linenumber") * 100_000 + F.col("l_suppkey")).alias("place"))
    return index.membership_policies(lines, "l_orderkey", "l_suppkey", F.col("l_suppkey") % 2 == 0, "place")


@query("""WITH ids AS (SELECT o_orderstatus AS turn_type, l_partkey AS index FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 5 <> 0 AND o_orderpriority <> '5-LOW'),
types AS (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'empty' ELSE o_orderstatus END AS turn_type FROM orders)
SELECT t.turn_type, count(p_partkey) AS in_train, count(index) AS total, round(coalesce(count(p_partkey) / nullif(count(index), 0), 0), 6) AS rate
FROM types t LEFT JOIN ids ON ids.turn_type = t.turn_type LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) ON index = p_partkey GROUP BY t.turn_type""")
def q_train_overlap(spark, d):
    """Jobs that name several meshes, some twice, and jobs that name none."""
    train = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("index"))
    named = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("named"))
    jobs = table(spark, d, "orders").join(named, "o_orderkey", "left")
    low = (F.col("o_orderpriority") == "5-LOW") | (F.col("o_orderkey") % 5 == 0)
    ids = F.when(low | F.col("named").isNull(), F.expr("cast(array() as array<bigint>)")).otherwise(F.col("named").cast("array<bigint>"))
    kind = F.when(F.col("o_orderkey") % 5 == 0, "empty").otherwise(F.col("o_orderstatus"))
    return evaluation.overlap_by_type(jobs.select(kind.alias("turn_type"), ids.alias("mesh_indices")), train).select("turn_type", "in_train", "total", F.round("rate", 6).alias("rate"))


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS id, role FROM conversations)
SELECT id, role, coalesce(lead(id) OVER (PARTITION BY role ORDER BY id), first_value(id) OVER (PARTITION BY role ORDER BY id)) AS effective FROM t""")
def q_rotate_control(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")
    return ranking.rotate(turns, "role", "id")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 1.0/3) AS a, quantile_cont(value, 2.0/3) AS b FROM events GROUP BY event_type),
r AS (SELECT e.event_type, value, CASE WHEN value < a THEN 'front' WHEN value < b THEN 'mid' ELSE 'back' END AS region FROM events e JOIN q ON e.event_type = q.event_type)
SELECT event_type, round(avg(value) FILTER (WHERE region = 'front'), 4) AS front, round(avg(value) FILTER (WHERE region = 'mid'), 4) AS mid,
round(avg(value) FILTER (WHERE region = 'back'), 4) AS back FROM r GROUP BY event_type""")
def q_region_thirds(spark, d):
    r = statistics.region_thirds(table(spark, d, "events").select("event_type", "value"), "event_type", "value")
    return r.groupBy("event_type").pivot("region", ["front", "mid", "back"]).agg(F.round(F.avg("value"), 4))


@query("""WITH s AS (SELECT l_partkey, sum(l_quantity) AS f, sum(round(l_discount * 500)) AS m, sum(round(l_tax * 600)) AS b FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, CASE WHEN f >= m AND f >= b THEN 'front' WHEN m >= b THEN 'mid' ELSE 'back' END AS region FROM s""")
def q_argmax_region(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("f"), F.sum(F.round(F.col("l_discount") * 500)).alias("m"), F.sum(F.round(F.col("l_tax") * 600)).alias("b"))
    return s.select("l_partkey", statistics.first_argmax(["front", "mid", "back"], [F.col("f"), F.col("m"), F.col("b")]).alias("region"))


_LEVELS = """lv AS (SELECT l_partkey, l_discount AS level, sum(l_quantity * round(l_discount * 100)) / count(*) AS resp FROM lineitem GROUP BY l_partkey, l_discount),
rk AS (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY level) + (count(*) OVER (PARTITION BY l_partkey, level) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY l_partkey ORDER BY resp) + (count(*) OVER (PARTITION BY l_partkey, resp) - 1) / 2.0::DOUBLE AS ry,
 lead(resp) OVER (PARTITION BY l_partkey ORDER BY level) AS nxt FROM lv)"""


@query(f"""WITH {_LEVELS}, g AS (SELECT l_partkey, count(*) AS n_levels, round(CASE WHEN stddev_pop(rx) * stddev_pop(ry) = 0 THEN 0 ELSE covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END, 9) AS rho,
bool_and(coalesce(nxt > resp, true)) AS monotonic, arg_max(resp, level) > arg_min(resp, level) AS net_up FROM rk GROUP BY l_partkey)
SELECT l_partkey, n_levels, round(rho, 6) AS rho, monotonic, net_up, CASE WHEN monotonic THEN 'strict' WHEN rho >= 0.9 AND net_up THEN 'near' ELSE 'partial' END AS tier FROM g WHERE n_levels >= 3""")
def q_dose_response(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_partkey", F.col("l_discount").alias("level"))
    rows = lines.agg((F.sum(F.col("l_quantity") * F.round(F.col("l_discount") * 100)) / F.count(F.lit(1))).alias("resp"))
    return statistics.dose_response(rows, "l_partkey", "level", "resp").withColumn("rho", F.round("rho", 6))


@query("""WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS x,
rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2.0::DOUBLE AS y FROM lineitem)
SELECT l_suppkey, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS rho, count(*) AS n FROM r GROUP BY l_suppkey""")
def q_spearman(spark, d):
    out = statistics.spearman(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount")
    return out.withColumn("rho", F.round("rho", 6))


@query("SELECT user_id, round(regr_slope(value, event_id), 6) AS slope, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 3")
def q_slope(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.round(F.regr_slope("value", "event_id"), 6).alias("slope"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 3")


@query("""SELECT event_id, user_id, round(sum(step) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS arc FROM (
SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts)), 0) AS step FROM events)""")
def q_arc_length(spark, d):
    return statistics.arc_length(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "user_id", F.round("arc", 4).alias("arc"))


@query("""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS nn_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d2
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nn_id) AS r FROM p)
SELECT id, nn_id, round(sqrt(d2), 5) AS distance FROM r WHERE r = 1""")
def q_nearest_vector(spark, d):
    """The queries are the rows whose id is divisible by 50, against all rows."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    out = nearest.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding")
    return out.withColumn("distance", F.round("distance", 5))


@query("""WITH e AS (SELECT unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT CAST(dim AS INT) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) AS n FROM e GROUP BY dim""")
def q_feature_stats(spark, d):
    s = statistics.element_stats(table(spark, d, "embeddings"), "embedding")
    return s.select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("""WITH u AS (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))) AS x FROM embeddings),
s AS (SELECT label, dim, sum(x) AS s, count(*) AS n FROM u GROUP BY label, dim)
SELECT label, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) AS cosine, max(n) AS n FROM s GROUP BY label""")
def q_cosine_offdiag(spark, d):
    c = statistics.mean_offdiagonal_cosine(table(spark, d, "embeddings"), "label", "embedding")
    return c.withColumn("cosine", F.round("cosine", 6))


@query(r"""SELECT * FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '-?\d+\.\d+|-?\d+')) AS INT) AS n_numbers,
TRY_CAST(nullif(regexp_extract(text, '-?\d+\.?\d*'), '') AS DOUBLE) AS first_value FROM documents) WHERE n_numbers > 0""")
def q_number_facts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.size(T.numbers(F.col("text"))).alias("n_numbers"), T.first_number(F.col("text")).alias("first_value")).where("n_numbers > 0")


@query(r"""WITH n AS (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang),
v AS (SELECT lang, value, count(*) AS df FROM (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(text, '-?\d+\.?\d*')) AS value FROM documents) GROUP BY lang, value)
SELECT v.lang, value, df, round(df / n_docs, 6) AS share FROM v JOIN n ON v.lang = n.lang WHERE df / n_docs >= 0.005""")
def q_number_df(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    values = docs.select("doc_id", "lang", F.explode(F.array_distinct(T.numbers(F.col("text"), T.NUMBERS_SCORED))).alias("value"))
    df = values.groupBy("lang", "value").agg(F.count_distinct("doc_id").alias("df"))
    j = df.join(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs")), "lang")
    return j.where(F.col("df") / F.col("n_docs") >= 0.005).select("lang", "value", "df", F.round(F.col("df") / F.col("n_docs"), 6).alias("share"))


_WORDS = r"list_filter(string_split_regex(lower({0}), '[^a-zà-ÿ]+'), lambda x: x <> '')"
_PAIRS = f"""t AS (SELECT conv_id, turn, role, {_WORDS.format("text")} AS pred, {_WORDS.format("last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")} AS gold FROM conversations),
a AS (SELECT conv_id, turn, list_distinct(pred) AS p, list_distinct(gold) AS g, pred, gold FROM t WHERE role = 'assistant' AND gold IS NOT NULL),
c AS (SELECT conv_id, turn, len(list_intersect(g, p)) AS tp, len(p) - len(list_intersect(g, p)) AS fp, len(g) - len(list_intersect(g, p)) AS fn FROM a)"""
_PRF = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 6) AS f1"""


def _answers(spark, d):
    return conversations.assistant_turns(table(spark, d, "conversations")).where("question is not null")


@query(f"""WITH {_PAIRS}, s AS (SELECT conv_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY conv_id)
SELECT conv_id, tp, fp, fn, {_PRF} FROM s""")
def q_fact_prf(spark, d):
    return metrics.set_scores(_answers(spark, d), T.words(F.col("question")), T.words(F.col("text")), ["conv_id"])


@query(f"""WITH {_PAIRS}, g AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(gold) AS w FROM a) GROUP BY ALL),
p AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(pred) AS w FROM a) GROUP BY ALL)
SELECT g.conv_id, g.turn, g.w AS value, CAST(g.n - coalesce(p.n, 0) AS INT) AS missing FROM g LEFT JOIN p ON g.conv_id = p.conv_id AND g.turn = p.turn AND g.w = p.w WHERE g.n > coalesce(p.n, 0)""")
def q_multiset_missing(spark, d):
    lost = T.multiset_missing(F.col("q"), F.col("a"))
    rows = _answers(spark, d).select("conv_id", "turn", T.words(F.col("question")).alias("q"), T.words(F.col("text")).alias("a"))
    return rows.select("conv_id", "turn", F.explode(lost).alias("x")).select("conv_id", "turn", "x.value", "x.missing")


@query(f"""WITH {_PAIRS}, k AS (SELECT CASE WHEN turn <= 2 THEN 'early' WHEN turn <= 4 THEN 'middle' ELSE 'late' END AS category, tp, fp, fn FROM c),
s AS (SELECT category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM k GROUP BY category),
u AS (SELECT * FROM s UNION ALL SELECT 'micro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM s),
x AS (SELECT category, tp, fp, fn, {_PRF} FROM u)
SELECT category, tp, fp, fn, f1 FROM x UNION ALL SELECT 'macro', NULL, NULL, NULL, round(avg(f1), 6) FROM x WHERE category <> 'micro'""")
def q_macro_micro(spark, d):
    phase = F.when(F.col("turn") <= 2, "early").when(F.col("turn") <= 4, "middle").otherwise("late")
    scores = metrics.set_scores(_answers(spark, d).withColumn("category", phase), T.words(F.col("question")), T.words(F.col("text")), ["category"])
    return metrics.macro_micro(scores, "category")


@query("""WITH x AS (SELECT CASE WHEN role = 'system' THEN 'system' ELSE 'dialogue' END AS part, role = 'assistant' AS should, regexp_matches(lower(text), 'of the|tion of') AS did FROM conversations),
c AS (SELECT part, count_if(should AND did) AS tp, count_if(NOT should AND did) AS fp, count_if(should AND NOT did) AS fn, count_if(NOT should AND NOT did) AS tn FROM x GROUP BY part)
SELECT part, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
CASE WHEN tp + fn > 0 THEN round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) END AS precision,
CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall,
CASE WHEN tp + fn > 0 THEN round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 6) END AS f1,
CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 6) END AS over_abstain FROM c""")
def q_abstention(spark, d):
    turns = table(spark, d, "conversations").withColumn("part", F.when(F.col("role") == "system", "system").otherwise("dialogue"))
    return metrics.abstention(turns, F.col("role") == "assistant", T.matches_any(F.col("text"), ["of the", "tion of"]), ["part"])


@query("""WITH x AS (SELECT CASE WHEN toxic = 1 THEN '-' WHEN quality = 1 THEN '+' ELSE '0' END AS gold,
CASE WHEN regexp_matches(text, '(?i)therou') THEN '+' WHEN regexp_matches(text, '(?i)than of') THEN '-' WHEN regexp_matches(text, '(?i)of the') THEN '0' ELSE '?' END AS pred
FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT gold, pred, count(*) AS n, (SELECT round(avg((gold = pred)::INT), 6) FROM x) AS accuracy,
(SELECT round(max(k) / sum(k), 6) FROM (SELECT count(*) AS k FROM x GROUP BY gold)) AS majority FROM x GROUP BY gold, pred""")
def q_sign_confusion(spark, d):
    j = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    gold = F.when(F.col("toxic") == 1, "-").when(F.col("quality") == 1, "+").otherwise("0")
    return metrics.label_confusion(j, gold, T.pattern_label(F.col("text"), [("therou", "+"), ("than of", "-"), ("of the", "0")], "?"))


@query("""WITH x AS (SELECT CASE WHEN l_linenumber <= 1 THEN '1' WHEN l_linenumber = 2 THEN '2' ELSE '3+' END AS bin, p_brand AS quantity,
abs(l_quantity - p_size) <= coalesce(CASE WHEN l_tax > 0.06 THEN 10::DOUBLE END, CASE WHEN p_size > 40 THEN 5::DOUBLE END, 2::DOUBLE) AS ok FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT bin, quantity, count(*) AS n, CAST(sum(ok::INT) AS BIGINT) AS n_ok, round(avg(ok::INT), 6) AS accuracy, CAST(grouping(bin, quantity) AS BIGINT) AS level FROM x GROUP BY GROUPING SETS ((), (bin), (quantity))""")
def q_value_tolerance(spark, d):
    c = F.col
    j = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_tax", "l_linenumber").join(table(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_size", c("p_brand").alias("quantity")), "l_partkey")
    tol = metrics.tolerance(F.when(c("l_tax") > 0.06, 10.0), F.when(c("p_size") > 40, 5.0), default=2.0)
    j = j.withColumn("bin", F.when(c("l_linenumber") <= 1, "1").when(c("l_linenumber") == 2, "2").otherwise("3+"))
    return metrics.grouped_accuracy(j, F.abs(c("l_quantity") - c("p_size")) <= tol, ["bin", "quantity"])


@query("""WITH x AS (SELECT l_orderkey, count(*) AS k, bool_or(l_returnflag = 'R') AS g1, bool_or(l_linestatus = 'O') AS g2, bool_or(l_tax > 0.04) AS g3,
bool_or(l_discount > 0.05) AS p1, bool_or(l_quantity > 25) AS p2, bool_or(l_discount > 0.03) AS p3 FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN k <= 1 THEN '1' WHEN k = 2 THEN '2' ELSE '3+' END AS bin, count(*) AS n, round(avg((g1 = p1 AND g2 = p2 AND g3 = p3)::INT), 6) AS exact,
round(avg(((g1 = p1)::INT + (g2 = p2)::INT + (g3 = p3)::INT) / 3), 6) AS per_flag FROM x GROUP BY bin""")
def q_exact_set_em(spark, d):
    c = F.col
    flags = {"g1": c("l_returnflag") == "R", "g2": c("l_linestatus") == "O", "g3": c("l_tax") > 0.04, "p1": c("l_discount") > 0.05, "p2": c("l_quantity") > 25, "p3": c("l_discount") > 0.03}
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"), *[F.bool_or(v).alias(k) for k, v in flags.items()])
    x = x.withColumn("bin", F.when(c("k") <= 1, "1").when(c("k") == 2, "2").otherwise("3+"))
    return metrics.exact_match(x, [c("g1"), c("g2"), c("g3")], [c("p1"), c("p2"), c("p3")], ["bin"])


@query("""SELECT l_returnflag, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(avg(abs(e)) FILTER (WHERE a), 6) AS mae_active, round(avg(abs(e)) FILTER (WHERE NOT a), 6) AS mae_inactive, round(sqrt(avg(e * e)), 6) AS rmse
FROM (SELECT l_returnflag, round(l_discount * 500) - l_quantity AS e, l_quantity > 25 AS a FROM lineitem) GROUP BY l_returnflag""")
def q_mae_split(spark, d):
    return metrics.regression_errors(table(spark, d, "lineitem"), F.round(F.col("l_discount") * 500), F.col("l_quantity"), F.col("l_quantity") > 25, ["l_returnflag"])


@query("""SELECT 'l_tax' AS name, max(l_tax) AS largest, 0.08::DOUBLE AS threshold, max(l_tax) <= 0.08::DOUBLE AS dead FROM lineitem
UNION ALL SELECT 'l_discount', max(l_discount), 0.05::DOUBLE, max(l_discount) <= 0.05::DOUBLE FROM lineitem
UNION ALL SELECT 'l_quantity', max(l_quantity), 60::DOUBLE, max(l_quantity) <= 60::DOUBLE FROM lineitem""")
def q_dead_columns(spark, d):
    return metrics.dead_columns(table(spark, d, "lineitem"), {"l_tax": 0.08, "l_discount": 0.05, "l_quantity": 60.0})


@query("""WITH g AS (SELECT unnest([100, 200, 400, 800, 1600, 3200])::DOUBLE AS threshold),
h AS (SELECT threshold, count(*) AS n, count_if((n_chars > threshold) = (quality = 1)) AS n_ok FROM documents d JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN g GROUP BY threshold)
SELECT threshold, n, CAST(n_ok AS BIGINT) AS n_ok, round(n_ok / n, 6) AS accuracy, row_number() OVER (ORDER BY n_ok DESC, threshold) = 1 AS is_best FROM h""")
def q_threshold_sweep(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return metrics.threshold_sweep(j, F.col("n_chars"), F.col("quality") == 1, [100, 200, 400, 800, 1600, 3200])


_SIDES = "SELECT (n_chars > 700) = (quality = 1) AS a, (n_chars > 1400) = (quality = 1) AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def _sides(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    good = F.col("quality") == 1
    return j, (F.col("n_chars") > 700) == good, (F.col("n_chars") > 1400) == good


@query(f"""WITH c AS (SELECT count_if(a AND NOT b) AS x, count_if(b AND NOT a) AS y FROM ({_SIDES})),
t AS (SELECT unnest(range(0, CAST(least(x, y) AS BIGINT) + 1)) AS i, x + y AS n FROM c)
SELECT CAST(x AS BIGINT) AS a_only, CAST(y AS BIGINT) AS b_only, CASE WHEN x + y = 0 THEN 1.0::DOUBLE ELSE round(least(1, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM t)), 6) END AS p_value FROM c""")
def q_mcnemar(spark, d):
    return metrics.mcnemar(*_sides(spark, d))


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_WORDS.format("text")} AS pred, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM conversations),
a AS (SELECT conv_id * 1000 + turn AS id, list_distinct(pred) AS p, q FROM t WHERE role = 'assistant' AND q IS NOT NULL),
r AS (SELECT p, list_distinct({_WORDS.format("q")}) AS g, list_distinct({_WORDS.format("coalesce(lead(q) OVER (ORDER BY id), first_value(q) OVER (ORDER BY id))")}) AS s FROM a),
h AS (SELECT sum(len(list_intersect(p, g)))::BIGINT AS real_hits, sum(len(list_intersect(p, s)))::BIGINT AS control_hits, count(*) AS n FROM r)
SELECT real_hits, control_hits, n, round((real_hits - control_hits) / n, 6) AS delta FROM h""")
def q_delta_control(spark, d):
    rows = _answers(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("answer").alias("kind"), "question", "text")
    control = ranking.rotate(rows.select("id", "kind"), "kind", "id").join(rows.select(F.col("id").alias("effective"), F.col("question").alias("other")), "effective").select("id", "other")
    hits = lambda c: F.sum(F.size(F.array_intersect(T.words(F.col("text")), T.words(F.col(c))))).cast("long")
    real, shuffled = rows.agg(hits("question").alias("hits")), rows.join(control, "id").agg(hits("other").alias("hits"))
    both = probe.control_delta(real, shuffled, "hits", ("real_hits", "control_hits")).crossJoin(rows.agg(F.count(F.lit(1)).alias("n")))
    return both.select("real_hits", "control_hits", "n", F.round(F.col("delta") / F.col("n"), 6).alias("delta"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type")
def q_json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'part ' || l_partkey::VARCHAR || ' moves ' || printf('%.2f', l_extendedprice / 1000) || ' mm at level ' || printf('%.2f', l_discount) AS line FROM lineitem""")
def q_template_render(spark, d):
    c = F.col
    line = T.render("part {part} moves {mm} mm at level {level}", {"part": c("l_partkey").cast("string"), "mm": T.fixed(c("l_extendedprice") / 1000, 2), "level": T.fixed(c("l_discount"), 2)})
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", line.alias("line"))


@query("SELECT l_suppkey AS row_id, CAST(sum(CAST(l_quantity AS BIGINT) * p_size) AS BIGINT) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def q_sparse_pool(spark, d):
    coo = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("row_id"), F.col("l_partkey").alias("col"), F.col("l_quantity").cast("long").alias("val"))
    return mesh.sparse_apply(coo, table(spark, d, "part").select(F.col("p_partkey").alias("col"), F.col("p_size").alias("x")), "row_id")


@query("""WITH m AS (SELECT o_custkey, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS best FROM orders) SELECT o_custkey, o_orderkey, best, before IS NULL OR o_totalprice > before AS improved FROM m""")
def q_running_best(spark, d):
    return metrics.running_best(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", "o_totalprice").drop("o_totalprice")


@query("""SELECT vec_id, label, list_filter(range(0, 64), lambda i: embedding[i + 1] > 0.15) AS active, CAST(len(list_filter(range(0, 64), lambda i: embedding[i + 1] > 0.15)) AS INT) AS n_active FROM embeddings""")
def q_active_sets(spark, d):
    # The elements are floats, and so is the bound: as a double it lies below the float next to it.
    act = F.expr("filter(sequence(0L, 63L), i -> get(embedding, cast(i as int)) > 0.15F)")
    return table(spark, d, "embeddings").select("vec_id", "label", act.alias("active"), F.size(act).alias("n_active"))


@query("""WITH c AS (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, i, round(avg(x), 9) AS t FROM c GROUP BY label, i), v AS (SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, CAST(count_if(t - x >= 0.2) AS BIGINT) AS n_increase, CAST(count_if(x - t >= 0.2) AS BIGINT) AS n_decrease FROM v JOIN m ON v.label = m.label AND v.i = m.i GROUP BY vec_id""")
def q_correction_sets(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    target = v.groupBy("label", "i").agg(F.round(F.avg("x"), 9).alias("t"))
    j = v.join(target, ["label", "i"])
    return j.groupBy("vec_id").agg(F.count_if(F.col("t") - F.col("x") >= 0.2).alias("n_increase"), F.count_if(F.col("x") - F.col("t") >= 0.2).alias("n_decrease"))


_FACES = "SELECT l_partkey % 40 AS i, l_suppkey % 40 AS j, l_orderkey % 40 AS k FROM lineitem"


def _faces(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 40).alias("i"), (F.col("l_suppkey") % 40).alias("j"), (F.col("l_orderkey") % 40).alias("k"))


@query(f"""WITH f AS ({_FACES}), e AS (SELECT i AS a, j AS b FROM f UNION ALL SELECT j, k FROM f UNION ALL SELECT k, i FROM f)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e""")
def q_mesh_edges(spark, d):
    return mesh.edges(_faces(spark, d))


@query(f"""WITH f AS ({_FACES}), u AS (SELECT i AS old FROM f UNION SELECT j FROM f UNION SELECT k FROM f)
SELECT old, row_number() OVER (ORDER BY old) - 1 AS new FROM u""")
def q_compact_ids(spark, d):
    return mesh.compact_ids(_faces(spark, d))


@query("""WITH q AS (SELECT quantile_cont(value, 0.2) AS a, quantile_cont(value, 0.8) AS b, quantile_cont(user_id::DOUBLE, 0.7) AS c FROM events),
m AS (SELECT event_id AS vertex, value <= a AS tip, value >= b AS root, user_id >= c AS high FROM events, q)
SELECT vertex, 'tip' AS region FROM m WHERE tip UNION ALL SELECT vertex, 'root' FROM m WHERE root
UNION ALL SELECT vertex, 'body' FROM m WHERE NOT tip AND NOT root UNION ALL SELECT vertex, 'dorsum' FROM m WHERE NOT tip AND high""")
def q_region_masks(spark, d):
    return probe.region_masks(table(spark, d, "events").select(F.col("event_id").alias("vertex"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("z")))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, round(l_discount * 100) - 5 AS f, round(l_tax * 100) - 4 AS u FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN abs(f) < 2 AND abs(u) < 2 THEN 'preserve' ELSE concat_ws('+', CASE WHEN f >= 2 THEN 'advance' WHEN f <= -2 THEN 'retract' END, CASE WHEN u >= 2 THEN 'elevate' WHEN u <= -2 THEN 'descend' END) END AS labels FROM x""")
def q_direction_labels(spark, d):
    c = F.col
    labels = probe.direction_labels(F.round(c("l_discount") * 100) - 5, F.round(c("l_tax") * 100) - 4, 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.array_join(labels, "+").alias("labels"))


@query("SELECT o_orderkey, o_totalprice, round(10 * pow(t, 3) - 15 * pow(t, 4) + 6 * pow(t, 5), 6) AS ramp FROM (SELECT *, (o_orderkey % 101) / 100 AS t FROM orders)")
def q_min_jerk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.round(mesh.min_jerk((F.col("o_orderkey") % 101) / F.lit(100.0)), 6).alias("ramp"))


@query("""WITH t AS (SELECT p_partkey, p_retailprice / 100 AS x, rtrim(rtrim(printf('%.3f', p_retailprice / 100), '0'), '.') AS small FROM part)
SELECT p_partkey, CASE WHEN abs(x) >= 10 THEN printf('%.1f', x) ELSE small END AS value FROM t""")
def q_value_text(spark, d):
    return table(spark, d, "part").select("p_partkey", T.value_text(F.col("p_retailprice") / 100).alias("value"))


@query("""WITH a AS (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity) AS v FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_transform(list_concat(v, list_transform(range(0, greatest(0, 8 - len(v))), lambda i: 0.0::DOUBLE)), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS padded, CAST(len(v) AS BIGINT) AS n_valid FROM a""")
def q_pad_mask(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("v"))
    padded, mask = mesh.padded(F.col("v"), 8)
    return a.select("l_orderkey", F.array_join(F.transform(padded, lambda x: x.cast("long").cast("string")), ",").alias("padded"), F.size(F.filter(mask, lambda m: m)).cast("long").alias("n_valid"))


@query("""WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY dim)
SELECT vec_id, round(max(abs((x - m) / greatest(sd, 1e-6))), 5) AS largest FROM e JOIN s ON e.dim = s.dim GROUP BY vec_id""")
def q_zscore(spark, d):
    e = table(spark, d, "embeddings")
    x = e.select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    z = x.join(F.broadcast(statistics.element_stats(e, "embedding")), "dim")
    return z.groupBy("vec_id").agg(F.round(F.max(F.abs(statistics.zscore(F.col("x"), F.col("mean"), F.col("std")))), 5).alias("largest"))


@query("""WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents),
m AS (SELECT doc_id AS old, row_number() OVER (ORDER BY doc_id) - 1 AS new FROM k WHERE doc_id = first)
SELECT d.doc_id, coalesce(m.new, -1) AS base FROM documents d LEFT JOIN m ON d.doc_id + 1 = m.old""")
def q_remap_lost(spark, d):
    """Each document's successor, renumbered after copies were dropped; -1 where the successor is gone."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    kept = index.keep_first(docs, ["text"], ["doc_id"]).select(F.col("doc_id").alias("old"))
    mapping = ranking.dense_number(kept, "old", "new")
    return index.remap(docs.select("doc_id", (F.col("doc_id") + 1).alias("base")), "base", mapping, "old", "new").select("doc_id", "base")


_LONG = "SELECT l_returnflag AS row_id, l_orderkey AS index, l_linenumber AS muscle, l_discount AS pred, CASE WHEN l_tax > 0.04 THEN l_tax ELSE 0 END AS gold FROM lineitem"


def _long(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(c("l_returnflag").alias("row_id"), c("l_orderkey").alias("index"), c("l_linenumber").alias("muscle"), c("l_discount").alias("pred"), F.when(c("l_tax") > 0.04, c("l_tax")).otherwise(0.0).alias("gold"))


@query(f"""WITH x AS ({_LONG}), g AS (SELECT unnest([0.015, 0.035, 0.055, 0.075, 0.2])::DOUBLE AS threshold),
m AS (SELECT row_id, index, threshold, bool_and((pred > threshold) = (gold > 1e-4)) AS ok FROM x, g GROUP BY ALL),
s AS (SELECT row_id, threshold, count(*) AS n, count_if(ok) AS n_exact FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n_exact / n DESC, threshold) AS r FROM s)
SELECT row_id, threshold, n, CAST(n_exact AS BIGINT) AS n_exact, round(n_exact / n, 6) AS em FROM r WHERE r = 1""")
def q_best_threshold(spark, d):
    best = evaluation.best_threshold(_long(spark, d), [0.015, 0.035, 0.055, 0.075, 0.2])
    return best.select("row_id", "threshold", "n", "n_exact", F.round("em", 6).alias("em"))


@query(f"""WITH x AS ({_LONG}), dead AS (SELECT row_id, muscle FROM x GROUP BY row_id, muscle HAVING max(pred) <= 0.099),
b AS (SELECT x.row_id, x.index, bool_or(dead.muscle IS NOT NULL AND gold > 1e-4) AS blocked, bool_and((pred > 0.099) = (gold > 1e-4)) AS exact FROM x LEFT JOIN dead ON x.row_id = dead.row_id AND x.muscle = dead.muscle GROUP BY x.row_id, x.index)
SELECT row_id, CAST(count_if(blocked) AS BIGINT) AS n_blocked, round(avg((NOT blocked)::INT), 6) AS em_ceiling, round(coalesce(avg(exact::INT) FILTER (WHERE NOT blocked), 0), 6) AS em_reachable FROM b GROUP BY row_id""")
def q_dead_heads(spark, d):
    r = evaluation.dead_muscles(_long(spark, d), 0.099)
    return r.select("row_id", "n_blocked", F.round("em_ceiling", 6).alias("em_ceiling"), F.round("em_reachable", 6).alias("em_reachable"))


@query(f"""WITH x AS ({_LONG}), g AS (SELECT index, muscle, gold FROM x WHERE row_id = 'A'), m AS (SELECT muscle, avg(gold) AS p FROM x WHERE row_id = 'R' GROUP BY muscle)
SELECT 'zeros' AS row_id, count(*) AS n, round(avg(abs(gold)), 6) AS mae FROM g UNION ALL SELECT 'train_mean', count(*), round(avg(abs(p - gold)), 6) FROM g JOIN m ON g.muscle = m.muscle""")
def q_constant_baselines(spark, d):
    x = _long(spark, d)
    base = evaluation.constant_baselines(x.where("row_id = 'A'").select("index", "muscle", "gold"), x.where("row_id = 'R'").select("muscle", "gold"))
    return base.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("gold"))), 6).alias("mae"))


@query("""SELECT l_returnflag, round(sum(l_quantity * round(l_discount * 100)) / greatest(sum(l_quantity), 1), 6) AS mean FROM lineitem GROUP BY l_returnflag""")
def q_weighted_mean(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.round(F.col("l_discount") * 100).alias("ce"), F.col("l_quantity").alias("w"))
    return metrics.weighted_mean(rows, "ce", "w", ["l_returnflag"]).withColumn("mean", F.round("mean", 6))


@query("SELECT user_id, min(event_id) FILTER (WHERE event_id >= 100 AND value < 20) AS settle_t FROM events GROUP BY user_id")
def q_first_settled(spark, d):
    return first_settled(table(spark, d, "events"), "user_id", "event_id", "value", 100, 20.0)


@query("""SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY ALL""")
def q_windowed_counts(spark, d):
    """An extension: tumbling windows, as the same function runs them over streams."""
    w = windowed_counts(table(spark, d, "events"), "ts", "event_type", "user_id", "6 hours")
    return w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_CORPUS_WORDS = Vocabulary(muscles=["of the", "tion of"], movements=["the", "that"], regions=["and", "er"], roles=[("the", "after_the")], whole_movements=True, whole_regions=True)


@query(span_sql("SELECT doc_id, text FROM documents", "doc_id", _CORPUS_WORDS))
def q_span_tags(spark, d):
    """Words and numbers of documents tagged with a vocabulary of this corpus; offsets are code points."""
    tags = table(spark, d, "documents").select("doc_id", F.explode(spans_of(F.col("text"), _CORPUS_WORDS)).alias("s"))
    return tags.select("doc_id", "s.*").withColumnRenamed("end", "stop")


_NAME_LIST = ", ".join(f"'{n}'" for n in V.FULL_NAMES["en"].values())


@query(f"""WITH lines AS (SELECT row_number() OVER () AS line, l_orderkey, l_linenumber, [{_NAME_LIST}][CAST(l_linenumber % 11 + 1 AS INT)] || ' contracts: front dx ' || printf('%.2f', l_discount * 10)
  || 'mm, dz ' || printf('%.2f', l_tax * -10) || 'mm; the front region advance, vol_ratio=' || printf('%.3f', l_quantity / 50) AS text FROM lineitem),
tags AS ({span_sql("SELECT line, text FROM lines", "line", Vocabulary.rewritten("en"))})
SELECT l_orderkey, l_linenumber, text, type, value, start, stop, role FROM tags JOIN lines USING (line)""")
def q_rewritten_span_tags(spark, d):
    """Template sentences rendered from lines, tagged again with the vocabulary for rewritten texts."""
    c = F.col
    text = T.render("{m} contracts: front dx {x}mm, dz {z}mm; the front region advance, vol_ratio={v}", {"m": F.element_at(F.array(*[F.lit(n) for n in V.FULL_NAMES["en"].values()]), (c("l_linenumber") % 11).cast("int") + 1), "x": T.fixed(c("l_discount") * 10, 2), "z": T.fixed(c("l_tax") * -10, 2), "v": T.fixed(c("l_quantity") / 50, 3)})
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"))
    tags = lines.select("l_orderkey", "l_linenumber", "text", F.explode(spans_of(c("text"), Vocabulary.rewritten("en"))).alias("s"))
    return tags.select("l_orderkey", "l_linenumber", "text", "s.*").withColumnRenamed("end", "stop")


_ORDER_NUMBERS = "SELECT l_orderkey, list(l_quantity) AS gold FROM lineitem GROUP BY l_orderkey"


@query(f"""SELECT key AS l_orderkey, tp, fp, fn FROM ({greedy_sql(f"SELECT o.l_orderkey AS key, o.gold, coalesce(p.gold, []) AS pred FROM ({_ORDER_NUMBERS}) o LEFT JOIN ({_ORDER_NUMBERS}) p ON p.l_orderkey + 1 = o.l_orderkey")})""")
def q_greedy_tolerance(spark, d):
    """Numbers of an order's lines against those of its predecessor, matched within the tolerance."""
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("gold"))
    other = own.select((F.col("l_orderkey") + 1).alias("l_orderkey"), F.col("gold").alias("pred"))
    return metrics.greedy_tolerance(own.join(other, "l_orderkey", "left"), "l_orderkey", "gold", "pred")


@query(f"""WITH r AS (SELECT d.doc_id AS item, ((n_chars > 700) = (quality = 1))::INT AS a, ((n_chars > 1400) = (quality = 1))::INT AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
w AS ({weighted_sql("r", 200)}), s AS (SELECT sample, sum(w * (a - b)) / sum(w) AS v FROM w GROUP BY sample)
SELECT (SELECT count(*) FROM r) AS n, (SELECT round(avg(a - b), 6) FROM r) AS difference, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM s""")
def q_bootstrap_ci(spark, d):
    """Accuracies of two thresholds on the same items, resampled 200 times."""
    j, a, b = _sides(spark, d)
    out = metrics.paired_bootstrap(j, a, b, "doc_id", 200)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high")])


@query(f"""WITH x AS (SELECT l_orderkey * 8 + l_linenumber AS item, max(l_discount) > 0.05 AS p, max(l_tax) > 0.04 AS g, max(abs(l_discount - l_tax)) AS e FROM lineitem GROUP BY 1),
w AS ({weighted_sql("x", 60)}), s AS (SELECT sample, sum(w * (p AND g)::INT) AS tp, sum(w * (p AND NOT g)::INT) AS fp, sum(w * (NOT p AND g)::INT) AS fn, sum(w * e) / sum(w) AS mae FROM w GROUP BY sample),
b AS (SELECT count_if(p AND g) AS tp, count_if(p AND NOT g) AS fp, count_if(NOT p AND g) AS fn, avg(e) AS mae, count(*) AS n FROM x)
SELECT 'f1' AS metric, (SELECT n FROM b) AS n, (SELECT round(2 * tp / (2 * tp + fp + fn), 6) FROM b) AS value, round(quantile_cont(2 * tp / (2 * tp + fp + fn), 0.025), 6) AS low, round(quantile_cont(2 * tp / (2 * tp + fp + fn), 0.975), 6) AS high FROM s
UNION ALL SELECT 'mae', (SELECT n FROM b), (SELECT round(mae, 6) FROM b), round(quantile_cont(mae, 0.025), 6), round(quantile_cont(mae, 0.975), 6) FROM s""")
def q_bootstrap_metrics(spark, d):
    """Intervals of an F1 and of a mean error by the same weights."""
    c = F.col
    rows = table(spark, d, "lineitem").groupBy((c("l_orderkey") * 8 + c("l_linenumber")).alias("item"))
    rows = rows.agg((F.max("l_discount") > 0.05).alias("p"), (F.max("l_tax") > 0.04).alias("g"), F.max(F.abs(c("l_discount") - c("l_tax"))).alias("e"))
    counts = {"tp": (c("p") & c("g")).cast("int"), "fp": (c("p") & ~c("g")).cast("int"), "fn": (~c("p") & c("g")).cast("int")}
    f1 = bootstrap.bootstrap(rows, "item", counts, bootstrap.f1_of("tp", "fp", "fn"), 60).withColumn("metric", F.lit("f1"))
    mae = bootstrap.bootstrap(rows, "item", {"e": c("e")}, F.try_divide("e", "n"), 60).withColumn("metric", F.lit("mae"))
    return f1.unionByName(mae).select("metric", "n", *[F.round(x, 6).alias(x) for x in ("value", "low", "high")])


_GRID = [0.0, 0.005, 0.015, 0.02, 0.035, 0.05, 0.055, 0.07, 0.075, 0.1, 0.2]


@query(f"""WITH x AS ({_LONG}), g AS (SELECT unnest({_GRID})::DOUBLE AS threshold), m AS (SELECT row_id, index, threshold, bool_and((pred > threshold) = (gold > 1e-4)) AS ok, count_if(pred > threshold AND gold > 1e-4) AS tp, count_if(pred > threshold AND gold <= 1e-4) AS fp, count_if(pred <= threshold AND gold > 1e-4) AS fn FROM x, g GROUP BY ALL),
s AS (SELECT row_id, threshold, count(*) AS n, count_if(ok) AS n_exact, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM m GROUP BY ALL)
SELECT row_id, threshold, n, CAST(n_exact AS BIGINT) AS n_exact, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + fp) / n, 6) AS pred_n_act FROM s""")
def q_threshold_curves(spark, d):
    """All curves of all heads, one row an item and none a threshold."""
    c = curves.threshold_curves(_long(spark, d), _GRID)
    return c.select("row_id", "threshold", "n", "n_exact", "tp", "fp", "fn", F.round("f1", 6).alias("f1"), F.round("pred_n_act", 6).alias("pred_n_act"))


@query(f"""WITH x AS ({_LONG}), g AS (SELECT unnest({_GRID})::DOUBLE AS threshold), m AS (SELECT row_id, index, threshold, bool_and((pred > threshold) = (gold > 1e-4)) AS ok FROM x, g GROUP BY ALL),
k AS (SELECT unnest([0, 1, 42, NULL]) AS seed), o AS (SELECT row_id, index, seed, row_number() OVER (PARTITION BY row_id, seed ORDER BY md5(seed || ':' || index), index) AS r FROM (SELECT DISTINCT row_id, index FROM m WHERE index % 10 < 5), k),
s AS (SELECT m.row_id, seed, threshold, avg(ok::INT) AS em FROM m JOIN o ON o.row_id = m.row_id AND o.index = m.index WHERE seed IS NULL OR r <= 300 GROUP BY ALL),
b AS (SELECT row_id, seed, arg_max(threshold, em * 1e6 - threshold) AS threshold, max(em) AS val_em FROM s GROUP BY ALL), t AS (SELECT row_id, threshold, avg(ok::INT) AS em FROM m WHERE index % 10 >= 5 GROUP BY ALL)
SELECT b.row_id, CAST(seed AS BIGINT) AS seed, b.threshold, round(val_em, 6) AS val_em, round(t.em, 6) AS test_em FROM b JOIN t ON t.row_id = b.row_id AND t.threshold = b.threshold""")
def q_seed_sweep(spark, d):
    """Thresholds that samples of the validation items choose, and what they give on the others."""
    long = _long(spark, d)
    s = curves.seed_sweep(long.where("index % 10 < 5"), {"test": long.where("index % 10 >= 5")}, _GRID, [0, 1, 42], 300)
    return s.select("row_id", "seed", "threshold", F.round("val_em", 6).alias("val_em"), F.round("test_em", 6).alias("test_em"))


@query()
def q_contour_features(spark, d):
    """Shape features of contours of 32 points, two dimensions of the vectors each, under a fixed arch."""
    points = F.expr("transform(sequence(0, 31), i -> array(cast(i as double) / 31 + 0.01D * get(embedding, 2 * i), cast(get(embedding, 2 * i + 1) as double)))")
    t = np.linspace(0, 1, 40)
    arch = np.stack([t, 0.6 + 0.4 * np.sin(np.pi * t)], axis=1)
    e = table(spark, d, "embeddings").select("vec_id", features_of(points, arch).alias("f"))
    return e.select("vec_id", "f.*")


def _more() -> None:
    """The other modules of queries register theirs when they are imported."""
    from . import answer_queries, format_queries, score_queries  # noqa: F401


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _more()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _more()
    return dict(ORACLES)
