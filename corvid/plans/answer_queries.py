"""Queries of the answer parsers and of whole score tables: texts vary by row, and the SQL follows the rules of the parsers' cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.parsers import corrections_of
from ..operators import probe, records, surface
from ..operators.token_spans import Collation, collate, pattern_tokens
from ..sources import line_index
from ..sources.scratch import shared_folder
from . import probe_items, scoring
from .queries import query, table
from .score_queries import _list, _m, _orders, _pick, _probe_items, _sm, _sql_pick, k

_UP, _DOWN = ["raise", "activate", "tighten"], ["lower", "release", "relax"]
_KO = [n.partition("(")[0] for n in V.FULL_NAMES["ko"].values()]


def _near_items(spark, d):
    """'raise xxx GGP xxx lower': how far both verbs are follows from the key."""
    gap = lambda n: F.repeat(F.lit("x"), (1 + n).cast("int"))
    text = F.concat_ws(" ", _pick(_UP, k), gap(k % 53), _m(k), gap((k * 7) % 61), _pick(_DOWN, k + 1))
    return _orders(spark, d).select(F.concat(F.lit("n"), k.cast("string")).alias("uid"), F.when(k % 3 > 0, F.array(_m(k))).otherwise(F.array().cast("array<string>")).alias("gold_inc"), F.when(k % 3 == 0, F.array(_m(k))).otherwise(F.array().cast("array<string>")).alias("gold_dec"), text.alias("pred"))


# A verb counts if it lies whole in the 45 characters before the mention or after it; the nearer begin wins, more before less.
_NEAR_SQL = f"""t AS (SELECT o_orderkey AS k, {_sm("o_orderkey")} AS m, length({_sql_pick(_UP, "o_orderkey")}) + o_orderkey % 53 + 3 AS a, {_sm("o_orderkey")} AS name, o_orderkey * 7 % 61 + 1 AS gap, length({_sql_pick(_DOWN, "o_orderkey + 1")}) AS down FROM orders),
e AS (SELECT k, m, CASE WHEN a <= 45 THEN a END AS up_at, CASE WHEN gap + 2 + down <= 45 THEN length(m) + gap + 2 END AS down_at FROM t),
c AS (SELECT k, m, CASE WHEN up_at IS NULL AND down_at IS NULL THEN NULL WHEN down_at IS NULL OR up_at <= down_at THEN 'inc' ELSE 'dec' END AS tag, CASE WHEN k % 3 > 0 THEN 'inc' ELSE 'dec' END AS gold FROM e)"""


@query(f"""WITH {_NEAR_SQL}, s AS (SELECT count_if(tag = gold) AS tp, count_if(tag <> gold) AS fp, count_if(tag IS NULL OR tag <> gold) AS fn, count(*) AS n FROM c)
SELECT x.name, round(x.value, 6) AS value FROM (SELECT unnest([{{'name': 'tp', 'value': tp::DOUBLE}}, {{'name': 'fp', 'value': fp}}, {{'name': 'fn', 'value': fn}}, {{'name': 'n', 'value': n}}, {{'name': 'n_exact', 'value': tp}},
{{'name': 'precision', 'value': tp / (tp + fp)}}, {{'name': 'recall', 'value': tp / (tp + fn)}}, {{'name': 'f1', 'value': 2 * tp / (2 * tp + fp + fn)}}]) AS x FROM s)""")
def q_nearest_corrections(spark, d):
    """Answers that only the nearest verb reads, some out of its reach; the metric is found by its name."""
    return scoring.score(_near_items(spark, d), ["correction_sign_f1"]).select("name", F.round("value", 6).alias("value"))


_SOV = ["{a}, {b} 더 수축하고, {c} 이완", "{c} 이완. {a}와 {b} 증가", "{a} 올려; {b} 활성, {c} 감소"]


def _korean_items(spark, d):
    names = {x: _pick(_KO, k + n) for x, n in (("a", 0), ("b", 3), ("c", 5))}
    text = F.lit(None).cast("string")
    for i, form in enumerate(_SOV):
        parts = []
        for piece in form.replace("{", "|{").replace("}", "}|").split("|"):
            parts.append(names[piece[1]] if piece.startswith("{") else F.lit(piece))
        text = F.when((k.cast("long") / 11).cast("long") % len(_SOV) == i, F.concat(*parts)).otherwise(text)
    return _orders(spark, d).select(k.alias("k"), text.alias("pred"))


@query(f"""SELECT o_orderkey AS k, array_to_string(list_sort([{_sm("o_orderkey")} || ':inc', {_sm("o_orderkey + 3")} || ':inc', {_sm("o_orderkey + 5")} || ':dec']), ',') AS pairs FROM orders""")
def q_korean_corrections(spark, d):
    """Verbs after their muscles: what stands before a verb, up to the clause or the opposite verb before it."""
    said = F.map_entries(corrections_of(F.col("pred")))
    return _korean_items(spark, d).select("k", F.array_join(F.array_sort(F.transform(said, lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), ",").alias("pairs"))


@query("""SELECT kind, CASE WHEN kind IN ('prescriptive', 'correction') THEN 'prescriptive' WHEN kind = 'rest_desc' THEN 'rest_desc' ELSE 'b2' END AS part, count(*) AS n
FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'prescriptive' WHEN 1 THEN 'correction' WHEN 2 THEN 'rest_desc' WHEN 3 THEN 'b2' WHEN 4 THEN 'new kind' ELSE 'b2' END AS kind FROM orders) GROUP BY kind""")
def q_direction_kinds(spark, d):
    """Which scorer an item of a kind goes to; items without one are axes."""
    kind = F.coalesce(_pick(["prescriptive", "correction", "rest_desc", "b2", "new kind"], k % 6).alias("kind"), F.lit("b2"))
    own = _orders(spark, d).select(F.when(k % 6 < 5, kind).otherwise("b2").alias("kind"))
    return own.withColumn("part", probe.direction_part(F.col("kind"))).groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT o_orderkey AS k, floor(o_totalprice / 10) / 100 AS gold, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(printf('%.2f', floor(o_totalprice / 10) / 100 + (o_orderkey % 7 - 3)) AS DOUBLE) END AS said,
CASE WHEN o_orderkey % 11 = 0 THEN 2.5::DOUBLE WHEN o_orderkey % 2 = 0 THEN 0.03 WHEN o_orderkey % 3 = 0 THEN 0.1 ELSE 2 END AS tol, CASE WHEN o_orderkey % 2 = 0 THEN 'cd_min' ELSE 'length' END AS quantity FROM orders),
s AS (SELECT 'per_quantity.' || quantity AS part, count(*) AS n, count_if(coalesce(abs(said - gold) <= tol, false)) AS ok FROM v GROUP BY 1 UNION ALL SELECT 'per_n_act.', count(*), count_if(coalesce(abs(said - gold) <= tol, false)) FROM v)
SELECT part || '.' || x.name AS name, round(x.value, 6) AS value FROM (SELECT part, unnest([{'name': 'n', 'value': n::DOUBLE}, {'name': 'n_correct', 'value': ok}, {'name': 'accuracy', 'value': ok / n}]) AS x FROM s)""")
def q_value_parts(spark, d):
    """The probe's value accuracy by bin of active muscles and by quantity, out of the whole score table."""
    s = scoring.score_probe(_probe_items(spark, d))
    return s.where("metric = 'value_acc' and name like 'per_%'").select("name", F.round("value", 6).alias("value"))


@query(f"""WITH {_NEAR_SQL}, g AS (SELECT count_if(tag = gold) AS tp, count_if(tag <> gold) AS fp, count_if(tag IS NULL OR tag <> gold) AS fn FROM c)
SELECT 'scores' AS kind, 'f1' AS name, round(2 * tp / (2 * tp + fp + fn), 6) AS value FROM g UNION ALL
SELECT 'payload', 'n', count_if(o_orderkey % 4 <> 0) FROM orders UNION ALL SELECT 'payload', 'grounded', count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 4 <> 0
UNION ALL SELECT 'signs', 'accuracy', round(avg((o_orderkey % 4 = o_orderkey % 3)::INT), 6) FROM orders""")
def q_score_sets(spark, d):
    """Signs and diagnoses through the one entry for all sets; answers with a grounding are what a judge sees."""
    more = table(spark, d, "orders").select(F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("uid"), F.col("o_orderkey").alias("index"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey").cast("string")).alias("judge_grounding"))
    items = _near_items(spark, d).join(more, "uid").withColumn("question", F.lit("Which muscles?"))
    scores, judged = scoring.score_set("diagnoses", items, None)
    said = _pick(["It is super-additive, not additive.", "The pair is subadditive; roughly linear", "equal to the sum", "no idea"], k)
    signs, _ = scoring.score_set("signs", _orders(spark, d).select(_pick(["+", "-", "0"], k).alias("gold"), said.alias("pred")), None, names=["sign_acc"])
    out = scores.where("name = 'f1'").select(F.lit("scores").alias("kind"), "name", F.round("value", 6).alias("value"))
    n = judged.agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_distinct("grounding").cast("double").alias("grounded"))
    out = out.unionByName(n.select(F.lit("payload").alias("kind"), F.lit("n").alias("name"), F.col("n").alias("value"))).unionByName(n.select(F.lit("payload").alias("kind"), F.lit("grounded").alias("name"), F.col("grounded").alias("value")))
    return out.unionByName(signs.where("name = 'accuracy'").select(F.lit("signs").alias("kind"), "name", F.round("value", 6).alias("value")))


# Interventions: all numbers are multiples of 1/8, so distances are exact in any order of summing.
_EDITS = (0.25, -0.25, 0.125, -0.125)
_ACT = "list_transform(range(0, 11), lambda m: ((s_suppkey * (m + 3) + s_nationkey * m) % 9) / 8)"
_FMB_SQL = ", ".join(f"{{'dx': ((s_suppkey * {a} + s_nationkey) % 13 - 6) / 4, 'dz': ((s_suppkey * {b} + s_nationkey) % 11 - 5) / 4}}" for a, b in ((3, 5), (7, 2), (4, 9)))


@query(f"""WITH p AS (SELECT s_suppkey AS i, {_ACT} AS act, [{_FMB_SQL}] AS mm FROM supplier),
e AS (SELECT i, act, mm, m, d, act[m + 1] + d AS too, {_list(V.MUSCLES)}[m + 1] AS muscle FROM p, (SELECT unnest(range(0, 11)) AS m), (SELECT unnest([0.25, -0.25, 0.125, -0.125])::DOUBLE AS d)),
t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY md5(i || ':' || muscle || ':' || d), muscle, d) AS r, list_transform(range(0, 11), lambda x: CASE WHEN x = m THEN too ELSE act[x + 1] END) AS goal FROM e WHERE too BETWEEN 0 AND 1),
n AS (SELECT t.i, r, arg_min(p.i, list_sum(list_transform(range(1, 12), lambda x: (goal[x] - p.act[x]) * (goal[x] - p.act[x]))) * 1e6 + p.i) AS j FROM t JOIN p ON p.i <> t.i WHERE r <= 40 GROUP BY t.i, r),
g AS (SELECT t.i, t.r, muscle, d, j, list_transform(range(1, 4), lambda x: {{'dx': q.mm[x].dx - t.mm[x].dx, 'dz': q.mm[x].dz - t.mm[x].dz}}) AS v FROM t JOIN n ON n.i = t.i AND n.r = t.r JOIN p q ON q.i = j),
b AS (SELECT *, list_position(list_transform(v, lambda x: x.dx * x.dx + x.dz * x.dz), list_max(list_transform(v, lambda x: x.dx * x.dx + x.dz * x.dz))) AS top FROM g),
k AS (SELECT *, v[top].dx AS dx, v[top].dz AS dz FROM b WHERE abs(v[top].dx) >= 0.5 OR abs(v[top].dz) >= 0.5)
SELECT i AS index, arg_min(muscle, r) AS muscle, arg_min(d, r) AS delta, arg_min(j, r) AS base_mesh, arg_min(['front', 'mid', 'back'][top], r) AS region,
arg_min(concat_ws('+', CASE WHEN dx >= 0.5 THEN 'advance' WHEN dx <= -0.5 THEN 'retract' END, CASE WHEN dz >= 0.5 THEN 'elevate' WHEN dz <= -0.5 THEN 'descend' END), r) AS directions, round(arg_min(dx, r) + arg_min(dz, r), 2) AS moved FROM k GROUP BY i""")
def q_interventions(spark, d):
    """The first edit of one muscle whose nearest mesh moves a region, of up to 40 edits a mesh."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    act = F.array(*[((s * (m + 3) + n * m) % 9) / 8 for m in range(11)])
    mm = lambda a, b: F.struct((((s * a + n) % 13 - 6) / 4).alias("dx"), (((s * b + n) % 11 - 5) / 4).alias("dz"))
    rows = table(spark, d, "supplier").select(s.alias("index"), act.alias("act"), F.struct(mm(3, 5).alias("front"), mm(7, 2).alias("mid"), mm(4, 9).alias("back")).alias("region_mm"))
    out = probe_items.interventions(rows, rows, rows, _EDITS)
    return out.select("index", "muscle", "delta", "base_mesh", "region", F.array_join("directions", "+").alias("directions"), F.round(F.col("dx") + F.col("dz"), 2).alias("moved"))


# Training rows

_CHAT = """t AS (SELECT conv_id, turn, role, coalesce(text, '') AS v, length('<|im_start|>') + length(role) + 1 AS head FROM conversations),
p AS (SELECT *, CAST(coalesce(sum(head + length(v) + 11) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + head AS s, '<|im_start|>' || role || chr(10) || v || '<|im_end|>' || chr(10) AS piece,
row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS back FROM t),
c AS (SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS text FROM p GROUP BY conv_id)"""


@query(f"""WITH {_CHAT}, k AS (SELECT conv_id, unnest(regexp_extract_all(text, '[\\s]+|[^\\s]+')) AS tok, generate_subscripts(regexp_extract_all(text, '[\\s]+|[^\\s]+'), 1) AS i FROM c),
o AS (SELECT conv_id, i, CAST(sum(length(tok)) OVER (PARTITION BY conv_id ORDER BY i) AS BIGINT) AS e, length(tok) AS n FROM k),
a AS (SELECT conv_id, s, s + length(v) + 10 AS e, s + length(regexp_extract(v, '^[^\\s]+')) AS fact FROM p WHERE role = 'assistant' AND back = 1),
x AS (SELECT o.conv_id, count(*) AS n_tokens, coalesce(count_if(o.e > a.s AND o.e - n < a.e), 0) AS n_on, coalesce(count_if(a.fact > a.s AND o.e > a.s AND o.e - n < a.fact), 0) AS n_fact FROM o LEFT JOIN a ON a.conv_id = o.conv_id GROUP BY o.conv_id)
SELECT conv_id, n_tokens, CAST(n_on AS BIGINT) AS n_on, CAST(n_fact AS BIGINT) AS n_fact, round(n_on - n_fact + n_fact * CASE WHEN n_fact > 0 AND n_on > n_fact THEN least(20, greatest(1, (1 - n_fact / n_on) / (n_fact / n_on) * 0.3 / 0.7)) ELSE 1 END, 5) AS weight FROM x""")
def q_token_spans(spark, d):
    """Chats in the space of tokens: the last answer is supervised, its first word is a fact that gets 30 % of the loss."""
    c = F.col
    turn = F.struct(c("turn"), c("role"), F.coalesce("text", F.lit("")).alias("value"))
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    talks = talks.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["value"].alias("value"))).alias("turns"))
    talks = talks.withColumn("chat", records.chat(F.col("turns"))).withColumn("text", F.col("chat.text")).withColumn("answers", records.located(F.col("text"), F.col("turns")))
    said = F.filter("turns", lambda t: t["role"] == "assistant")
    word = F.transform(said, lambda t: F.regexp_extract(t["value"], r"^[^\s]+", 0))
    facts = F.transform(word, lambda w: F.filter(F.array(F.struct(F.lit("word").alias("type"), w.alias("value"), F.lit(0).alias("start"), F.length(w).alias("end"))), lambda f: f["end"] > 0))
    rows = talks.withColumn("word_facts", facts).withColumn("facts", records.facts_in_chat(F.col("text"), F.col("answers"), F.col("word_facts"), ["word"]))
    how = Collation(end_mark=10, last_only=True, share=1.0, target=0.3, max_len=1 << 40)
    made = collate(rows, "conv_id", "text", "answers", "facts", lambda: pattern_tokens(r"[\t\n\f\r ]+|[^\t\n\f\r ]+"), how)
    on = F.filter("labels", lambda x: x != -100)
    n_fact = F.size(F.filter(F.arrays_zip("labels", "weights"), lambda z: (z["labels"] != -100) & (z["weights"] != 1.0)))
    return made.select("conv_id", F.size("ids").cast("long").alias("n_tokens"), F.size(on).cast("long").alias("n_on"), n_fact.cast("long").alias("n_fact"), F.round(F.aggregate("weights", F.lit(0.0), lambda s, x: s + x), 5).alias("weight"))


_LINE = "'{\"index\": ' || o_orderkey || ', \"scenario\": \"' || CASE WHEN o_orderkey % 7 = 0 THEN 'skip' ELSE 'chain' END || '\", \"conversations\": [{\"from\": \"gpt\", \"value\": \"é' || o_custkey || '\"}' || CASE WHEN o_orderkey % 3 = 0 THEN ', {\"from\": \"gpt\", \"value\": \"more\"}' ELSE '' END || ']}'"


@query(f"""WITH l AS (SELECT o_orderkey AS k, o_orderkey % 4 AS file, o_custkey, {_LINE} AS line FROM orders),
o AS (SELECT *, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM l),
e AS (SELECT file, place, k, o_custkey, unnest(range(0, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END)) AS turn FROM o WHERE k % 7 <> 0 AND k % 5 <> 1),
n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY place, turn) AS r FROM e)
SELECT CAST(file AS INT) AS file, place, CAST(turn AS INT) AS turn, row_number() OVER (ORDER BY r, file) - 1 AS position, 'é' || o_custkey AS said FROM n""")
def q_qa_index(spark, d):
    """Entries of four files of JSON lines in turns, filtered by scenario and split, and the lines read again by their offsets."""
    path = shared_folder(spark, "lines")
    key = F.col("o_orderkey")
    more = F.when(key % 3 == 0, ', {"from": "gpt", "value": "more"}').otherwise("")
    parts = [F.lit('{"index": '), key.cast("string"), F.lit(', "scenario": "'), F.when(key % 7 == 0, "skip").otherwise("chain"), F.lit('", "conversations": [{"from": "gpt", "value": "é'), F.col("o_custkey").cast("string"), F.lit('"}'), more, F.lit("]}")]
    lines = table(spark, d, "orders").select((key % 4).cast("int").alias("file"), key.alias("k"), F.concat(*parts).alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "k").select("file", "value").write.partitionBy("file").text(path)
    allowed = table(spark, d, "orders").where(key % 5 != 1).select(key.alias("index"))
    found, files = line_index.qa_index(spark, f"{path}/file=*/part-*", allowed, exclude=["skip"], span=100_000)
    rows = line_index.read_entries(found, files, f"{path}/file=*/part-*")
    return rows.select("file", F.col("offset").alias("place"), "turn", "position", F.get("r.conversations", F.lit(0))["value"].alias("said"))


# Surfaces: sheets of 4 x 4 squares, two triangles each, so that the nearest face follows from a point's square.


@query("""WITH p AS (SELECT c_custkey AS point, c_nationkey AS mesh, 1 + c_nationkey % 3 AS s, 4 * (1 + c_custkey % 96) / 97 AS x, 4 * (1 + c_custkey * 7 % 88) / 89 AS y, round(c_acctbal / 100) / 8 AS z FROM customer),
q AS (SELECT *, CAST(floor(x) AS BIGINT) AS cx, CAST(floor(y) AS BIGINT) AS cy, x - floor(x) AS fx, y - floor(y) AS fy FROM p)
SELECT mesh, point, 2 * (cy * 4 + cx) + (fx + fy > 1)::INT AS face, round(abs(z), 6) AS distance, round(CASE WHEN fx + fy > 1 THEN 1 - fy ELSE 1 - fx - fy END, 6) AS wi FROM q""")
def q_nearest_surface(spark, d):
    """Customers as points above the sheet of their nation: the nearest face, its distance and the weight of its first corner."""
    c = table(spark, d, "customer")
    scale = 1 + F.col("mesh") % 3
    meshes = c.select(F.col("c_nationkey").alias("mesh")).distinct()
    grid = meshes.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(24))))
    vertices = grid.select("mesh", "id", (F.col("id") % 5 * scale).cast("double").alias("x"), (F.floor(F.col("id") / 5) * scale).cast("double").alias("y"), F.lit(0.0).alias("z"))
    cells = meshes.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("a", (F.floor(F.col("cell") / 4) * 5 + F.col("cell") % 4).cast("int"))
    faces = cells.select("mesh", F.explode(F.array(F.struct((2 * F.col("cell")).alias("face"), F.col("a").alias("i"), (F.col("a") + 1).alias("j"), (F.col("a") + 5).alias("k")), F.struct((2 * F.col("cell") + 1).alias("face"), (F.col("a") + 1).alias("i"), (F.col("a") + 6).alias("j"), (F.col("a") + 5).alias("k")))).alias("f")).select("mesh", "f.*")
    key = F.col("c_custkey")
    points = c.select(F.col("c_nationkey").alias("mesh"), key.alias("point"), (4 * (1 + key % 96) / 97).alias("x"), (4 * (1 + key * 7 % 88) / 89).alias("y"), (F.round(F.col("c_acctbal") / 100) / 8).alias("z"))
    points = points.withColumns({"x": F.col("x") * scale, "y": F.col("y") * scale})
    found = surface.nearest_on_surface(points, vertices, faces)
    return found.select("mesh", "point", "face", F.round("distance", 6).alias("distance"), F.round("wi", 6).alias("wi"))
