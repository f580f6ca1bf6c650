"""Queries of readers and writers: rows of the provided tables are written in a format and read back through its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fixed
from ..functions.vocabulary import MUSCLES
from ..sources import config, readers, writers
from ..sources.scratch import shared_folder, write_text
from .pool import accepted_draws, interpolated_centers
from .probe_items import drawn_targets, first_acceptable, trainlike_values
from .queries import query, table

k = "o_orderkey"


@query("""SELECT vec_id AS index, 4::BIGINT AS n, round(list_sum(list_transform(embedding[1:12], lambda x: x::DOUBLE)), 5) AS total, vec_id // 100 AS shard FROM embeddings""")
def q_shard_files(spark, d):
    """Big-endian shards of 100 meshes, each after its metadata, read back from bytes."""
    path = shared_folder(spark, "shards")
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("index"), F.expr("transform(sequence(0, 3), i -> slice(embedding, 3 * i + 1, 3))").alias("verts"))
    writers.write_shards(e, e.select("index", F.lit("VALID").alias("label"), F.lit(None).cast("double").alias("vol_ratio")), path, 4, 100)
    rows = readers.read_shards(spark, f"{path}/verts", 4, 100)
    total = F.aggregate(F.flatten(F.transform("verts", lambda v: F.transform(v, lambda x: x.cast("double")))), F.lit(0.0), lambda s, x: s + x)
    return rows.select("index", F.size("verts").cast("long").alias("n"), F.round(total, 5).alias("total"), F.expr("index div 100").alias("shard"))


@query("""WITH s AS (SELECT vec_id // 100 AS shard, count(*) AS n_rows FROM embeddings GROUP BY 1) SELECT shard, n_rows FROM s""")
def q_shard_rows(spark, d):
    """Rows of each shard from its size, the last one short; a .part file is no shard."""
    path = shared_folder(spark, "shards")
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("index"), F.expr("transform(sequence(0, 3), i -> slice(embedding, 3 * i + 1, 3))").alias("verts"))
    writers.write_shards(e, e.select("index"), path, 4, 100)
    write_text(spark, f"{path}/verts/shard_99999.bin.part", "x")
    return readers.shard_rows(spark, f"{path}/verts", 4)


@query("""SELECT vec_id // 100 AS shard, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, count(*) FILTER (WHERE vec_id % 3 <> 0) AS n_known FROM embeddings GROUP BY 1""")
def q_sim_meta_files(spark, d):
    """Metadata beside the shards, one file each, NA read as null."""
    path = shared_folder(spark, "meta")
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("index"))
    cols = [F.lit("VALID").alias("label"), F.lit("").alias("reason"), F.lit(1.0).alias("max_vel"), F.lit(1.0).alias("peak_ramp_vel"), F.when(F.col("index") % 3 != 0, 0.5).alias("vol_ratio"), F.lit(0).alias("n_inverted"), F.lit(0.1).alias("min_elem_vol"), F.lit(1.0).alias("settle_t"), F.lit(2.0).alias("secs")]
    verts = e.select("index", F.expr("array(array(0f, 0f, 0f))").alias("verts"))
    writers.write_shards(verts, e.select("index", *cols), path, 1, 100)
    m = readers.read_sim_meta(spark, f"{path}/meta")
    return m.groupBy(F.expr("index div 100").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum("index").alias("ids"), F.count("vol_ratio").alias("n_known"))


@query("""SELECT o_orderkey AS index, 'spacefill' AS section, round((o_orderkey * 2 % 10) / 10 + 0.00004, 4) AS first, round((o_orderkey * 12 % 10) / 10, 4) AS last FROM orders""")
def q_pool_csv(spark, d):
    """A pool as CSV with 4 decimals for activations, read with its schema."""
    path = shared_folder(spark, "pool")
    o = table(spark, d, "orders").select(F.col(k).alias("index"), F.lit("spacefill").alias("section"), F.lit(None).cast("string").alias("phoneme"), F.lit("spacefill").alias("detail"), F.lit(-1).cast("long").alias("base_index"), F.lit(None).cast("string").alias("delta"), F.lit(3).alias("n_active"), F.lit("").alias("refs"), *[(F.col(k) * (i + 2) % 10 / 10 + (0.00004 if i == 0 else 0.0)).alias(m) for i, m in enumerate(MUSCLES)])
    writers.write_pool(o, path, MUSCLES)
    return readers.read_pool_meta(spark, path).select("index", "section", F.col(MUSCLES[0]).alias("first"), F.col(MUSCLES[-1]).alias("last"))


@query("""SELECT l_orderkey % 211 * 2 + vec_id % 2 AS key, vec_id AS index, round(list_sum(list_transform(embedding[1:12], lambda x: x::DOUBLE)), 5) AS total
FROM embeddings JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON vec_id = l_orderkey WHERE vec_id % 7 = 3""")
def q_shard_lookup(spark, d):
    """Rows of shards by id, each read from its place alone; the ids come from another table."""
    path = shared_folder(spark, "shards")
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("index"), F.expr("transform(sequence(0, 3), i -> slice(embedding, 3 * i + 1, 3))").alias("verts"))
    writers.write_shards(e, e.select("index"), path, 4, 64)
    ids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("index")).distinct().where("index % 7 = 3")
    rows = readers.lookup_shards(spark, f"{path}/verts", 4, ids, 64)
    total = F.aggregate(F.flatten(F.transform("verts", lambda v: F.transform(v, lambda x: x.cast("double")))), F.lit(0.0), lambda s, x: s + x)
    return rows.select((F.col("index") % 211 * 2 + F.col("index") % 2).alias("key"), "index", F.round(total, 5).alias("total"))


_POOL_TEXT = ", ".join(f"round((p_partkey * {i + 2} % 10) / 10, 4) AS \"{m}\"" for i, m in enumerate(MUSCLES))


@query(f"""SELECT p_partkey AS index, {_POOL_TEXT} FROM part""")
def q_pool_text(spark, d):
    """A pool written as text with its notes and read back; what follows the keyframes is no pool."""
    path = shared_folder(spark, "text")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("index"), *[(F.col("p_partkey") * (i + 2) % 10 / 10).alias(m) for i, m in enumerate(MUSCLES)])
    writers.write_pool_text(rows, path, MUSCLES, ["pool of parts", "metadata by index"], ["", "# Keyframe sequences below", "9 9 9"])
    return readers.read_pool_text(spark, path)


_RECORDS = """SELECT o_orderkey AS index, CASE WHEN o_orderkey % 2 = 0 THEN 'physics_chain' ELSE 'shape_desc' END AS scenario, o_orderkey // 1000 AS shard, 'é "' || o_custkey || '"' AS said FROM orders"""


def _records(spark, d):
    turn = F.array(F.struct(F.lit("gpt").alias("from"), F.concat(F.lit('é "'), F.col("o_custkey").cast("string"), F.lit('"')).alias("value")))
    return table(spark, d, "orders").select(F.col(k).alias("index"), F.when(F.col(k) % 2 == 0, "physics_chain").otherwise("shape_desc").alias("scenario"), turn.alias("conversations"), F.expr(f"{k} div 1000").alias("verts_shard"))


@query(_RECORDS)
def q_record_files(spark, d):
    """Records as JSON lines by shard; a second run writes only the shards that are missing; broken lines are skipped."""
    path = shared_folder(spark, "records")
    r = _records(spark, d)
    writers.write_records(r.where("verts_shard <> 1"), path)
    writers.write_records(r, path)
    write_text(spark, f"{path}/verts_shard=0/more.json", '{"index": 5, "scena\nnot json\n')
    out = readers.read_records(spark, path)
    return out.where("index is not null and scenario is not null").select("index", "scenario", F.regexp_extract(F.col("_metadata.file_path"), r"verts_shard=(\d+)", 1).cast("long").alias("shard"), F.get("conversations", F.lit(0))["value"].alias("said"))


@query("""SELECT o_orderkey AS index, CASE WHEN o_orderkey % 2 = 0 THEN 'physics_chain' ELSE 'shape_desc' END AS scenario, form FROM orders, (SELECT unnest(['array', 'lines']) AS form)""")
def q_records_any(spark, d):
    """All records as one JSON array, and as JSON lines that stand in for a pattern without files."""
    path = shared_folder(spark, "any")
    r = _records(spark, d).select("index", "scenario")
    writers.write_json_array(r, f"{path}/array", "index")
    writers.write_json_lines(r, f"{path}/lines")
    found = config.first_files(spark, f"{path}/natural/*.json", f"{path}/lines/*.json")
    both = readers.read_records_any(spark, f"{path}/array", "index long, scenario string").withColumn("form", F.lit("array"))
    return both.unionByName(readers.read_records(spark, found, "index long, scenario string").select("index", "scenario", F.lit("lines").alias("form")))


@query("""SELECT doc_id AS index, CASE WHEN doc_id % 10 = 0 THEN 'val' WHEN doc_id % 10 = 1 THEN 'test' ELSE 'train' END AS split FROM documents""")
def q_split_files(spark, d):
    path = shared_folder(spark, "splits")
    s = F.when(F.col("doc_id") % 10 == 0, "val").when(F.col("doc_id") % 10 == 1, "test").otherwise("train")
    writers.write_splits(table(spark, d, "documents").select(F.col("doc_id").alias("index"), s.alias("split")), path)
    out = None
    for name in ("train", "val", "test"):
        own = readers.read_split(spark, f"{path}/split={name}", name)
        out = own if out is None else out.unionByName(own)
    return out


@query("""WITH v AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS id, s_suppkey % 5 AS x, s_nationkey AS y FROM supplier), n AS (SELECT count(*) AS n FROM supplier)
SELECT 'vertex' AS kind, id - 1 AS id, x::DOUBLE AS a, y::DOUBLE AS b FROM v UNION ALL SELECT 'face', id, (id - 1)::DOUBLE, id::DOUBLE FROM (SELECT unnest(range(1, n)) AS id FROM n)""")
def q_obj_files(spark, d):
    """A mesh written as OBJ, numbered from 1, and read back from 0."""
    path = shared_folder(spark, "obj")
    s = table(spark, d, "supplier")
    n = s.count()
    v = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    f = spark.range(1, n).select(F.col("id").alias("polygon"), F.lit(0).alias("part"), (F.col("id") - 1).cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(0).alias("k"))
    writers.write_obj(v, f, path)
    vertices, faces = readers.read_obj(spark, path)
    a = vertices.select(F.lit("vertex").alias("kind"), F.col("id").cast("long").alias("id"), F.col("x").alias("a"), F.col("y").alias("b"))
    return a.unionByName(faces.select(F.lit("face").alias("kind"), (F.col("polygon") + 1).cast("long").alias("id"), F.col("i").cast("double").alias("a"), F.col("j").cast("double").alias("b")))


@query("""SELECT 'k' || p_partkey AS key, p_brand AS val FROM part WHERE p_partkey % 10 <> 0""")
def q_key_values(spark, d):
    """Lines with spaces around, without an equals sign, and with more than one value."""
    path, p = shared_folder(spark, "kv"), F.col("p_partkey")
    said = F.concat(F.lit(" k"), p.cast("string"), F.lit(" = "), "p_brand", F.lit(" trailing"))
    writers.write_table_text(table(spark, d, "part"), path, ["# info"], "p_partkey", F.when(p % 10 != 0, said).otherwise(F.lit("no value here")))
    return readers.read_key_values(spark, path)


@query("""SELECT 'k' || c_custkey AS key, c_mktsegment AS ipa FROM customer""")
def q_centers_csv(spark, d):
    """A table that begins with a byte order mark."""
    path = shared_folder(spark, "bom")
    line = F.concat(F.lit("k"), F.col("c_custkey").cast("string"), F.lit(","), "c_mktsegment")
    writers.write_table_text(table(spark, d, "customer"), path, ["\ufeffkey,ipa"], "c_custkey", line)
    return readers.read_centers(spark, path).select("key", "ipa")


@query("""SELECT vec_id AS index, round(round_even(embedding[1]::DOUBLE * 1000, 2), 2) + 0 AS a, round(round_even(embedding[2]::DOUBLE * 1000, 2), 2) + 0 AS b FROM embeddings""")
def q_region_mm(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("index"), F.get("embedding", F.lit(0)).alias("a"), F.get("embedding", F.lit(1)).alias("b"))
    return readers.read_region_mm(e, ["a", "b"]).select("index", (F.col("a") + 0).alias("a"), (F.col("b") + 0).alias("b"))


@query("""SELECT p_partkey AS index, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END::INT AS n, CASE WHEN p_size % 2 <> 0 THEN p_retailprice END AS price FROM part WHERE p_partkey % 3 <> 0""")
def q_properties(spark, d):
    """Wanted features that are known, of meshes that are ok."""
    c = F.col
    p = table(spark, d, "part").select(c("p_partkey").alias("index"), (c("p_partkey") % 3 != 0).alias("feat_ok"), F.create_map(F.lit("size"), c("p_size").cast("double"), F.lit("price"), F.when(c("p_size") % 2 != 0, c("p_retailprice")), F.lit("other"), F.lit(1.0)).alias("features"))
    return readers.properties(p, ["size", "price"]).select("index", F.size("features").alias("n"), F.try_element_at("features", F.lit("price")).alias("price"))


@query("""SELECT 'u' || l_orderkey AS uid, arg_max('x' || l_quantity::INT, round(l_extendedprice * 100)::BIGINT * 100 + l_quantity::BIGINT) AS text FROM lineitem GROUP BY l_orderkey""")
def q_last_answers(spark, d):
    c = F.col
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("u"), c("l_orderkey").cast("string")).alias("uid"), F.concat(F.lit("x"), c("l_quantity").cast("int").cast("string")).alias("text"), (F.round(c("l_extendedprice") * 100).cast("long") * 100 + c("l_quantity").cast("long")).alias("at"))
    return readers.last_answers(rows, "uid", "text", "at")


@query("""SELECT p_partkey AS k, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_partkey""")
def q_cached_index(spark, d):
    """An index table that is built once and read from then on."""
    path = shared_folder(spark, "index")
    build = lambda: table(spark, d, "part").where("p_size > 10").groupBy(F.col("p_partkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    writers.cached_index(path, build, spark)
    return writers.cached_index(path, lambda: build().limit(0), spark)


# Pools and probe items with choices by md5, which other engines have too


@query(f"""WITH c AS (SELECT n_nationkey AS i, 'p' || n_nationkey AS ipa, list_transform(range(0, 11), lambda m: (n_nationkey * (m + 1) % 8) / 10) AS act FROM nation)
SELECT a.ipa || '~' || b.ipa AS phoneme, 'interp:' || a.ipa || '~' || b.ipa || '@' || printf('%.2f', t) AS detail, round(list_sum(list_transform(range(1, 12), lambda m: (1 - t) * a.act[m] + t * b.act[m])), 6) AS total
FROM c a JOIN c b ON a.i < b.i, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS t)""")
def q_interpolated_centers(spark, d):
    """Points on the way between all pairs of centres."""
    n = F.col("n_nationkey")
    c = table(spark, d, "nation").select(F.concat(F.lit("p"), n.cast("string")).alias("phoneme"), F.array(*[(n * (m + 1) % 8 / 10) for m in range(11)]).alias("act"), n.alias("place"))
    r = interpolated_centers(c, "place")
    return r.select("phoneme", "detail", F.round(F.aggregate("act", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""WITH b AS (SELECT unnest(range(1, 8)) AS draw), x AS (SELECT p_partkey AS id, draw, (p_partkey * draw * 7 % 10) / 10 AS a, (p_partkey + draw * 3) % 10 / 10 AS b FROM part, b)
SELECT id, CAST(min(draw) AS INT) AS draw FROM x WHERE a BETWEEN 0.3 - 1e-6 AND 0.6 + 1e-6 AND b BETWEEN 0 - 1e-6 AND 0.5 + 1e-6 GROUP BY id""")
def q_accepted_draws(spark, d):
    """The first of several draws that lies in all bands of its rule; none where no draw does."""
    p = F.col("p_partkey")
    draws = table(spark, d, "part").select(p.alias("id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("draw"))
    other = [F.lit(0.0)] * 9
    draws = draws.select("id", "draw", F.array(F.col("id") * F.col("draw") * 7 % 10 / 10, (F.col("id") + F.col("draw") * 3) % 10 / 10, *other).alias("act"))
    return accepted_draws(draws, {MUSCLES[0]: (0.3, 0.6), MUSCLES[1]: (0.0, 0.5)}).select("id", "draw")


_HASH = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"


@query(f"""WITH f AS (SELECT p_partkey AS index, 'size' AS quantity, p_size::DOUBLE AS value FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_partkey % 3 <> 0),
r AS (SELECT p_partkey AS index, q AS quantity, (p_partkey * n % 11 - 5)::DOUBLE AS value FROM part, (SELECT unnest(['front_dx', 'mid_dx', 'back_dx']) AS q, unnest([3, 5, 7]) AS n) WHERE abs(p_partkey * n % 11 - 5) >= 2),
u AS (SELECT *, 'feature' AS kind FROM f UNION ALL SELECT *, 'region' FROM r),
k AS (SELECT index, bool_or(kind = 'feature') AND (NOT bool_or(kind = 'region') OR {_HASH.format("index || ':kind'")} < 0.7 * 4294967296) AS feature FROM u GROUP BY index)
SELECT u.index, arg_min(quantity, md5(u.index || ':' || quantity)) AS quantity, arg_min(value, md5(u.index || ':' || quantity)) AS value FROM u JOIN k ON u.index = k.index AND (kind = 'feature') = feature GROUP BY u.index""")
def q_trainlike_values(spark, d):
    """One value to ask for of each mesh: a feature in 70 % of those that have both, else a region's motion."""
    p = F.col("p_partkey")
    parts = table(spark, d, "part")
    pair = lambda q, v: F.struct(F.lit(q).alias("quantity"), v.cast("double").alias("value"))
    features = parts.where(p % 3 != 0).select(p.alias("index"), F.explode(F.array(pair("size", F.col("p_size")), pair("price", F.col("p_retailprice")))).alias("v")).select("index", "v.*")
    motion = parts.select(p.alias("index"), F.explode(F.array(*[pair(q, p * n % 11 - 5) for q, n in (("front_dx", 3), ("mid_dx", 5), ("back_dx", 7))])).alias("v")).select("index", "v.*")
    return trainlike_values(features, motion.where("abs(value) >= 2")).select("index", "quantity", "value")


@query("""WITH c AS (SELECT p_partkey AS index, m, (p_partkey * m % 5 <> 0) AS ok, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(p_partkey || ':' || m), m) AS r FROM part, (SELECT unnest(range(1, 23)) AS m))
SELECT index, CAST(arg_min(m, r) AS INT) AS candidate FROM c WHERE ok AND r <= 8 GROUP BY index""")
def q_first_acceptable(spark, d):
    """Of the first candidates in hash order the first one that is acceptable."""
    c = table(spark, d, "part").select(F.col("p_partkey").alias("index"), F.explode(F.sequence(F.lit(1), F.lit(22))).alias("candidate"))
    return first_acceptable(c.withColumn("ok", F.col("index") * F.col("candidate") % 5 != 0), "index", "candidate", "ok", 8).select("index", "candidate")


@query(f"""WITH t AS (SELECT unnest(range(0, 7)) AS t), x AS (SELECT p_partkey AS index, a.n AS attempt, {_HASH.format("p_partkey || ':' || a.n")} % 7 AS t FROM part, (SELECT unnest(range(0, 6)) AS n) a),
o AS (SELECT *, p.t <> p.index % 7 AND p.t <> (p.index + 1) % 7 AS useful FROM x p) SELECT index, CAST(coalesce(arg_min(t, attempt) FILTER (WHERE useful), arg_max(t, attempt)) AS BIGINT) AS target FROM o GROUP BY index""")
def q_drawn_targets(spark, d):
    """A target drawn again up to five times while there is nothing to correct."""
    meshes = table(spark, d, "part").select(F.col("p_partkey").alias("index"))
    targets = spark.range(7).select(F.col("id").alias("target"))
    useful = meshes.crossJoin(F.broadcast(targets)).where("target <> index % 7 and target <> (index + 1) % 7")
    return drawn_targets(meshes, 7, useful, 5)

