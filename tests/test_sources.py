import numpy as np
from pyspark.sql import functions as F

from corvid.functions.vocabulary import MUSCLES
from corvid.sources import readers, writers
from corvid.streaming.resume import first_settled, process_new, windowed_counts


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{folder}/{name}"


def test_shards_round_trip(spark, tmp_path):
    m = np.arange(5 * 4 * 3, dtype=">f4").reshape(5, 4, 3)
    put(tmp_path, "shard_00000.bin", m[:3].tobytes())
    put(tmp_path, "shard_00001.bin", m[3:].tobytes())
    put(tmp_path, "shard_00002.bin.part", b"junk")
    got = {r["index"]: np.array(r.verts) for r in readers.read_shards(spark, f"file://{tmp_path}", 4, shard_size=3).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and all((got[i] == m[i]).all() for i in got)
    assert sorted(map(tuple, readers.shard_rows(spark, f"file://{tmp_path}", 4).collect())) == [(0, 3), (1, 2)]


def test_metadata_and_pool(spark, tmp_path):
    path = put(tmp_path / "meta", "shard_00000.csv", "index,label,reason,max_vel,peak_ramp_vel,vol_ratio,n_inverted,min_elem_vol,settle_t,secs\n0,VALID,,0.1,0.2,NA,NA,0.5,1.0,2.0\n1,FAILED,x,-1,-1,1.0,2,0.5,1,2\n")
    rows = readers.read_sim_meta(spark, path).orderBy("index").collect()
    assert rows[0].vol_ratio is None and rows[0].n_inverted is None and rows[1].n_inverted == 2
    text = "# comment\n\nindex GGP STY\n0 0.0 0.5\n1, 0.25, 0.0\n# Keyframe sequences\n2 9 9\n"
    pool = readers.read_pool_text(spark, put(tmp_path, "pool.txt", text)).orderBy("index").collect()
    assert [(r["index"], r.GGP, r.STY, r.HG) for r in pool] == [(0, 0.0, 0.5, None), (1, 0.25, 0.0, None)]
    bare = readers.read_pool_text(spark, put(tmp_path, "bare.txt", "7 " + " ".join(["0.1"] * 11) + "\n")).first()
    assert bare["index"] == 7 and all(bare[m] == 0.1 for m in MUSCLES)
    out = f"file://{tmp_path}/pool_out"
    writers.write_pool(spark.createDataFrame([(1, 0.12345, 1234.5)], "index long, GGP double, STY double"), out, ["GGP", "STY"])
    assert spark.read.csv(out, header=True).first().asDict() == {"index": "1", "GGP": "0.1235", "STY": "1234.5000"}


def test_obj_round_trip_with_fans(spark, tmp_path):
    path = put(tmp_path, "m.obj", "# mesh\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0.5\nf 1/9/9 2 3 4\nf 1 2 3\n")
    v, f = readers.read_obj(spark, path)
    assert v.count() == 4 and v.where("id = 3").first().z == 0.5
    assert sorted(tuple(r) for r in f.select("polygon", "part", "i", "j", "k").collect()) == [(0, 0, 0, 1, 2), (0, 1, 0, 2, 3), (1, 0, 0, 1, 2)]
    writers.write_obj(v, f, f"file://{tmp_path}/out")
    back = readers.read_obj(spark, f"file://{tmp_path}/out/part-*.txt")
    assert sorted(map(tuple, back[0].collect())) == sorted(map(tuple, v.collect())) and back[1].count() == 3


def test_small_texts(spark, tmp_path):
    kv = dict(map(tuple, readers.read_key_values(spark, put(tmp_path, "info.txt", "n_surf=370 of 948\nskip\nunit = mm\n")).collect()))
    assert kv == {"n_surf": "370", "unit": "mm"}
    split = readers.read_split(spark, put(tmp_path, "val.txt", "# ids\n3 x\n\n 5\n"), "val").orderBy("index").collect()
    assert [tuple(r) for r in split] == [(3, "val"), (5, "val")]
    centers = readers.read_centers(spark, put(tmp_path, "centers.csv", "﻿key,ipa\nk,i\n"))
    assert centers.columns == ["key", "ipa"]
    df = spark.createDataFrame([(3, "val"), (1, "train"), (2, "train")], "index long, split string")
    writers.write_splits(df, f"file://{tmp_path}/splits")
    assert (tmp_path / "splits" / "split=train").exists()
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/splits/split=train").collect()] == ["1", "2"]


def test_records(spark, tmp_path):
    lines = '{"index": 3, "mesh_ref": {"verts_shard": 2, "row_in_shard": 7}, "variant": 1}\nnot json\n{"mesh_ref": {"indices": [5, 6]}}\n{"index": 9}\n'
    path = put(tmp_path / "qa", "qa_00000.jsonl", lines)
    d = readers.read_records(spark, path)
    ids = {tuple(r.ids) for r in d.select(readers.mesh_ids(F.col("mesh_ref"), F.col("index")).alias("ids")).collect()}
    assert ids == {(2007,), (5, 6), (9,)}
    assert () in {tuple(r.ids) for r in d.select(readers.mesh_ids(F.col("mesh_ref")).alias("ids")).collect()}
    as_array = put(tmp_path, "all.json", '[{"index": 1},\n {"index": 2}]')
    assert readers.read_records_any(spark, as_array).count() == 2 == readers.read_records_any(spark, put(tmp_path, "l.jsonl", '{"index": 1}\n{"index": 2}\n')).count()
    writers.write_judge_payloads(spark.createDataFrame([("u", "p", "g")], "uid string, pred string, gold string"), f"file://{tmp_path}/judge", ["pred"], ["gold"])
    assert spark.read.json(f"file://{tmp_path}/judge/predictions").columns == ["pred", "uid"]


def test_values(spark):
    d = spark.createDataFrame([(1, 0.000125, True, {"a": 1.0, "b": None, "c": 2.0}), (2, 0.1, False, {"a": 1.0})], "index long, front_dx double, feat_ok boolean, features map<string,double>")
    assert readers.read_region_mm(d, ["front_dx"]).orderBy("index").first().front_dx == 0.12
    assert [tuple(r) for r in readers.properties(d, ["a", "b"]).collect()] == [(1, {"a": 1.0})]
    a = spark.createDataFrame([("u", "x", 1), ("u", "y", 2)], "uid string, text string, n int")
    assert readers.last_answers(a, "uid", "text", "n").first().text == "y"


def test_new_files_are_processed_once(spark, tmp_path):
    source, sink, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    run = lambda: process_new(spark, source, "id long", lambda d: d.withColumn("twice", F.col("id") * 2), sink, mark)
    spark.range(5).coalesce(1).write.parquet(source)
    run()
    run()
    assert spark.read.parquet(sink).count() == 5
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(r.twice for r in spark.read.parquet(sink).collect()) == [2 * i for i in range(8)]


def test_settling_and_windows(spark):
    d = spark.createDataFrame([(1, 0.1, 0.0), (1, 0.5, 0.2), (1, 0.7, 0.01), (1, 0.9, 0.0), (2, 1.0, 1.0)], "id long, t double, v double")
    assert sorted(map(tuple, first_settled(d, "id", "t", "v", 0.3, 0.05).collect())) == [(1, 0.7), (2, None)]
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    w = windowed_counts(e, "ts", "event_type", "value", "1 day")
    assert w.agg(F.sum("n")).first()[0] == e.count()


def test_json_arrays_by_lines(spark, tmp_path):
    """Arrays by lines, with several elements in a line or over several lines give the same rows; no task holds a whole array written by lines."""
    forms = ['[\n{"a": 1, "s": "x}, {y"}\n,{"a": 2, "s": "[,]"}\n, {"a": 3, "s": null}\n]\n', '[{"a": 1, "s": "x}, {y"}, {"a": 2, "s": "[,]"},\n  {"a": 3}]', '[\n {\n  "a": 1,\n  "s": "x}, {y"\n },\n {"a": 2, "s": "[,]"},\n {"a": 3}\n]']
    for i, text in enumerate(forms):
        (tmp_path / f"{i}.json").write_text(text)
        got = readers.read_records_any(spark, str(tmp_path / f"{i}.json"), "a long, s string")
        assert sorted(map(tuple, got.collect()), key=str) == [(1, "x}, {y"), (2, "[,]"), (3, None)]
        assert ("FileScan text" in got._jdf.queryExecution().executedPlan().toString()) == (i < 2)
    (tmp_path / "none.json").write_text("[\n]\n")
    assert readers.read_records_any(spark, str(tmp_path / "none.json"), "a long").collect() == []
