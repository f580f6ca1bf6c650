"""The shard data source: byte ranges, lookups, one write job with renames at its end."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from corvid.sources import readers, writers
from corvid.sources.shard_source import PushingShardReader, ShardReader, ShardWriter, Stretch, Written


def meshes(spark, ids, vertices=2):
    rows = [(i, [[float(i + 10 * v + a) for a in range(3)] for v in range(vertices)]) for i in ids]
    return spark.createDataFrame(rows, "index long, verts array<array<float>>").repartition(3)


def written(spark, folder, ids, size=4):
    d = meshes(spark, ids)
    meta = d.select("index", F.lit("VALID").alias("label"), F.when(F.col("index") % 2 == 0, 0.5).alias("vol_ratio"))
    writers.write_shards(d, meta, str(folder), 2, size)


def test_one_job_writes_all_shards(spark, tmp_path):
    spark.sparkContext.setJobGroup("shards", "shards")
    written(spark, tmp_path, range(10))
    assert sorted(f.rsplit("/", 1)[1] for f in glob.glob(f"{tmp_path}/verts/*")) == [f"shard_{i:05d}.bin" for i in range(3)]
    assert np.fromfile(f"{tmp_path}/verts/shard_00002.bin", ">f4").reshape(-1, 2, 3)[1, 1].tolist() == [19.0, 20.0, 21.0]
    assert open(f"{tmp_path}/meta/shard_00001.csv").read() == "index,label,vol_ratio\n4,VALID,0.5\n5,VALID,NA\n6,VALID,0.5\n7,VALID,NA\n"
    got = {r["index"]: r.verts for r in readers.read_shards(spark, f"{tmp_path}/verts", 2, 4, partition_rows=3).collect()}
    assert got == {r["index"]: r.verts for r in meshes(spark, range(10)).collect()}


def test_shards_that_are_there_stay(spark, tmp_path):
    written(spark, tmp_path, range(4))
    before = open(f"{tmp_path}/verts/shard_00000.bin", "rb").read()
    other = meshes(spark, range(8)).withColumn("verts", F.expr("transform(verts, v -> transform(v, x -> x + 1000f))"))
    writers.write_shards(other, other.select("index"), str(tmp_path), 2, 4)
    assert open(f"{tmp_path}/verts/shard_00000.bin", "rb").read() == before
    assert readers.read_shards(spark, f"{tmp_path}/verts", 2, 4).where("index = 4").first().verts[0][0] == 1004.0


@pytest.mark.parametrize("ids", [[0, 1, 3], [1, 2, 3], [0, 0, 1]], ids=str)
def test_gaps_and_repeats_fail_and_leave_no_shard(spark, tmp_path, ids):
    d = meshes(spark, ids)
    with pytest.raises(Exception, match="gaps, repeats"):
        writers.write_shards(d, d.select("index").distinct(), str(tmp_path), 2, 4)
    assert not glob.glob(f"{tmp_path}/verts/*.bin") and readers.read_shards(spark, f"{tmp_path}/verts", 2, 4).count() == 0


def test_parts_are_no_shards_and_odd_sizes_raise(spark, tmp_path):
    written(spark, tmp_path, range(4))
    (tmp_path / "verts" / "shard_00001.bin.abc.part").write_bytes(b"half")
    assert readers.read_shards(spark, f"file://{tmp_path}/verts", 2, 4).count() == 4
    (tmp_path / "verts" / "shard_00001.bin").write_bytes(b"half")
    with pytest.raises(ValueError, match="no whole rows"):
        ShardReader({"path": f"{tmp_path}/verts", "vertices": "2", "shardsize": "4"}).partitions()


def test_filters_become_places(spark, tmp_path):
    written(spark, tmp_path, range(10))
    options = {"path": f"{tmp_path}/verts", "vertices": "2", "shardsize": "4", "partitionrows": "3"}

    def read(*filters):
        r = PushingShardReader(options)
        left = list(r.pushFilters(list(filters)))
        return r, r.partitions(), left

    r, parts, left = read(EqualTo(("index",), 6))
    assert [(p.shard, p.places) for p in parts] == [(1, (2,))] and not left
    batch = next(r.read(parts[0]))
    assert batch.column("index").to_pylist() == [6] and batch.num_rows == 1
    assert [(p.shard, p.places) for p in read(In(("index",), (9, 1, 77)))[1]] == [(0, (1,)), (2, (1,))]
    assert [(p.shard, p.begin, p.count) for p in read(GreaterThan(("index",), 2), LessThanOrEqual(("index",), 5))[1]] == [(0, 3, 1), (1, 0, 2)]
    assert read(EqualTo(("index",), 1), EqualTo(("index",), 2))[1] == []
    other = EqualTo(("verts",), 1)
    assert read(other)[2] == [other]


def test_a_filtered_scan_reads_one_row(spark, tmp_path):
    written(spark, tmp_path, range(10))
    d = readers.read_shards(spark, f"{tmp_path}/verts", 2, 4).where("index = 6")
    assert [r["index"] for r in d.collect()] == [6] and d.rdd.getNumPartitions() == 1
    assert sorted(r["index"] for r in readers.read_shards(spark, f"{tmp_path}/verts", 2, 4).where("index in (1, 8, 50) or index is null").collect()) == [1, 8]


def test_lookups_by_a_table_of_ids(spark, tmp_path):
    written(spark, tmp_path, range(10))
    ids = spark.createDataFrame([(7,), (0,), (7,), (99,), (None,)], "index long")
    got = readers.lookup_shards(spark, f"{tmp_path}/verts", 2, ids, 4).collect()
    assert sorted((r["index"], r.verts[1][2]) for r in got) == [(0, 12.0), (7, 19.0)]
    assert readers.lookup_shards(spark, f"{tmp_path}/none", 2, ids, 4).count() == 0


def test_abort_removes_what_tasks_have_reported(tmp_path):
    w = ShardWriter({"path": str(tmp_path), "vertices": "2"})
    (tmp_path / "verts" / "a.part").write_bytes(b"x")
    w.abort([Written([(f"{tmp_path}/verts/a.part", f"{tmp_path}/verts/a")]), None])
    assert not list((tmp_path / "verts").iterdir())
    assert Stretch(0, "f", 0, 1).places is None


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from corvid.sources.scratch import shared_root

    def session(master, conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    warehouse = "spark.sql.warehouse.dir"
    assert shared_root(session("local[4]", {warehouse: "file:/w/"})) == "file:/w" == shared_root(session("spark://h:1", {"spark.checkpoint.dir": "file:/w", warehouse: "x"}))
    assert shared_root(session("yarn", {warehouse: "hdfs://n/w"})) == "hdfs://n/w"
    for master, root in (("spark://h:1", "file:/w"), ("local-cluster[2,1,512]", "/w"), ("yarn", None), ("local[2]", None)):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_root(session(master, {warehouse: root}))
