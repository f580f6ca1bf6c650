import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.functions.vocabulary import MUSCLES
from corvid.operators import metrics, ranking, records, statistics
from corvid.plans import evaluation, pool, scoring
from corvid.sources import config, images, masks, readers, reports, writers


def test_config_paths_overlays_and_names(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text(json.dumps({"data": "d/x", "far": "/abs", "n": 1}))
    c = config.Config(tmp_path / "c.json")
    assert c.path("data") == tmp_path / "d/x" and str(c.path("far")) == "/abs"
    monkeypatch.setenv("CORVID_DATA", "other")
    assert c.path("data") == tmp_path / "other"
    given = config.parse_assignments(["a.b=2", "c=text", "a.d=[1]"])
    assert config.overlay({"a": {"b": 1, "x": 0}, "c": None}, given) == {"a": {"b": 2, "x": 0, "d": [1]}, "c": "text"}
    r = config.Registry()
    r.register(len)
    assert r.find("len") is len
    with pytest.raises(KeyError, match="len"):
        r.find("nothing")
    with pytest.raises(KeyError, match="mask_f1"):
        scoring.find("nothing")


def test_specifications_are_checked(spark, tmp_path):
    import yaml

    good = {"ratios": {"a": 0.35, "b": 0.65}}
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(good))
    assert config.sampling_spec(str(tmp_path / "s.yaml")) == good
    (tmp_path / "s.yaml").write_text(yaml.safe_dump({"ratios": {"a": 0.35, "b": 0.6500001}}))
    with pytest.raises(ValueError, match="ratios"):
        config.sampling_spec(str(tmp_path / "s.yaml"))

    def anchors(a):
        (tmp_path / "a.yaml").write_text(yaml.safe_dump({"anchors": {"k": a}}))
        return config.anchor_spec(spark, str(tmp_path / "a.yaml")).collect()

    row = anchors({"ipa": "i", "category": "vowel", "sigma": 0.1, "rules": {"GGP": [0.1, 0.4]}, "center": [0.0] * len(MUSCLES)})[0]
    assert (row.key, row.ipa, row.rules[0].muscle, row.rules[0].high, len(row.center)) == ("k", "i", "GGP", 0.4, 11)
    for bad in ({"rules": {"XX": [0, 1]}}, {"rules": {"GGP": [0.4, 0.1]}}, {"center": [0.0]}):
        with pytest.raises(ValueError):
            anchors(bad)
    with pytest.raises(FileNotFoundError):
        config.first_files(spark, f"{tmp_path}/none/*.json")


def test_obj_files_of_a_folder_are_numbered_apart(spark, tmp_path):
    for n, name in ((3, "a"), (4, "b")):
        (tmp_path / f"{name}.obj").write_text("".join(f"v {i} 0 0\n" for i in range(n)) + "f 1 2 3\n")
    v, f = readers.read_obj(spark, str(tmp_path / "*.obj"), with_file=True)
    assert sorted((r.file, r.id) for r in v.collect()) == [("a.obj", i) for i in range(3)] + [("b.obj", i) for i in range(4)]
    assert sorted((r.file, r.polygon) for r in f.collect()) == [("a.obj", 0), ("b.obj", 0)]


def mat_file(arrays, packed):
    """A level 5 .mat file of byte arrays."""

    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    out = b"MATLAB 5.0".ljust(124, b" ") + b"\0\1IM"
    for name, a in arrays.items():
        short = struct.pack("<HH", 1, len(name)) + name.encode().ljust(4, b"\0") if len(name) <= 4 else element(1, name.encode())
        m = element(14, element(6, struct.pack("<II", 9, 0)) + element(5, np.array(a.shape, "<i4").tobytes()) + short + element(2, a.astype(np.uint8).tobytes(order="F")))
        z = zlib.compress(m)
        out += struct.pack("<II", 15, len(z)) + z if packed else m
    return out


def test_masks_of_all_formats_in_natural_order(spark, tmp_path):
    for n in (2, 10, 1):
        np.save(tmp_path / f"f{n}.npy", np.full((2, 3), n))
    a = np.arange(24).reshape(2, 4, 3)
    np.savez(tmp_path / "g11.npz", other=np.zeros((1, 1)), mask_frame=a)
    (tmp_path / "mask_12.mat").write_bytes(mat_file({"x": a[..., 0], "mask_frame": a}, True))
    (tmp_path / "mask_13.mat").write_bytes(mat_file({"x": a[..., 1]}, False))
    (tmp_path / "m14.png").write_bytes(images.png_bytes(a))
    (tmp_path / "none.npy").write_bytes(images.npy_bytes(a[..., 2]))
    (tmp_path / "m15.tif").write_bytes(b"not read")
    rows = {r.frame: r for r in masks.read_masks(spark, str(tmp_path)).collect()}
    assert [rows[i].file for i in range(8)] == ["none.npy", "f1.npy", "f2.npy", "f10.npy", "g11.npz", "mask_12.mat", "mask_13.mat", "m14.png"]
    assert rows[1].shape == [2, 3, 1] and rows[0].values == a[..., 2].ravel().tolist() and rows[6].values == a[..., 1].ravel().tolist()
    assert all(rows[i].shape == [2, 4, 3] and rows[i].values == list(range(24)) for i in (4, 5, 7))
    first = {r.frame: r for r in masks.labels(masks.read_masks(spark, str(tmp_path))).collect()}
    assert first[5].labels == a[..., 0].ravel().tolist() and first[5].shape == [2, 4]
    areas = {(r.frame, r.label): r.n for r in masks.label_areas(masks.read_masks(spark, str(tmp_path / "f2.npy"))).collect()}
    assert areas == {(0, 2): 6}
    for bad in (np.zeros(3), np.zeros((2, 2, 2, 2))):
        with pytest.raises(ValueError, match="dimensions"):
            masks.load_mask(images.npy_bytes(bad), "npy")
    with pytest.raises(ValueError, match="format"):
        masks.load_mask(b"", "tif")


@pytest.mark.parametrize("depth,colour,channels", [(8, 0, 1), (8, 2, 3), (8, 6, 4), (16, 4, 2), (1, 0, 1), (4, 3, 1)])
def test_png_filters_and_depths(depth, colour, channels):
    rng = np.random.default_rng(depth + colour)
    rows, columns = 10, 7
    a = rng.integers(0, 1 << depth, (rows, columns, channels))
    step = max(1, channels * depth // 8)
    if depth < 8:
        bits = (a[..., 0][..., None] >> np.arange(depth)[::-1]) & 1
        raw = [np.packbits(r.ravel()).tolist() for r in bits.astype(np.uint8)]
    else:
        raw = [r.astype(">u2" if depth == 16 else "u1").tobytes() for r in a]
    lines, up = b"", [0] * len(raw[0])
    for y, r in enumerate(raw):
        r, kind = list(r), y % 5
        left = [0] * step + r[:-step]
        corner = [0] * step + up[:-step]

        def paeth(x, b, c):
            p = x + b - c
            pa, pb, pc = abs(p - x), abs(p - b), abs(p - c)
            return x if pa <= pb and pa <= pc else b if pb <= pc else c

        guess = [[0, x, b, (x + b) // 2, paeth(x, b, c)][kind] for x, b, c in zip(left, up, corner)]
        lines += bytes([kind]) + bytes((v - g) % 256 for v, g in zip(r, guess))
        up = r
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    z = zlib.compress(lines)
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", columns, rows, depth, colour, 0, 0, 0))
    assert (images.read_png(images.PNG + head + chunk(b"IDAT", z[:5]) + chunk(b"IDAT", z[5:]) + chunk(b"IEND", b"")) == a).all()


def test_exports(spark, tmp_path):
    image = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    writers.write_png(spark, f"file://{tmp_path}/i.png", image)
    writers.write_npy(spark, f"file://{tmp_path}/i.npy", image)
    assert (images.read_png((tmp_path / "i.png").read_bytes()) == image).all() and (np.load(tmp_path / "i.npy") == image).all()
    vertices = spark.createDataFrame([(i, float(i), 0.5, 0.0, 255, 0, 51) for i in range(3)], "id int, x double, y double, z double, r int, g int, b int")
    faces = spark.createDataFrame([(0, 0, 0, 1, 2)], "polygon int, part int, i int, j int, k int")
    writers.write_obj(vertices, faces, f"file://{tmp_path}/o")
    text = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert text[1] == "v 1.0 0.5 0.0 1.000000 0.000000 0.200000" and text[3] == "f 1 2 3"
    v, f = readers.read_obj(spark, str(tmp_path / "o"))
    assert [r.y for r in v.collect()] == [0.5] * 3 and f.count() == 1


def test_rounds_ask_pending_jobs_again(spark):
    jobs = spark.createDataFrame([("f", i, 1, 0, f"q{i}", "front 1", "plain") for i in range(3)], "file string, line int, turn int, variant int, q string, a string, style string")
    asked = []

    def generate(pending):
        asked.append(sorted((r.line, r.temperature) for r in pending.collect()))
        # Line n answers in round n.
        return pending.where("line <= attempt").withColumn("text", F.expr("concat('<Q>say q', line, '</Q><A>front is 1</A>')"))

    got = {r.line: (r.q, r.faithful) for r in evaluation.rewritten(jobs, generate, {}, {"front": "front"}).collect()}
    assert got == {0: ("say q0", True), 1: ("say q1", True), 2: ("say q2", True)} and asked == [[(0, 0.7), (1, 0.7), (2, 0.7)], [(1, 0.85), (2, 0.85)], [(2, 1.0)]]
    # Verdicts are stored by round: what is returned judges nothing again.
    assert "regexp_extract_all" not in evaluation.rewritten(jobs, generate, {}, {"front": "front"})._jdf.queryExecution().optimizedPlan().toString()
    silent = evaluation.rewritten(jobs, lambda d: d.where("false").withColumn("text", F.lit("")), {}, {}).collect()
    assert {(r.q, r.faithful) for r in silent} == {(f"q{i}", False) for i in range(3)}


def test_reports(spark, tmp_path):
    items = spark.createDataFrame([("u1", "value", "a <b>", True), ("u2", "muscle_set", "long " * 40, None)], "uid string, family string, pred string, ok boolean")
    page = reports.html_page("T & t", items, {"uid": "id", "pred": "answer"}, "ok")
    assert "a &lt;b&gt;" in page and "<section class='ok'>" in page and "T &amp; t" in page and page.count("<section") == 2
    assert reports.wrap("a b c\n\nd", 3) == "a b\nc\n\nd"
    scores = spark.createDataFrame([("headline", "Value acc", 0.5), ("value_acc", "n", 1.0)], "metric string, name string, value double")
    files = reports.write_family_metrics(items, scores, str(tmp_path / "m"), {"value_set": ("value", "Value acc")})
    got = json.load(open(files[0]))
    assert got["headline"] == 0.5 and [i["uid"] for i in got["items"]] == ["u1"]
    text = reports.report("R", {"Scores": scores, "None": None, "Empty": scores.limit(0)})
    assert text.startswith("# R\n\n## Scores") and "Empty" not in text
    reports.write_html(items, str(tmp_path / "p.html"), "T", {"uid": "id"})
    assert "u2" in open(tmp_path / "p.html").read()


def test_controls_keep_the_size_of_motion(spark):
    d = spark.range(4000).select((F.col("id") % 2).alias("index"), F.col("id").alias("vertex"), *[((F.col("id") % 7) * s).alias(a) for a, s in (("dx", 0.1), ("dy", -0.2), ("dz", 0.05))])
    size = lambda x: {r["index"]: r["s"] for r in x.groupBy("index").agg(F.sqrt(F.avg((F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2) / 3)).alias("s")).collect()}
    noise = records.mesh_control(d, "noise", 3)
    a, b = size(d), size(noise)
    assert all(abs(a[i] - b[i]) < 0.05 * a[i] for i in a) and noise.collect() == records.mesh_control(d, "noise", 3).collect()
    assert set(size(records.mesh_control(d, "rest")).values()) == {0.0}
    with pytest.raises(ValueError):
        records.mesh_control(d, "other")


def test_consonant_draws_meet_their_rules(spark):
    rule = {"SL": (0.5, 0.8), "GGP": (0.3, 0.6)}
    draws = pool.consonant_draws(spark.range(200), rule, 3)
    assert draws.where(F.aggregate("act", F.lit(0.0), lambda s, x: s + x) > 1.6 + 0.25 + 1e-3).isEmpty()
    kept = pool.accepted_draws(draws, rule).collect()
    assert len(kept) == 200 and all(r.draw == 1 and 0.5 <= r.act[MUSCLES.index("SL")] <= 0.8 for r in kept)
    assert pool.accepted_draws(draws, {"HG": (0.14, 0.15)}).count() < 100


def test_mcnemar_of_many_rows(spark):
    for a, b in ((0, 0), (5, 0), (3, 9), (1500, 1640), (60_000, 61_000), (400_000, 400_100)):
        n, k = a + b, min(a, b)
        lf = math.lgamma
        terms = sorted(lf(n + 1) - lf(i + 1) - lf(n - i + 1) - n * math.log(2) for i in range(max(0, k - 60_000), k + 1))
        want = 1.0 if not n else min(1.0, 2 * math.fsum(map(math.exp, terms)))
        d = spark.range(n + 5).select((F.col("id") < a).alias("x"), ((F.col("id") >= a) & (F.col("id") < n)).alias("y"))
        assert metrics.mcnemar(d, F.col("x"), F.col("y")).first().p_value == pytest.approx(want, abs=2e-6)


def test_quantiles_ranks_and_derangements_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(x)) for g in range(4) for x in ([1.0] * 50 if g == 3 else rng.lognormal(0, 3, 200 + g).round(2))] + [(9, 2.5), (9, None)]
    df = spark.createDataFrame(rows, "g long, x double")
    got = {r.g: r.q for r in statistics.exact_quantiles(df, ["g"], "x", (0.0, 0.2, 1 / 3, 0.5, 1.0), bins=16).collect()}
    for g in {g for g, _ in rows}:
        assert got[g] == pytest.approx(np.quantile([x for h, x in rows if h == g and x is not None], (0.0, 0.2, 1 / 3, 0.5, 1.0)).tolist())
    assert statistics.exact_quantiles(df.limit(0), [], "x", (0.5,)).collect() == []
    keys = [(int(k), str(k % 3) if k != 50 else None) for k in rng.choice(5000, 300, replace=False)] + [(9000, "alone"), (3, "first alone")]
    keys = list(dict(keys).items())
    out = {r.id: r.effective for r in ranking.rotate(spark.createDataFrame(keys, "id long, kind string"), "kind", "id").collect()}
    everyone = sorted(k for k, _ in keys)
    for k, kind in keys:
        own = sorted(x for x, y in keys if y == kind)
        ring = own if len(own) > 1 else everyone
        assert out[k] == ring[(ring.index(k) + 1) % len(ring)]
    w = spark.createDataFrame([(i % 2, i, 3) for i in range(100)], "g long, k long, w long")
    assert sorted(r.k for r in ranking.quota_prefix(w, "g", "k", "w", 30, width=7).collect()) == list(range(20))


def test_turn_scores_and_gold_assertion(spark):
    span = lambda kind, v: (kind, v, 0, 0, None)
    items = [("A2", "advance the front", [span("movement", "advance"), span("region", "front")], [1, 2], False), ("D1", "It cannot be determined", [], [3], True), ("B3", "saturation", [span("movement", "reversal")], [4], False)]
    df = spark.createDataFrame(items, "turn_type string, pred string, gold_spans array<struct<type: string, value: string, start: int, end: int, role: string>>, mesh_indices array<long>, should_abstain boolean")
    options = {"abstain_turn_types": ["D1"], "direction_turn_types": ["A2"], "monotonicity_turn_types": ["B3"]}
    got = {(r.metric, r.name): r.value for r in scoring.score_turns(df, spark.createDataFrame([(2,)], "index long"), "en", options).collect()}
    assert got["abstention_f1", "f1"] == 1.0 and got["direction_acc", "accuracy"] == 1.0 and got["monotonicity_acc", "accuracy"] == 0.0
    assert got["mask_f1", "micro.tp"] == 2.0 and got["turn_type_counts", "D1"] == 1.0 and got["train_mesh_overlap", "A2"] == 0.5
    signs = spark.createDataFrame([("+", "super-additive"), ("-", "no idea")], "gold string, pred string")
    assert {r.name: r.value for r in scoring.score(signs, ["sign_acc"]).collect()} == {"n": 2.0, "accuracy": 0.5, "unparsed_rate": 0.5}
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"])], "index long, muscles array<string>")
    records.require_equal_sets(a, a, "index", "muscles")
    with pytest.raises(ValueError, match="2"):
        records.require_equal_sets(a, a.withColumn("muscles", F.when(F.col("index") == 2, F.array(F.lit("z"))).otherwise(F.col("muscles"))), "index", "muscles")
