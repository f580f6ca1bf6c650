import re

import corpus_pipeline
from corvid.llm.common import scratch_root, stored
from corvid.llm.oracles import oracle_sql
from corvid.llm.queries import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append(docs)
        counts.append(docs.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "mix_sources", "pack"]
    assert counts[0] > counts[1] == counts[2] >= counts[3]
    words = sum(len(WORD.findall(r.text)) for r in seen[3].select("text").collect())
    mixed = sum(len(WORD.findall(r.text)) for r in seen[4].select("text").collect())
    assert abs(mixed - words) < 0.1 * words
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len({r.sequence_id for r in packed}) <= -(-sum(r.length for r in packed) // 4096) + 2
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_pipeline_of_nothing_and_nulls(spark):
    folder = f"{scratch_root(spark)}/empty-sf"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "word " * 60, None, None, None)] * 2, docs.schema)
    odd = odd.unionByName(docs.limit(5))
    odd.write.parquet(f"{folder}-odd/documents.parquet")
    assert corpus_pipeline.run(spark, f"{folder}-odd").count() > 0


def test_stages_on_repeated_and_null_ids(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = {g: " ".join(f"{g}{i}" for i in range(20 + n)) for n, g in enumerate("abcde")}
    groups = [(None, "a"), (None, "a"), (7, "b"), (7, "b"), (3, "b"), (None, "c"), (None, "c"), (5, "c"), (7, "d"), (3, "e"), (3, "e"), (None, "e")]
    near = [text[g] + (" more" if n % 2 else "") for n, (_, g) in enumerate(groups)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for (i, _), t in zip(groups, near, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = stored(docs.select(*[docs[f.name].cast(f.dataType) for f in schema]).repartition(3), "repeated")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["jaccard_join"](spark, docs, SF).collect()
    smallest = {g: min((i for i, x in groups if x == g and i is not None), default=None) for g in text}
    assert sorted(((r.text[0], r.doc_id) for r in kept), key=str) == sorted(smallest.items(), key=str)
    mixed = stages["mix_sources"](spark, docs, SF).collect()
    words = sum(len(t.split()) for t in near)
    assert abs(sum(len(r.text.split()) for r in mixed) - words) <= 25


def test_stages_equal_brute_force_on_repeated_and_null_rows(spark):
    from collections import Counter

    import numpy as np
    import zlib

    from tokenizers import Tokenizer

    from corvid.llm.tokens import tokenizer_path

    from .data import documents
    from .test_dedup_and_rules import measure
    from .test_jaccard_join import expected
    from .test_mixing_and_shards import water_filling

    shared = "This very line is found in a great many of the documents"
    rows = [(d, t, la, so, n) for d, t, la, so, n, *_ in documents(90, seed=12)]
    rows += [(500 + i, f"{shared}\n" + " ".join(f"own{i}x{j}" for j in range(60 + i)), "en", f"s{i % 2}", 7) for i in range(8)]
    rows += [rows[-1], rows[-1], rows[-2], (None, rows[-3][1], "en", "s0", 1), (None, rows[-3][1], "en", "s0", 1), (None, None, None, None, None)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4), "brute")
    stages = dict(corpus_pipeline.STAGES)
    at = lambda df: [tuple(r) for r in df.collect()]

    def passes(text):
        n, chars, symbols, dup, repeats = measure(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        return not (n < 50 or 100 * repeats > 50 * n or 10 * symbols > n or (lines >= 4 and 2 * dup > lines) or chars < 2 * n or chars > 15 * n)

    good = stored(stages["quality_rules"](spark, docs, SF), "good")
    assert Counter(at(good)) == Counter(r for r in rows if passes(r[1]))

    lined = stored(stages["line_dedup"](spark, good, SF), "lined")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    low = lambda d: -1 if d is None else d
    holders = {}
    for r in at(good):
        for x in r[1].split("\n"):
            if len(key(x).decode()) >= 40:
                holders.setdefault(key(x), set()).add(low(r[0]))
    stays = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    want = Counter()
    for d, t, la, so, _ in at(good):
        text = "\n".join(x for x in t.split("\n") if stays.get(key(x), low(d)) == low(d))
        want[(d, text, la, so, len(text))] += 1
    assert Counter(at(lined)) == want and stays

    single = stored(stages["jaccard_join"](spark, lined, SF), "single")
    before = at(lined)
    groups = {}
    for i, (_, _, component) in enumerate(sorted(expected([(i, r[1]) for i, r in enumerate(before)]), key=lambda x: x[0])):
        groups.setdefault(component, []).append(before[i][0])
    least = Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())
    assert Counter(r[0] for r in at(single)) == least and not Counter(at(single)) - want

    mixed = stored(stages["mix_sources"](spark, single, SF), "mixed")
    copies, kept = Counter(at(mixed)), Counter(at(single))
    assert all(copies[r] <= 3 * kept[r] for r in copies)
    sizes, taken = Counter(), Counter()
    for r, n in kept.items():
        sizes[r[3]] += n * len(WORD.findall(r[1]))
    for r, n in copies.items():
        taken[r[3]] += n * len(WORD.findall(r[1]))
    for source, target in water_filling(sizes).items():
        # No rounding to whole copies comes nearer than half of the longest text may force.
        assert abs(taken[source] - target) <= 0.02 * target + max(len(WORD.findall(r[1])) for r in kept if r[3] == source) / 2

    library = Tokenizer.from_file(tokenizer_path(corpus_pipeline.TOKENIZER))
    pieces = Counter()
    for r in at(mixed):
        ids = np.asarray([*library.encode(r[1], add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            pieces[(r[0], piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages["pack"](spark, mixed, SF).collect()) == pieces


def test_scratch_tables_of_a_scope_go_and_results_stay(spark):
    from corvid.llm.common import discard, scratch_scope

    with scratch_scope(spark):
        own = stored(spark.range(5), "own")
        result = stored(own, "result", outlives=True)
    there = lambda df: spark._jvm.org.apache.hadoop.fs.Path(df._stored_at).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(df._stored_at))
    assert not there(own) and there(result) and result.count() == 5
    discard(result)
    assert not there(result)


PLAIN = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.warehouse.dir", sys.argv[1]).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from corvid.llm.queries import queries
before = dict(spark.sparkContext.getConf().getAll()), spark.conf.getAll if not callable(spark.conf.getAll) else spark.conf.getAll()
for name, query in queries().items():
    if name.split("_")[0] in ("op1", "op2", "op3", "op5", "op6", "op7", "op9"):
        print(name, query(spark, "/root/testdata/sf0.001").count())
from corvid.llm.common import scratch_root
assert scratch_root(spark).startswith("file:" + sys.argv[1]) or scratch_root(spark).startswith(sys.argv[1]), scratch_root(spark)
assert (spark.conf.getAll if not callable(spark.conf.getAll) else spark.conf.getAll()) == before[1]
"""


def test_operators_run_on_a_plain_session(tmp_path):
    """Without spark.checkpoint.dir tables go to the warehouse, and no setting of the session is changed."""
    import os
    import subprocess
    import sys

    conf = tmp_path / "conf"
    conf.mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": os.getcwd()}
    done = subprocess.run([sys.executable, "-c", PLAIN, str(tmp_path / "warehouse")], env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split()) == 14 and all(int(x) >= 200 for x in done.stdout.split()[1::2])


def test_every_operator_has_one_query():
    names = [int(n[2:].split("_")[0]) for n in queries()]
    assert sorted(names) == list(range(1, 14)) and set(oracle_sql()) <= set(queries())
