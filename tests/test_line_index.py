"""The offset index of JSON lines: splits anywhere, filters, quotas, turns of files, random access."""

import itertools
import json
import random

import pytest
from pyarrow import fs

from corvid.sources import line_index as L


@pytest.mark.parametrize("read", [1, 3, 64])
def test_ranges_cover_all_lines_once(tmp_path, read, monkeypatch):
    monkeypatch.setattr(L, "READ", read)
    rng = random.Random(1)
    for text in (b"", b"a", b"a\n", b"\n", b"\n\nab\n", b"ab\ncd", b"".join(rng.choice([b"x", b"\n", b"yz"]) for _ in range(60))):
        (tmp_path / "f").write_bytes(text)
        want, at = [], 0
        for line in text.split(b"\n") if not text.endswith(b"\n") else text[:-1].split(b"\n"):
            want.append((at, line))
            at += len(line) + 1
        want = want if text else []
        for span in (1, 2, 5, 100):
            got = [x for b in range(0, len(text), span) for x in L.lines_of(fs.LocalFileSystem(), str(tmp_path / "f"), b, min(len(text), b + span))]
            assert got == want, (text, span)


def corpus(tmp_path, seed=4):
    rng = random.Random(seed)
    files = []
    for name in ("nat_B.jsonl", "nat_A.jsonl", "nat_C.jsonl"):
        lines = []
        for i in range(rng.randint(15, 40)):
            turns = [{"from": f, "value": f"{name} é {i} {k}"} for k in range(rng.randint(0, 3)) for f in ("human", "gpt")]
            rec = {"scenario": rng.choice(["a", "b", "skip"]), "conversations": turns, "mesh_ref": rng.choice([{"indices": rng.sample(range(30), 2)}, {"verts_shard": 0, "row_in_shard": rng.randrange(30)}, {}])}
            if rng.random() < 0.5:
                rec["index"] = rng.randrange(30)
            if rng.random() < 0.4:
                rec["variant"] = rng.choice([0, 1, 2])
            if rng.random() < 0.3:
                rec["nat_all_faithful"] = rng.random() < 0.5
            lines.append(rng.choice(["", "", "", "not json", '{"scenario": '][:3]) or json.dumps(rec, ensure_ascii=False))
        lines.insert(3, "broken {")
        (tmp_path / name).write_bytes("\n".join(lines).encode() + (b"" if name == "nat_A.jsonl" else b"\n"))
        files.append(name)
    (tmp_path / "other.txt").write_text("{}")
    return sorted(files)


def plain(tmp_path, files, allowed, policy, exclude, variants, faithful, turn_wise, most):
    quota = max(1, -(-most // len(files))) if most else None
    per_file = []
    for fi, name in enumerate(files):
        entries, off = [], 0
        for raw in (tmp_path / name).read_bytes().splitlines(keepends=True):
            cur, off = off, off + len(raw)
            if quota is not None and len(entries) >= quota:
                break
            try:
                rec = json.loads(raw)
            except json.JSONDecodeError:
                continue
            ref = rec.get("mesh_ref") or {}
            ids = ref.get("indices") or ([ref["verts_shard"] * 1000 + ref["row_in_shard"]] if "verts_shard" in ref else [rec["index"]] if "index" in rec else [])
            flags = [i in allowed for i in ids] if allowed is not None else [True]
            keep = {"all": all(flags), "any": any(flags), "primary": bool(flags) and flags[0]}[policy]
            if rec.get("scenario") in exclude or (variants is not None and rec.get("variant", 0) not in variants) or (faithful and not rec.get("nat_all_faithful", True)) or not ids or not keep:
                continue
            entries += [(fi, cur, ids, k) for k in range(sum(t["from"] == "gpt" for t in rec["conversations"]))] if turn_wise else [(fi, cur, ids, None)]
        per_file.append(entries)
    out = [e for row in itertools.zip_longest(*per_file) for e in row if e is not None]
    return out[:most] if most else out


@pytest.mark.parametrize("policy, exclude, variants, faithful, turn_wise, most", [("all", [], None, False, True, None), ("any", ["skip"], [0, 1], True, True, 25), ("primary", ["a"], None, False, False, 10), ("all", [], [0], False, True, 2), ("any", [], None, True, False, None)])
def test_index_equals_the_plain_loop(spark, tmp_path, policy, exclude, variants, faithful, turn_wise, most):
    files = corpus(tmp_path)
    allowed = None if policy == "all" else {i for i in range(30) if i % 3}
    table = None if allowed is None else spark.createDataFrame([(i,) for i in allowed], "index long")
    want = plain(tmp_path, files, allowed, policy, exclude, variants, faithful, turn_wise, most)
    for span in (97, 1 << 20):
        found, names = L.qa_index(spark, f"{tmp_path}/nat_*.jsonl", table, policy, exclude, variants, faithful, turn_wise, most, span)
        got = [(r.file, r.offset, r.ids, r.turn) for r in found.orderBy("position").collect()]
        assert got == want and [n.rsplit("/", 1)[1] for n in names] == files
    assert [r.position for r in found.orderBy("position").collect()] == list(range(len(want)))


def test_entries_are_read_by_their_places(spark, tmp_path):
    files = corpus(tmp_path)
    found, names = L.qa_index(spark, f"{tmp_path}/nat_*.jsonl", max_records=30)
    rows = L.read_entries(found, names, f"{tmp_path}/nat_*.jsonl").collect()
    assert len(rows) == found.count() > 0
    for r in rows:
        line = (tmp_path / files[r.file]).read_bytes()[r.offset :].split(b"\n")[0]
        rec = json.loads(line)
        assert [t["value"] for t in rec["conversations"]] == [t.value for t in r.r.conversations] and (rec.get("variant") == r.r.variant)


def test_no_files_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        L.qa_index(spark, f"{tmp_path}/none_*.jsonl")
