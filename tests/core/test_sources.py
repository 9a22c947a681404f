import gzip
import json
import struct

import numpy as np
import pytest

from quern.operators import kg2kv
from quern.sources import binary, rows
from quern.streaming.incremental import build_new_files


def test_triples_by_position(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y,z\nh1,t1,r1\n"h, 2","t\n2","r ""2"""\n')
    got = rows.read_triples(spark, str(tmp_path / "a.csv")).orderBy("rid").collect()
    assert [(r.rid, r["head"], r["tail"], r.relation) for r in got] == [(0, "h1", "t1", "r1"), (1, "h, 2", "t\n2", 'r "2"')]


def test_rows_of_both_forms(spark, tmp_path):
    data = [{"name": f"n{i}", "Q": "q"} for i in range(5)]
    (tmp_path / "a.json").write_text(" \n" + json.dumps(data, indent=1))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, data)))
    for name in ("a", "b"):
        got = rows.read_rows_with_fallback(spark, str(tmp_path), name)
        assert sorted(r.name for r in got.collect()) == [f"n{i}" for i in range(5)] and "extended_A" in got.columns
    with pytest.raises(FileNotFoundError):
        rows.read_rows_with_fallback(spark, str(tmp_path), "a", augmented=True)
    (tmp_path / "c.jsonl").write_text('{"name": "x"}\n{broken\n{"name": "y"}\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        rows.read_rows(spark, str(tmp_path / "c.jsonl")).collect()
    assert [r.name for r in rows.read_entities(spark, str(tmp_path / "c.jsonl")).collect()] == ["x"]
    chunks = rows.read_chunks(spark, str(tmp_path / "b.jsonl"), 2).collect()
    assert sorted((r.name, r.chunk) for r in chunks) == [("n0", 0), ("n1", 0), ("n2", 1), ("n3", 1), ("n4", 2)]
    assert rows.read_chunks(spark, str(tmp_path / "b.jsonl"), 2, most=1).count() == 2


def test_sinks(spark, tmp_path):
    frame = spark.range(25).selectExpr("id", "if(id < 10, 'train', 'test') split").coalesce(1)
    rows.write_batches(frame, f"{tmp_path}/b", 10)
    assert len(list((tmp_path / "b").glob("*.json"))) == 3
    rows.write_splits(frame, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").filter("split = 'train'").count() == 10
    rows.append_lines(frame, f"{tmp_path}/l")
    rows.append_lines(frame, f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/l").count() == 50
    assert len(json.loads(rows.export_array(frame))) == 25
    with pytest.raises(ValueError):
        rows.export_array(frame, most=24)
    assert json.loads(rows.summary_json(b=frame.limit(1), a=frame.limit(0)))["a"] == []


def test_npy(spark, tmp_path):
    binary.register(spark)
    values = np.arange(35, dtype=np.float64).reshape(7, 5)
    np.save(tmp_path / "v.npy", values)
    got = spark.read.format("npy").option("path", f"{tmp_path}/v.npy").option("rows", "3").load()
    assert got.rdd.getNumPartitions() == 3
    assert {r.id: r.vector for r in got.collect()} == {i: v.tolist() for i, v in enumerate(values)}


def field(number, data):
    out, n = bytes([number << 3 | 2]), len(data)
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n]) + data


def example(**features):
    body = b""
    for name, values in features.items():
        if isinstance(values[0], int):
            inner = field(3, field(1, bytes(values)))
        else:
            inner = field(1, b"".join(field(1, v) for v in values))
        body += field(1, field(1, name.encode()) + field(2, inner))
    return field(1, body)


def test_tfrecord(spark, tmp_path):
    binary.register(spark)
    records = [example(episode_id=[5], goal=[b"g" * 200], actions=[b'{"a":1}', "é".encode()]), example(episode_id=[6])]
    data = b"".join(struct.pack("<Q", len(r)) + b"0000" + r + b"0000" for r in records)
    with gzip.open(tmp_path / "a.gz", "wb") as f:
        f.write(data)
    (tmp_path / "b").write_bytes(data)
    got = spark.read.format("tfrecord").option("path", str(tmp_path)).load().orderBy("source_file", "record_index").collect()
    assert len(got) == 4 and json.loads(got[0].features) == {"episode_id": [5], "goal": ["g" * 200], "actions": ['{"a":1}', "é"]}
    assert json.loads(got[3].features) == {"episode_id": [6]}


def test_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: build_new_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"rid": 10 * k + i, "head": f"h{i}", "relation": "is", "tail": f"t{i}"}) for i in range(3)))
        run()
        run()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 3 * (k + 1)


def test_relation_hook_runs_once_a_pair(spark):
    frame = spark.createDataFrame([(i, "a", "r", "b", "head") for i in range(9)], "rid long, head string, relation string, tail string, missing string")
    assert {r.noun for r in kg2kv.relation_nouns(frame, lambda r, m: r.substr(1, 1)).collect()} == {"r"}


def test_bundle_of_matrices_and_maps(spark, tmp_path):
    from quern.sources import bundles

    stem = f"{tmp_path}/kb_enc_embd_"
    keys, inter, root = np.arange(12.0).reshape(6, 2), np.ones((3, 2)), np.zeros((2, 2))
    for name, values in (("key", keys), ("value", keys + 1), ("key_inter1", inter), ("key_root", root)):
        np.save(f"{stem}{name}.npy", values.astype(np.float32))
    for level, n, groups in (("inter1", 6, 3), ("root", 3, 2)):
        (tmp_path / f"kb_enc_embd_key_{level}_id2c_mapping.json").write_text(json.dumps({str(i): i % groups for i in range(n)}))
    found = bundles.read_matrices(spark, str(tmp_path), "kb", "enc")
    assert {r.id: (r.key, r.value) for r in found["leaves"].collect()} == {i: (k.tolist(), (k + 1).tolist()) for i, k in enumerate(keys)}
    assert sorted(map(tuple, found["edges"].collect())) == [(i, i % 3, i % 3 % 2) for i in range(6)]
    bundles.write_bundle(f"{tmp_path}/out", **found)
    assert sorted(map(tuple, bundles.bundle_sizes(bundles.read_bundle(spark, f"{tmp_path}/out")).collect())) == [("inter", 3), ("leaves", 6), ("root", 2)]
    np.save(f"{stem}value.npy", keys[:5].astype(np.float32))
    with pytest.raises(ValueError, match="as many"):
        bundles.read_matrices(spark, str(tmp_path), "kb", "enc")


def test_teacher_histories(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n{"e1": ["one", "two"],\n "e2": []}\n')
    assert sorted(map(tuple, rows.read_histories(spark, f"{tmp_path}/a.json").collect())) == [("e1", 0, "one"), ("e1", 1, "two")]
    (tmp_path / "b.json").write_text("[1]")
    with pytest.raises(Exception, match="object"):
        rows.read_histories(spark, f"{tmp_path}/b.json").collect()


def test_merged_batches(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"name": f"n{k}{i}"} for i in range(4)]))
    first, again, other = ([r.name for r in rows.merged_batches(spark, str(tmp_path), seed).collect()] for seed in (1, 1, 2))
    assert first == again != other and sorted(first) == sorted(other) == [f"n{k}{i}" for k in range(3) for i in range(4)]
    assert all(len({n[1] for n in first[at : at + 4]}) == 1 for at in (0, 4, 8))
