"""Files of all kinds, written to a temporary folder and read back."""

from __future__ import annotations

import json
import zipfile

import numpy as np
import pytest

from tamis.sources import arrays as A
from tamis.sources.arrays import family_files, read_npy, read_zipped_csv, shard_files
from tamis.sources.files import read_json_mixed, read_jsonl, resolve_paths, texts_of


def test_arrays(spark, tmp_path):
    a = np.arange(60, dtype=np.float32).reshape(20, 3)
    np.save(tmp_path / "a.npy", a)
    df = read_npy(spark, str(tmp_path / "a.npy"), rows_per_task=7)
    assert df.rdd.getNumPartitions() == 3
    assert [r.vec for r in df.orderBy("row").collect()] == a.tolist()


def test_families_with_and_without_a_manifest(spark, tmp_path):
    for f in ("q1", "q2"):
        (tmp_path / f"{f}.json").write_text("[]")
    names = lambda: {r.family: r.path.rsplit("/", 1)[-1] for r in family_files(spark, str(tmp_path)).collect()}
    assert names() == {"q1": "q1.json", "q2": "q2.json"}
    (tmp_path / "manifest.json").write_text(json.dumps({"family_files": {"first": "q2.json"}}))
    assert names() == {"first": "q2.json"}


def test_shards(spark, tmp_path):
    for p in ("part-1/a.jpg", "deep/7/b.jpg", "other/c.jpg"):
        (tmp_path / p).parent.mkdir(parents=True)
        (tmp_path / p).write_text("x")
    assert sorted(r.shard for r in shard_files(spark, str(tmp_path), "*.jpg").collect()) == ["7", "part-1"]


def test_zipped_records(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("run/records.csv", "method,budget,v\nrandom,5,1.5\nkcenter,10,\n")
    rows = read_zipped_csv(spark, str(tmp_path / "r.zip"), "records.csv", "method string, budget long, v double").orderBy("budget").collect()
    assert [r.method for r in rows] == ["random", "kcenter"] and rows[0].v == 1.5 and rows[1].v is None
    assert read_zipped_csv(spark, str(tmp_path / "r.zip"), "none.csv", "method string").count() == 0


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2, "b": "é"}\n')
    assert sorted(r.a for r in read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long, b string").collect()) == [1, 2]
    (tmp_path / "y.json").write_text('[{"a": 1}, {"a": 2}]\n{"a": 3}\n')
    assert sorted(r.a for r in read_json_mixed(spark, str(tmp_path / "y.json"), "struct<a:long>").collect()) == [1, 2, 3]


def test_texts(spark):
    raw = json.dumps(["a ", {"query": "b"}, {"text": "c"}, {"query": "", "caption": "d"}, "a", "", {"other": 1}])
    df = spark.createDataFrame([(1, raw)], "k int, json string")
    assert [(r.pos, r.text) for r in texts_of(df, "json", ["k"]).orderBy("pos").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_paths(spark):
    rows = spark.createDataFrame([("s", ".png", "s.png"), ("s", ".jpg", "s.jpg"), ("t", ".gif", "t.gif")], "stem string, ext string, path string")
    out = {r.stem: r.path for r in resolve_paths(rows, rows, "stem", [".jpg", ".png"]).collect()}
    assert out == {"s": "s.jpg", "t": None}


def test_arrays_over_several_lines(spark, tmp_path):
    rows = [{"a": k, "b": f"x\n{k}"} for k in range(5)]
    (tmp_path / "whole.json").write_text("\n " + json.dumps(rows[:2], indent=2))
    (tmp_path / "cut.json").write_text("[" + json.dumps(rows[2]) + ",\n" + json.dumps(rows[3]) + "]")
    (tmp_path / "lines.json").write_text("\n" + json.dumps(rows[4]) + "\nbroken {\n[" + json.dumps({"a": 7}) + "]\n")
    (tmp_path / "empty.json").write_text("\n")
    out = read_json_mixed(spark, str(tmp_path / "*.json"), "struct<a:long,b:string>")
    assert sorted((r.a, r.b) for r in out.collect()) == [(k, f"x\n{k}") for k in range(5)] + [(7, None)]


def test_wrappers(spark, tmp_path):
    from tamis.sources.files import read_wrapped, write_json_arrays

    rows = spark.range(7).repartition(3)
    for field in (None, "data"):
        write_json_arrays(rows, str(tmp_path / f"w{field}"), field)
        assert sorted(r.id for r in read_wrapped(spark, str(tmp_path / f"w{field}"), "struct<id:long>").collect()) == list(range(7))
    write_json_arrays(rows.where("id < 0"), str(tmp_path / "none"))
    assert read_wrapped(spark, str(tmp_path / "none"), "struct<id:long>").count() == 0
    df = spark.createDataFrame([(1, '{"x": [1], "items": ["a", {"text": "b"}, "a"]}'), (2, None), (3, ' ["c"]')], "k long, json string")
    assert sorted((r.k, r.pos, r.text) for r in texts_of(df, "json", ["k"]).collect()) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "c")]
    with pytest.raises(Exception, match="neither"):
        texts_of(spark.createDataFrame([(1, '{"x": 1}')], "k long, json string"), "json", ["k"]).collect()


def test_no_private_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from tamis.session import shared_folder

    conf = SimpleNamespace(get=lambda *a: "")
    for master, fine in (("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://h:7077", False), ("yarn", False)):
        fake = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master), conf=conf)
        if fine:
            assert shared_folder(fake).startswith("file:///")
        else:
            with pytest.raises(RuntimeError):
                shared_folder(fake)


@pytest.mark.parametrize("dtype, kind", [("float32", "float"), ("float64", "double"), ("int32", "long"), ("float16", "float")])
def test_arrays_written_and_read(spark, tmp_path, dtype, kind):
    x = np.arange(60).reshape(20, 3).astype(dtype)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>").repartition(4)
    A.write_npy(df, "id", "v", f"{tmp_path}/x.npy", dtype)
    assert np.array_equal(np.load(f"{tmp_path}/x.npy"), x) and np.load(f"{tmp_path}/x.npy").dtype == x.dtype
    back = A.read_npy(spark, f"{tmp_path}/x.npy", 7)
    assert back.schema["vec"].dataType.elementType.simpleString().replace("bigint", "long") == kind
    assert [r.vec for r in back.orderBy("row").collect()] == x.tolist()
    with pytest.raises(ValueError):
        A.write_npy(df.where("id <> 3"), "id", "v", f"{tmp_path}/y.npy")
    A.write_npy(df.limit(0), "id", "v", f"{tmp_path}/z.npy")
    assert len(np.load(f"{tmp_path}/z.npy")) == 0


def test_named_arrays(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "b", [1.0, 2.0]), (0, 1.5, "aa", [3.0, 4.0])], "cluster int, score double, name string, centre array<double>")
    A.write_npz(df, f"{tmp_path}/x.npz", ["cluster"])
    back = A.read_npz(spark, f"{tmp_path}/x.npz")
    assert [tuple(r) for r in back.orderBy("row").collect()] == [(0, 0, 1.5, "aa", [3.0, 4.0]), (1, 1, 2.5, "b", [1.0, 2.0])]
    assert A.read_npz(spark, f"{tmp_path}/x.npz", ["score"]).columns == ["row", "score"]
    with pytest.raises(ValueError):
        A.write_npz(df, f"{tmp_path}/y.npz", ["cluster"], most_rows=1)
