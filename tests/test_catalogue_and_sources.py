import json
import random
import time

import pytest
from pyspark.sql import functions as F

from loamsift.functions.paths import device_serves, is_dynamic, normalize_path, normalize_source, numel, version, version_serves, with_dynamic_batch
from loamsift.functions.text import human_bytes, human_seconds
from loamsift.operators import catalogue as C
from loamsift.sources import documents as D


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_eviction_is_a_running_sum(spark):
    rng = random.Random(1)
    rows = [(f"k{i}", rng.randrange(1, 50), rng.randrange(100)) for i in range(80)]
    d = spark.createDataFrame([(k, s, a, 0) for k, s, a in rows], "key string, size long, accessed long, hit_count long")
    used, want = 0, set()
    for k, s, a in sorted(rows, key=lambda r: (-r[2], r[0])):
        used += s
        if used > 900:
            want.add(k)
    assert {r.key for r in C.evicted(d, 1000, 100).collect()} == want
    assert C.evicted(d.limit(0), 10).count() == 0


def test_metrics_and_entries(spark):
    d = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("b", 7, 3), ("a", 5, 9), (None, 1, 1)], "key string, size long, at long")
    assert tuple(C.metrics(d, "key", "size").first()) == (4, 2, 2, 12, 10, 0.5)
    assert C.metrics(d.limit(0), "key", "size").first().hit_rate == 0.0
    assert {tuple(r) for r in C.entries(d, "key", "size", "at").collect()} == {("a", 5, 1, 9, 2), ("b", 7, 3, 3, 0)}
    assert "cache_hits 2" in {r.line for r in C.prometheus(C.metrics(d, "key", "size")).collect()}


def test_compatibility(spark):
    now = {"python": "3.11.2", "torch": "2.1.0", "cuda": "8.6", "triton": "2.1", "platform": "linux"}
    rows = [("same", *now.values()), ("patch", "3.11.9", "2.1.5", "8.6", "2.1", "linux"), ("old cuda", "3.11", "2.1", "8.0", None, "linux"), ("new cuda", "3.11", "2.1", "9.0", None, "linux"), ("python", "3.10.1", "2.1", None, None, "linux"), ("platform", "3.11", "2.1", None, None, "mac")]
    d = spark.createDataFrame(rows, "name string, python string, torch string, cuda string, triton string, platform string")
    got = {r.name: r.status for r in C.compatibility(d, now).collect()}
    assert got == {"same": "Compatible", "patch": "Compatible", "old cuda": "Warning", "new cuda": "Incompatible", "python": "Incompatible", "platform": "Incompatible"}
    assert {r.name: r.status for r in C.compatibility(d, {**now, "cuda": None}).collect()}["same"] == "Incompatible"


def test_sync_and_tiers(spark):
    a, b = (spark.createDataFrame([(k,) for k in x], "key string") for x in ("xyz", "zw"))
    assert {tuple(r) for r in C.sync(a, b).collect()} == {("x", "push"), ("y", "push"), ("w", "pull")}
    wanted = spark.createDataFrame([(k,) for k in "xwq"], "key string")
    assert {tuple(r) for r in C.warmed(wanted, a, b).collect()} == {("x", "local"), ("w", "remote"), ("q", "none")}


def test_key_functions(spark):
    v = lambda s: version(F.lit(s))
    r = one(spark, a=version_serves(v("2.3.1"), v("2.1")), b=version_serves(v("3.0"), v("2.1")), c=v("2"), n=numel(F.array(F.lit(2), F.lit(3))), m=numel(F.array(F.lit(-1), F.lit(3))), d=is_dynamic(F.array(F.lit(-1))), e=with_dynamic_batch(F.array(F.lit(8), F.lit(3))))
    assert (r.a, r.b, r.c, r.n, r.m, r.d, r.e) == (True, False, None, 6, None, True, [-1, 3])
    dev = lambda k, a, b, o, c, d: device_serves(F.lit(k), F.lit(a), F.lit(b), F.lit(o), F.lit(c), F.lit(d))
    r = one(spark, a=dev("cuda", 9, 0, "cuda", 8, 6), b=dev("cuda", 8, 0, "cuda", 8, 6), c=dev("cuda_any", 0, 0, "cuda", 8, 6), d=dev("cpu", 0, 0, "cuda", 8, 6), e=dev("cpu", 0, 0, "cpu", 0, 0))
    assert tuple(r) == (True, False, True, False, True)


def test_paths(spark):
    r = one(spark, a=normalize_path(F.lit("/home/u/p/src/model.py")), b=normalize_path(F.lit("/Users/n/lib.py")), c=normalize_path(F.lit("/")), d=normalize_source(F.lit("x = '/home/u/src/a.py' + \"b\"\ny = \"//c\"")))
    assert (r.a, r.b, r.d) == ("src/model.py", "lib.py", "x = 'src/a.py' + \"b\"\ny = \"//c\"") and r.c.startswith("path_")


def test_readable(spark):
    r = one(spark, a=human_bytes(F.lit(1536)), b=human_bytes(F.lit(12)), c=human_seconds(F.lit(90)), d=human_seconds(F.lit(7200)))
    assert tuple(r) == ("1.50 KiB", "12 B", "1.5m", "2.0h")


@pytest.mark.parametrize("path,kind", [("a.JSONL", "jsonl"), ("a/b.json", "jsonl"), ("x.ndjson", "jsonl"), ("x.pq", "parquet"), ("x.parquet/", "parquet"), ("x.tsv", "tsv")])
def test_formats(path, kind):
    assert D.format_of(path) == kind and D.format_of("x", "jsonl") == "jsonl"
    for bad in (("x.bin", "auto"), ("x.json", "xml")):
        with pytest.raises(ValueError):
            D.format_of(*bad)


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    lines = [json.dumps({"id": 7, "text": "x"}), "", json.dumps({"text": "y", "score": 0.5}) + "  ", json.dumps({"id": "c4_1", "text": ""}), json.dumps({"id": -4, "text": "z"})]
    p.write_text("\n".join(lines) + "\n")
    rows = sorted((r.line_number, r.id, r.text, r.line) for r in D.read_jsonl(spark, str(p), keep_line=True).collect())
    assert rows == [(0, 7, "x", lines[0]), (2, 2, "y", lines[2].rstrip()), (3, 3, "", lines[3]), (4, 4, "z", lines[4])]
    D.write_lines(D.read_jsonl(spark, str(p), keep_line=True), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [r[3] for r in rows]
    D.write_jsonl(D.read_jsonl(spark, str(p)), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4


@pytest.mark.parametrize("bad,says", [("{oops", "line 2"), ('{"other": 1}', "line 2"), ('{"text": 5}', "line 2")])
def test_bad_lines_are_named(spark, tmp_path, bad, says):
    p = tmp_path / "a.jsonl"
    p.write_text('{"text": "fine"}\n' + bad + "\n")
    with pytest.raises(Exception, match=says):
        D.read_jsonl(spark, str(p)).collect()


def test_line_numbers_over_splits(spark, tmp_path):
    p = tmp_path / "big.txt"
    p.write_text("".join(f"{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        d = D.numbered_lines(spark, str(p))
        assert d.where(F.col("line_number") != F.col("line").cast("long")).count() == 0 and d.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_parquet(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", [1.5]), (2, None, None)], "id long, text string, more array<double>")
    D.write_parquet_full(d, str(tmp_path / "p.parquet"))
    assert {tuple(r) for r in D.read_parquet(spark, str(tmp_path / "p.parquet")).collect()} == {(1, "a"), (2, "")}
    full = D.read_parquet_full(spark, str(tmp_path / "p.parquet"))
    assert full.columns == d.columns and full.count() == 1
    with pytest.raises(ValueError):
        D.read_parquet(spark, str(tmp_path / "p.parquet"), "more")
    D.write_parquet_full(d.limit(0), str(tmp_path / "e.parquet"))
    assert spark.read.parquet(str(tmp_path / "e.parquet")).columns == d.columns


def test_tensor_files(spark, tmp_path):
    import struct

    import numpy as np

    from loamsift.sources import tensors as T

    rng = np.random.default_rng(1)
    rows = [(f, f"layer.{k}", "F32", [4, 5], 80, rng.standard_normal(20).astype("<f4").tobytes()) for f in ("a", "b") for k in range(3)] + [("a", "n", "I64", [2], 16, np.arange(2).astype("<i8").tobytes()), ("b", "none", "U8", [0], 0, b"")]
    d = spark.createDataFrame(rows, T.SCHEMA)
    want = {(r[0], r[1]): (r[2], r[3], r[5]) for r in rows}
    for kind in ("safetensors", "container"):
        assert {(r.file, r.tensors) for r in T.write_tensors(d, str(tmp_path / kind), kind).collect()} == {("a", 4), ("b", 4)}
        got = {(r.file.rsplit("/", 1)[1].split(".")[0], r.name): (r.dtype, r["shape"], bytes(r.data)) for r in T.read_tensors(spark, str(tmp_path / kind)).collect()}
        assert got == want
        assert {r.format for r in T.file_formats(spark, str(tmp_path / kind)).collect()} == {kind}
        assert all(r.data is None for r in T.read_tensors(spark, str(tmp_path / kind), kind, data=False).collect())
    T.convert(spark, str(tmp_path / "container"), str(tmp_path / "back"), "safetensors")
    apart = d.where("file = 'a'").withColumn("file", F.lit("/x/a/model.st")).union(d.where("file = 'b'").withColumn("file", F.lit("/x/b/model.st")))
    assert {r.file for r in T.write_tensors(apart, str(tmp_path / "apart"), "safetensors").collect()} == {"a/model", "b/model"}
    assert T.read_tensors(spark, str(tmp_path / "apart")).count() == apart.count()
    assert T.read_tensors(spark, str(tmp_path / "back")).count() == len(rows)
    T.write_tensors(d.where("file = 'a'"), str(tmp_path / "arrays"), "npy")
    assert np.array_equal(np.load(tmp_path / "arrays/layer.1.npy").tobytes(), want["a", "layer.1"][2])
    assert {r.name for r in T.read_tensors(spark, str(tmp_path / "arrays")).collect()} == {"layer.0", "layer.1", "layer.2", "n"}
    text = lambda s: struct.pack("<Q", len(s)) + s
    head = struct.pack("<IIQQ", 0x46554747, 3, 1, 1) + text(b"general.alignment") + struct.pack("<II", 4, 64) + text(b"w") + struct.pack("<IQQIQ", 2, 2, 3, 0, 0)
    (tmp_path / "m.gguf").write_bytes(head + b"\0" * (-len(head) % 64) + np.arange(6, dtype="<f4").tobytes())
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    tensor = bytes([8, 3, 16, 7]) + field(8, b"t") + field(7, bytes([1, 2, 150, 1]))
    (tmp_path / "m.onnx").write_bytes(bytes([8, 9]) + field(7, field(5, tensor)))
    g = T.read_tensors(spark, str(tmp_path / "m.gguf")).first()
    assert (g.name, g["shape"], g.dtype) == ("w", [2, 3], "F32") and np.frombuffer(bytes(g.data), "<f4").tolist() == [0, 1, 2, 3, 4, 5]
    o = T.read_tensors(spark, str(tmp_path / "m.onnx")).first()
    assert (o.name, o["shape"], o.dtype) == ("t", [3], "I64") and np.frombuffer(bytes(o.data), "<i8").tolist() == [1, 2, 150]


def test_command_line(spark, tmp_path, capsys):
    from loamsift.__main__ import main

    p = tmp_path / "d.jsonl"
    lines = [json.dumps({"text": t, "more": k}) for k, t in enumerate(["one two three four five six seven"] * 3 + ["quite another text of words"])]
    p.write_text("\n".join(lines) + "\n")
    for k, mode in enumerate([[], ["--streaming"], ["--incremental", "--index-path", str(tmp_path / "i")], ["--semantic"], ["--hybrid"]]):
        out = str(tmp_path / f"out{k}")
        assert main([str(p), "-o", out, "--json", *mode]) == 0
        assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["unique_docs"] == 2
        assert [r.value for r in spark.read.text(out).collect()] == [lines[0], lines[3]]
    main([str(p), "--stats-only", "--json", "--incremental", "--index-path", str(tmp_path / "i")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["duplicates"] == 4
    for bad in ([str(p)], [str(p), "-o", "x", "--incremental"]):
        with pytest.raises(SystemExit):
            main(bad)


def test_classes(spark):
    from loamsift.api import Deduplicator, HybridDeduplicator, SemanticDeduplicator, texts_frame
    from loamsift.functions.vectors import mock_embedding

    d = Deduplicator()
    assert d.similarity("a b c d e f", "a b c d e f") == 1.0 == d.similarity("", "") and d.deduplicate_texts(spark, ["x y", "x y", "z"]).keep().count() == 2
    docs = texts_frame(spark, ["x y", "x y", "z"])
    assert SemanticDeduplicator(embed=mock_embedding).deduplicate(docs).count() == 2 == HybridDeduplicator(embed=mock_embedding).deduplicate(docs).count()


def test_what_is_written_leaves_no_shuffle_files(spark):
    from loamsift.session import materialize

    env = spark._jvm.org.apache.spark.SparkEnv.get()
    held = lambda: {x for x in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = held()
    d = materialize(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("a")).count(), "counts")
    until = time.monotonic() + 20
    while held() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not held() - before
    assert d.count() == 7
