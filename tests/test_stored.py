"""Files and snapshots against what the file system says."""

import hashlib
import os
import threading

from curatrix.sources import stored as Z
from curatrix.sources.files import shared_path


def local(path):
    return path.removeprefix("file://")


def test_files_are_written_whole_and_in_order(spark):
    root = shared_path(spark, "t")
    parts = [("a/b.txt", 2, b"two"), ("a/b.txt", 1, b"one"), ("c.txt", 1, None), (None, 1, b"x"), ("d e.bin", 10, b"\xff" * 9_000_000), ("d e.bin", 9, b"\x00")]
    told = {r.path: (r.length, r.sha256) for r in Z.write_files(spark.createDataFrame(parts, "path string, part int, content binary"), root).collect()}
    want = {"a/b.txt": b"onetwo", "c.txt": b"", "d e.bin": b"\x00" + b"\xff" * 9_000_000}
    assert told == {p: (len(c), hashlib.sha256(c).hexdigest()) for p, c in want.items()}
    for p, c in want.items():
        assert open(f"{local(root)}/{p}", "rb").read() == c
    assert {r.path: (r.length, r.sha256) for r in Z.file_digests(spark, root).collect()} == told
    os.makedirs(f"{local(root)}/a/none")
    listed = {tuple(r) for r in Z.list_tree(spark, root).collect()}
    assert listed == {("a", "folder", None), ("a/none", "folder", None), ("a/none", "empty folder", None), *((p, "file", len(c)) for p, c in want.items())}
    assert not [n for _, _, names in os.walk(local(root)) for n in names if n.startswith("_")]


def test_audit_tells_each_problem(spark):
    root = shared_path(spark, "t")
    content = spark.createDataFrame([(p, 1, p * 10) for p in ("same", "size", "bytes", "extra", "model/m.bin", "m.bin")], "path string, part int, content string")
    told = [tuple(r) for r in Z.write_files(content, root).where("path <> 'extra'").collect()]
    open(f"{local(root)}/size", "a").write("x")
    open(f"{local(root)}/bytes", "r+").write("X")
    told += [("gone", 1, "0"), ("../up", 1, "0"), ("/top", 1, "0"), (None, 1, "0")]
    manifest = spark.createDataFrame(told, "path string, size_bytes long, sha256 string")
    found = {tuple(r) for r in Z.audit_files(manifest, Z.file_digests(spark, root), largest=100).collect()}
    assert found == {
        ("size", "size differs"), ("size", "digest differs"), ("bytes", "digest differs"), ("extra", "untracked"), ("gone", "missing"),
        ("model/m.bin", "too large"), ("../up", "bad path"), ("/top", "bad path"), (None, "bad path"),
    }
    os.makedirs(f"{local(root)}-empty")
    assert Z.file_digests(spark, f"{root}-empty").count() == 0
    assert {r.problem for r in Z.audit_files(manifest.where("path in ('same', 'size')"), Z.file_digests(spark, f"{root}-empty")).collect()} == {"missing"}


def test_a_number_is_published_once(spark):
    root = shared_path(spark, "t")
    os.makedirs(local(root))
    assert Z.publish(spark, "one", f"{root}/1.json") and not Z.publish(spark, "two", f"{root}/1.json")
    assert os.listdir(local(root)) == ["1.json"] and open(f"{local(root)}/1.json").read() == "one"


def test_snapshots(spark):
    root = shared_path(spark, "t")
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "")], "k int, `v.x` string")
    first, new = Z.append_snapshot(spark, root, "s", {"t": rows})
    assert new and (first.snapshot_id, first.number, first.tables[0].n_rows) == ("s", 1, 4)
    again, new = Z.append_snapshot(spark, root, "other", {"t": rows.orderBy("k", ascending=False)})
    assert not new and again.snapshot_id == "s"
    assert len(os.listdir(f"{local(root)}/data")) == 1
    ids = [Z.append_snapshot(spark, root, "s", {"t": rows.where(f"k < {k}")})[0].snapshot_id for k in (3, 2, 1)]
    assert ids == ["s-v2", "s-v3", "s-v4"]  # the last one is empty
    assert Z.append_snapshot(spark, root, "s-v2", {"t": rows, "u": rows})[0].snapshot_id == "s-v2-v2"
    assert sorted(map(str, Z.read_snapshot(spark, root, "s", "t").collect())) == sorted(map(str, rows.collect()))


def test_writers_at_once(spark):
    root = shared_path(spark, "t")
    tables = [spark.range(n % 2 + 1) for n in range(4)]
    done = []
    threads = [threading.Thread(target=lambda t=t: done.append(Z.append_snapshot(spark, root, "s", {"t": t}))) for t in tables]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    index = sorted((r.number, r.snapshot_id, r.tables[0].n_rows) for r in Z.snapshot_index(spark, root).collect())
    assert sum(new for _, new in done) == 2 and len(done) == 4
    assert [(n, i) for n, i, _ in index] == [(1, "s"), (2, "s-v2")] and {r for _, _, r in index} == {1, 2}
