"""The tree of digests: one byte, one file, one folder."""

import hashlib
import random

from tidemark.operators.corpus import Corpus
from tidemark.sources import audit


def parts(path):
    return sorted(p for p in path.rglob("part-*"))


def test_one_byte_names_one_block(spark, tmp_path):
    rng = random.Random(1)
    for name, size in (("a/x=1/part-0", 2500), ("a/x=1/part-1", 0), ("a/x=2/part-0", 1000), ("b/part-0", 1001), ("part-9", 3)):
        p = tmp_path / "d" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(rng.randbytes(size))
    root = f"file://{tmp_path}/d"
    look = lambda: audit.tree(audit.leaves(spark, root, block=1000))
    rows = {(r.level, r.name): r for r in look().collect()}
    assert {n for k, n in rows if k == "block"} == {"a/x=1/part-0#0", "a/x=1/part-0#1", "a/x=1/part-0#2", "a/x=2/part-0#0", "b/part-0#0", "b/part-0#1", "part-9#0"}
    data = (tmp_path / "d/a/x=1/part-0").read_bytes()
    assert [rows["block", f"a/x=1/part-0#{k}"].digest for k in range(3)] == [hashlib.sha256(data[k * 1000 : k * 1000 + 1000]).hexdigest() for k in range(3)]
    assert rows["root", ""].bytes == 4504 and rows["folder", "a"].bytes == 3500 and {n for k, n in rows if k == "folder"} == {"a", "a/x=1", "a/x=2", "b"}
    before = spark.createDataFrame(list(rows.values()), audit.NODES)
    assert audit.changes(before, look()).count() == 0
    bad = bytearray(data)
    bad[1700] ^= 1
    (tmp_path / "d/a/x=1/part-0").write_bytes(bad)
    told = lambda: {(r.level, r.name, r.change) for r in audit.changes(before, look()).collect()}
    assert told() == {("block", "a/x=1/part-0#1", "changed"), ("file", "a/x=1/part-0", "changed"), ("folder", "a/x=1", "changed"), ("folder", "a", "changed"), ("root", "", "changed")}
    (tmp_path / "d/a/x=1/part-0").write_bytes(data)
    (tmp_path / "d/b/part-0").rename(tmp_path / "d/b/part-1")
    assert {(k, n, c) for k, n, c in told() if k == "file"} == {("file", "b/part-0", "gone"), ("file", "b/part-1", "added")}


def test_a_sealed_run(spark, tmp_path):
    c = Corpus(spark, f"file://{tmp_path}/c")
    for run in ("r1", "r2"):
        c.publish({"events": spark.range(100), "scores": spark.range(9)}, run)
        c.seal(run)
    assert c.tampered("r1").count() == 0
    at = parts(tmp_path / "c" / "events" / "run_id=r1")[0]
    data = bytearray(at.read_bytes())
    data[20] ^= 1
    at.write_bytes(data)
    crc = at.with_name(f".{at.name}.crc")
    crc.unlink(missing_ok=True)
    got = {(r.level, r.name) for r in c.tampered("r1").collect()}
    name = str(at.relative_to(tmp_path / "c"))
    assert got == {("block", f"{name}#0"), ("file", name), ("folder", "events/run_id=r1"), ("folder", "events"), ("root", "")}
    assert c.tampered("r2").count() == 0
