"""Byte ranges: records over range borders, digests as a tree, large files."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from marlstone.sources import ranges


def tree(data, block, fan):
    nodes = [sha256(data[i:i + block]).hexdigest() for i in range(0, len(data), block)]
    while len(nodes) > 1:
        nodes = [sha256("".join(nodes[i:i + fan]).encode()).hexdigest() if len(nodes[i:i + fan]) > 1 or i else nodes[i] for i in range(0, len(nodes), fan)]
    return nodes[0]


def identity(lines):
    return [(line.hex(), 1) for line in lines]


CASES = {"plain.txt": b"one\ntwo\n\nthree and more\n", "open.txt": b"a\nb", "empty.txt": b"", "newline.txt": b"\n", "long.txt": b"x" * 100 + b"\ny\n" + b"z" * 57,
         "bytes.txt": bytes(range(256)) * 3, "with space.txt": b"\n\n\nq"}


@pytest.fixture()
def folder(tmp_path):
    for name, data in CASES.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_records_do_not_depend_on_ranges(spark, folder, size):
    rows = ranges.map_records(ranges.split_files(spark, folder, "*.txt", size), identity, "line string, n long")
    got = {}
    for r in rows.groupBy("path", "line").agg(F.sum("n").alias("n")).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], {})[bytes.fromhex(r["line"])] = r["n"]
    for name, data in CASES.items():
        lines = data.split(b"\n")
        lines = lines[:-1] if not lines[-1] else lines
        assert got.get(name, {}) == {line: lines.count(line) for line in lines}, name


@pytest.mark.parametrize("size,block,fan", [(8, 8, 2), (16, 8, 3), (1 << 20, 8, 2), (1 << 20, 1 << 20, 1024)])
def test_digests_do_not_depend_on_ranges(spark, folder, size, block, fan):
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["digest"]) for r in ranges.tree_digests(ranges.split_files(spark, folder, "*", size), block, fan).collect()}
    assert got == {name: (len(data), tree(data, block, fan)) for name, data in CASES.items() if data}


def test_ranges_reject_what_they_cannot_do(spark, folder):
    with pytest.raises(ValueError, match="multiples"):
        ranges.tree_digests(ranges.split_files(spark, folder, "*", 7), 8)
    with pytest.raises(ValueError, match="one byte"):
        ranges.map_records(ranges.split_files(spark, folder), identity, "line string, n long", b"\r\n")


def test_file_beyond_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "big.bin", "wb") as f:  # sparse: holes are zeros
        f.truncate((2 << 30) + 5)
        f.seek((2 << 30) - 3)
        f.write(b"a\nbc\nde")
    parts = ranges.split_files(spark, str(tmp_path), size=256 << 20)
    assert parts.count() == 9 and parts.agg(F.sum("length")).first()[0] == (2 << 30) + 5
    tail = ranges.map_ranges(parts.filter("part >= 7"), lambda at, data: [(at, len(data), data[-4:].hex())], "at long, n long, last string")
    assert [(r["at"], r["n"], r["last"]) for r in tail.orderBy("part").collect()] == [(7 * (256 << 20), 256 << 20, b"\0a\nb".hex()), (2 << 30, 5, b"\nde\0".hex())]


def test_manifest_of_large_files_reads_ranges(spark, tmp_path):
    """F16: a file was one row with its whole content, read by one task."""
    from marlstone.sources.manifest import file_manifest, staged
    data = b"PAR1" + bytes(range(256)) * 12_000  # three blocks
    for name, content in (("a.bin", data), ("b.bin", data), ("c.bin", data[:-1] + b"x"), ("small.bin", b"PAR1small"), ("none.bin", b"")):
        (tmp_path / name).write_bytes(content)
    kept = file_manifest(spark, str(tmp_path), "*.bin", whole=1 << 20)
    got = {r["path"].rsplit("/", 1)[1]: r for r in kept.collect()}
    was = {r["path"].rsplit("/", 1)[1]: r for r in file_manifest(spark, str(tmp_path), "*.bin").collect()}
    assert {n: (r["path"], r["bytes"], r["file_type"]) for n, r in got.items()} == {n: (r["path"], r["bytes"], r["file_type"]) for n, r in was.items()}
    assert got["a.bin"]["digest"] == got["b.bin"]["digest"] != got["c.bin"]["digest"] and got["a.bin"]["digest"].startswith("tree:")
    assert got["small.bin"]["digest"] == was["small.bin"]["digest"]
    state = {r["path"].rsplit("/", 1)[1]: r["analyzed"] for r in staged(kept, ["parquet"], 10 ** 9).collect()}
    assert state["a.bin"] == "unique" and state["b.bin"] == "duplicate" and state["c.bin"] == "unique"
