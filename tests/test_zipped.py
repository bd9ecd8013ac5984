"""Zip members as a table: the rows of plain files, a partition a member, columns pruned, broken members named."""

import zipfile

import pytest

from prospector.sources import registry, zipped

COLUMNS = ["root", "name", "note"]


def text(rows):
    return "".join(";".join('"' + (c or "").replace('"', '""') + '"' for c in r) + "\n" for r in rows)


def archive(path, members, **options):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, **options) as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_members_are_rows_of_plain_files(spark, tmp_path):
    members = {f"part{i}.csv": text([(f"{i}{j:05d}", rf"São {j} \ barra", 'a "b"; c' if j % 7 else " ") for j in range(3000)]).encode("latin1") for i in range(3)}
    archive(tmp_path / "a.zip", {"part0.csv": members["part0.csv"], "part1.csv": members["part1.csv"], "readme.txt": b"no rows here"})
    archive(tmp_path / "b.zip", {"part2.csv": members["part2.csv"], "empty.csv": b"", "short.csv": text([("1", "2")]).encode() + text([("x", "y", "z"), ("1", "2", "3", "4")]).encode()})
    for name, data in members.items():
        (tmp_path / name).write_bytes(data)
    got = zipped.read_zipped(spark, f"{tmp_path}/*.zip", COLUMNS, members="*.csv")
    assert got.rdd.getNumPartitions() == 5
    want = registry.read_raw(spark, f"{tmp_path}/part*.csv", COLUMNS)
    assert sorted(map(str, got.where("root <> 'x'").collect())) == sorted(map(str, want.collect()))
    assert [tuple(r) for r in got.where("root = 'x'").collect()] == [("x", "y", "z")]
    one = zipped.read_zipped(spark, f"{tmp_path}/a.zip", COLUMNS, ["note", "_member"], "part1*")
    assert one.columns == ["note", "_member"] and one.count() == 3000 and {tuple(r) for r in one.distinct().collect()} == {('a "b"; c', "part1.csv"), (None, "part1.csv")}
    assert zipped.read_zipped(spark, f"{tmp_path}/none*.zip", COLUMNS).count() == 0
    with pytest.raises(ValueError):
        zipped.read_zipped(spark, f"{tmp_path}/a.zip", COLUMNS, ["nothing"])


def test_a_broken_member_is_named(spark, tmp_path):
    archive(tmp_path / "c.zip", {"fine.csv": text([("1", "2", "3")]), "torn.csv": text([(str(i * 7919), "x" * (i % 50), "y") for i in range(5000)])})
    data = bytearray((tmp_path / "c.zip").read_bytes())
    at = data.index(b"torn.csv") + 3000
    data[at : at + 40] = bytes(40)
    (tmp_path / "c.zip").write_bytes(bytes(data))
    with pytest.raises(Exception, match=r"member torn\.csv of .*c\.zip"):
        zipped.read_zipped(spark, f"{tmp_path}/c.zip", COLUMNS).collect()
    assert zipped.read_zipped(spark, f"{tmp_path}/c.zip", COLUMNS, members="fine*").count() == 1
    (tmp_path / "d.zip").write_bytes(b"not an archive")
    with pytest.raises(Exception, match=r"d\.zip"):
        zipped.read_zipped(spark, f"{tmp_path}/d.zip", COLUMNS).collect()
