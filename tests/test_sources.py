import io
import json
import tarfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.operators.dedup import hash_corpus
from lakeloom.sources import archive, readers, tree
from lakeloom.streaming import metadata as streamed


def test_metadata_by_name_not_place(spark, tmp_path):
    order = list(reversed(readers.METADATA))
    head = ",".join(order)
    values = {"submission_id": "s1", "problem_id": "p00001", "user_id": "u1", "date": "5", "language": "C++", "original_language": "NA", "filename_ext": "cpp", "status": "Accepted", "cpu_time": "", "memory": "-1", "code_size": "12"}
    (tmp_path / "p00001.csv").write_text(head + "\n" + ",".join(values[c] for c in order) + "\n")
    (tmp_path / "problem_list.csv").write_text("id,dataset,name\np00001,AIZU,x\n")
    row = readers.read_metadata(spark, str(tmp_path)).first()
    assert row.submission_id == "s1" and row.cpu_time is None and row.memory == -1 and row.original_language == "NA"
    dim = readers.read_dimension(spark, str(tmp_path / "problem_list.csv"), {"id": "string", "dataset": "string"})
    assert tuple(dim.first()) == ("p00001", "AIZU")
    other = order[3:] + ["extra"] + order[:3]
    (tmp_path / "p00003.csv").write_text(",".join(other) + "\n" + ",".join({**values, "extra": "7", "submission_id": "s3", "code_size": "99"}[c] for c in other) + "\n")
    assert {(r.submission_id, r.code_size, r.memory) for r in readers.read_metadata(spark, str(tmp_path)).collect()} == {("s1", 12, -1), ("s3", 99, -1)}
    with pytest.raises(FileNotFoundError):
        readers.read_metadata(spark, str(tmp_path), "q*.csv")
    (tmp_path / "p00002.csv").write_text("submission_id\nx\n")
    with pytest.raises(KeyError):
        readers.read_metadata(spark, str(tmp_path), "p00002.csv")


def test_files_lines_and_sinks(spark, tmp_path):
    files = spark.createDataFrame([("a/C++/1.cpp", bytearray(b"int x;")), ("b/C++/2.cpp", bytearray(b"\xff")), ("b/C++/none at all.cpp", bytearray())], "path string, content binary")
    readers.write_tree(files, str(tmp_path / "tree"))
    back = {r.path: (r.length, bytes(r.content)) for r in readers.read_files(spark, str(tmp_path / "tree")).collect()}
    assert back == {"a/C++/1.cpp": (6, b"int x;"), "b/C++/2.cpp": (1, b"\xff"), "b/C++/none at all.cpp": (0, b"")}
    hashes = hash_corpus(files.select("path"), readers.read_files(spark, str(tmp_path / "tree")))
    assert hashes.where("exists").count() == 3
    readers.write_lines(files, "path", str(tmp_path / "wanted"))
    assert readers.read_lines(spark, str(tmp_path / "wanted"), "p").count() == 3
    readers.write_parquet(files, str(tmp_path / "t"))
    readers.write_report(files.select("path"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 3
    readers.write_config({"a": 1}, tmp_path / "c.json")
    assert json.loads((tmp_path / "c.json").read_text()) == {"a": 1}
    readers.copy_file(spark, str(tmp_path / "c.json"), str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").exists()
    with pytest.raises(FileNotFoundError):
        readers.load_config(tmp_path / "none.yaml")


def test_archive(spark, tmp_path):
    path = tmp_path / "a.tar.gz"
    with tarfile.open(path, "w:gz") as tar:
        for k in range(6):
            info = tarfile.TarInfo(f"root/data/{k}.cpp")
            info.size = k
            tar.addfile(info, io.BytesIO(b"x" * k))
        folder = tarfile.TarInfo("root/data/folder")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
    files, report = archive.extraction(spark, str(path), ["root/data/1.cpp", "root/data/3.cpp", "root/data/folder", "root/data/none"], "root/data/")
    assert {(r.path, bytes(r.content)) for r in files.collect()} == {("1.cpp", b"x"), ("3.cpp", b"xxx")}
    assert report.first().asDict() == {"wanted": 4, "extracted": 2, "shortfall": 2, "not_regular": 1, "members_scanned": 7, "bytes_written": 4}
    early = archive.read_members(spark, str(path), ["root/data/0.cpp", "root/data/1.cpp"])
    assert early.agg(F.max("scanned")).first()[0] == 2  # ends at the last wanted member
    dry = archive.dry_run(spark, str(path), [f"root/data/{k}.cpp" for k in range(6)], path.stat().st_size, 0.5).first()
    assert dry.target == dry.found == 3 and dry.reached and dry.elapsed_s > 0 and dry.linear_projection_s == 2 * dry.elapsed_s
    short = archive.dry_run(spark, str(path), ["root/data/5.cpp", "none", "nor this", "nor that"], path.stat().st_size, 0.5).first()
    assert (short.target, short.found, short.reached, short.members_scanned) == (2, 1, False, 6)


def tarred(path, names):
    with tarfile.open(path, "w:gz") as tar:
        for k, name in enumerate(names):
            info = tarfile.TarInfo(name)
            info.size = k + 1
            tar.addfile(info, io.BytesIO(b"x" * (k + 1)))


def test_repeated_members_count_once(spark, tmp_path):
    tarred(tmp_path / "a.tar.gz", ["a", "a", "b", "c", "a"])
    files, report = archive.extraction(spark, str(tmp_path / "a.tar.gz"), ["a", "b"], "")
    assert sorted((r.path, r.length) for r in files.collect()) == [("a", 1), ("b", 3)]
    assert report.first().asDict() == {"wanted": 2, "extracted": 2, "shortfall": 0, "not_regular": 0, "members_scanned": 3, "bytes_written": 4}
    assert archive.read_members(spark, str(tmp_path / "a.tar.gz")).count() == 5


def test_predicates_on_members_are_pushed(spark, tmp_path, capsys):
    for k in range(3):
        tarred(tmp_path / f"{k}.tar.gz", [f"p{k}/1.cpp", f"p{k}/2.txt", f"p{k}/3.cpp", "q/%_\\n'.cpp"])
    listed = archive.read_members(spark, str(tmp_path), content=False)
    assert listed.columns == ["name", "size", "regular", "scanned", "bytes_seen"]
    wanted = archive.read_members(spark, str(tmp_path), content=False, where=F.col("name").isin("p1/1.cpp", "p2/1.cpp"))
    assert {(r.name, r.scanned) for r in wanted.collect()} == {("p1/1.cpp", 1), ("p2/1.cpp", 1)}
    assert wanted.where("name = 'p0/1.cpp'").count() == 0 and wanted.where("name = 'p1/1.cpp'").count() == 1 and wanted.count() == 2
    assert wanted.alias("a").join(wanted.where("name like 'p2%'").alias("b"), F.col("a.scanned") == F.col("b.scanned")).count() == 2
    for test, names in (
        (F.col("name") == "p1/1.cpp", {"p1/1.cpp"}),
        (F.col("name").startswith("p2/") & F.col("name").endswith(".cpp"), {"p2/1.cpp", "p2/3.cpp"}),
        (F.col("name").contains("2.t") & (F.col("size") > 1), {"p0/2.txt", "p1/2.txt", "p2/2.txt"}),
        ((F.col("name") == "p0/3.cpp") | (F.col("size") == 1), {"p0/3.cpp", "p0/1.cpp", "p1/1.cpp", "p2/1.cpp"}),
        (~F.col("name").like("p%"), {"q/%_\\n'.cpp"}),
        ((F.col("name") == "p1/1.cpp") & (F.col("name") == "p2/1.cpp"), set()),
    ):
        assert {r.name for r in listed.where(test).collect()} == names
        assert {r.name for r in archive.read_members(spark, str(tmp_path), where=test).collect()} == names
    assert listed.count() == 12
    archive.read_members(spark, str(tmp_path), where=F.col("name").startswith("p2/")).explain("formatted")
    assert "StringStartsWith(name,p2/)" in capsys.readouterr().out.split("PushedFilters")[1]


def test_archives_are_written_whole(spark, tmp_path):
    rows = [(f"d/{k}", bytearray(bytes([k]) * k)) for k in range(50)] + [("d/none", None)]
    members = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    archive.write_archives(members, str(tmp_path / "out"))
    archive.write_archives(members.limit(1), str(tmp_path / "out"))
    assert all(p.name.endswith(".tar.gz") for p in (tmp_path / "out").iterdir())
    back = archive.read_members(spark, str(tmp_path / "out"))
    assert back.count() == 52
    assert {(r.name, bytes(r.content)) for r in back.collect()} == {(n, bytes(c or b"")) for n, c in rows}


def names(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file()) if folder.exists() else []


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    files = spark.range(200).select(F.concat(F.lit("d"), (F.col("id") % 7).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 150, F.raise_error(F.lit("broken"))).otherwise(F.lit("new")).cast("binary").alias("content"), "id").repartition(5, "id")
    readers.write_tree(files.where("id < 20").withColumn("content", F.lit(b"old")), str(tmp_path / "t"))
    before = names(tmp_path / "t")
    assert len(before) == 20
    with pytest.raises(Exception, match="broken"):
        readers.write_tree(files, str(tmp_path / "t"))
    assert names(tmp_path / "t") == before and all((tmp_path / "t" / n).read_bytes() == b"old" for n in before)
    readers.write_tree(files.where("id < 100"), str(tmp_path / "t"))
    assert len(names(tmp_path / "t")) == 100 and all((tmp_path / "t" / n).read_bytes() == b"new" for n in before)


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    batch = lambda *rows: pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])

    def breaks_off():
        yield batch(("a/1", b"torn"), ("a/2", b"torn"))
        raise OSError("executor lost")

    writer = tree.TreeWriter(str(tmp_path / "t"))
    with pytest.raises(OSError):
        writer.write(breaks_off())
    first, twice, other = writer.write(iter([batch(("a/1", b"1"), ("b", b"2"))])), writer.write(iter([batch(("a/1", b"1"), ("b", b"2"))])), writer.write(iter([batch(("a/2", b"3"))]))
    assert (first.files, first.size, twice.files) == (2, 2, 2)  # a speculative copy, of which one counts
    writer.commit([first, other, None])
    assert {n: (tmp_path / "t" / n).read_bytes() for n in names(tmp_path / "t")} == {"a/1": b"1", "a/2": b"3", "b": b"2"}
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["a", "b"]


def test_bad_paths_and_repeated_ones(spark, tmp_path):
    files = spark.createDataFrame([("a/1", bytearray(b"x")), ("b/1", bytearray(b"y"))], "path string, content binary").repartition(2, "path")
    for bad in ("../../x", "/x", "", "a/../..", None):
        with pytest.raises(Exception, match="leaves the folder"):
            readers.write_tree(files.withColumn("path", F.lit(bad).cast("string")), str(tmp_path / "t"))
    for same in (files.withColumn("path", F.lit("one")), files.unionByName(files), files.withColumn("path", F.concat(F.lit("a/b/./"), F.lit("c")))):
        with pytest.raises(Exception, match="written twice"):
            readers.write_tree(same, str(tmp_path / "t"))
    assert names(tmp_path / "t") == []


def test_listing(spark, tmp_path):
    for name, content in {"top.cpp": b"1", "a/x y.cpp": b"22", "a/b/c/deep.cpp": b"", "a/b/other.txt": b"4\nrest", "z/packed.gz.cpp": b"7", "100%25/é+.cpp": b"\xff", "_attempts-1/torn.cpp": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path: (r.length, bytes(r.content)) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got == {"top.cpp": (1, b"1"), "a/x y.cpp": (2, b"22"), "a/b/c/deep.cpp": (0, b""), "100%25/é+.cpp": (1, b"\xff"), "z/packed.gz.cpp": (1, b"7")}
    listed = tree.list_tree(spark, f"file://{tmp_path}".replace("%", "%25"), "*", "path string, head string")
    assert {(r.path, r["head"]) for r in listed.collect() if "other" in r.path or "deep" in r.path} == {("a/b/other.txt", "4"), ("a/b/c/deep.cpp", "")}
    reader = tree.TreeReader({"path": str(tmp_path)}, listed.schema)
    told = [p.value[0] for p in reader.partitions()]
    assert sorted({f for folders in told for f in folders}) == ["", "100%25", "a", "z"] and len(told) == 4 * tree.SHARES


def test_new_metadata_files_land_once(spark, tmp_path):
    folder, args = tmp_path / "in", [str(tmp_path / x) for x in ("in", "out", "checkpoint")]
    folder.mkdir()
    order = list(readers.METADATA)

    def put(name, columns, ids):
        rows = [",".join({**dict.fromkeys(order, "3"), "submission_id": str(k), "status": "Accepted"}.get(c, "") for c in columns) for k in ids]
        (folder / name).write_text("\n".join([",".join(columns), *rows]) + "\n")

    put("p00001.csv", order, range(5))
    put("p00002.csv", list(reversed(order)), range(5, 9))
    (folder / "p00003.csv").write_text("")
    assert streamed.append_new_metadata(spark, *args) == 1
    assert sorted(int(r.submission_id) for r in streamed.landed_metadata(spark, args[1]).collect()) == list(range(9))
    assert streamed.append_new_metadata(spark, *args) == 0
    put("p00004.csv", [*order[4:], "more", *order[:4]], range(9, 12))
    assert streamed.append_new_metadata(spark, *args) == 1
    landed, whole = streamed.landed_metadata(spark, args[1]), readers.read_metadata(spark, args[0])
    assert landed.count() == 12 and landed.exceptAll(whole).isEmpty() and whole.exceptAll(landed).isEmpty()
    (last,) = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"))[-1:]
    last.unlink()  # as if the run had broken off after its last write
    (tmp_path / "checkpoint" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    assert streamed.append_new_metadata(spark, *args) == 1
    assert streamed.landed_metadata(spark, args[1]).count() == 12
    (folder / "p00005.csv").write_text("submission_id\n1\n")
    with pytest.raises(Exception, match="lack columns"):
        streamed.append_new_metadata(spark, *args)
