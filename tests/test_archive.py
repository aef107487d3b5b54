"""Writing, reading, appending, extracting and streaming real archives."""

import os
import pickle

import pytest
from pyspark.sql import functions as F

from stowage.functions.udfs import register_functions
from stowage.sources import archive, sink
from stowage.sources.errors import ArchiveError, ExtractError, OpenError
from stowage.streaming import directory

SCHEMA = "path string, record_type string, content binary, target string, external_target string, position int"


@pytest.fixture()
def made(spark, tmp_path):
    archive.register(spark)
    path = str(tmp_path / "one.arc")
    rows = [
        ("dir\x1finner\x1fdeep.txt", "file", bytes(range(256)) * 17, None, None, 1),
        ("small.txt", "file", b"short", None, None, 2),
        ("empty.txt", "file", b"", None, None, 3),
        ("dir\x1fbig.bin", "chunked_file", bytes(range(251)) * 1200, None, None, 4),
        ("dir\x1fup", "link", None, "small.txt", None, 5),
    ]
    sink.write(spark.createDataFrame(rows, SCHEMA), path, alignment=512, block_size=65536)
    return path, {r[0]: r[2] for r in rows if r[2] is not None}


def contents(spark, path):
    c = archive.load(spark, path, "contents").join(archive.load(spark, path, "paths"), ["archive_id", "record_index"])
    return {r["path"]: bytes(r["content"]) for r in c.select("path", "content").collect()}


def test_round_trip(spark, made):
    path, files = made
    assert contents(spark, path) == files
    records = archive.load(spark, path, "records")
    assert {r["record_type"] for r in records.collect()} == {"directory", "file", "chunked_file", "link"}
    assert all(r["data_offset"] % 512 == 0 for r in records.where("data_offset IS NOT NULL").collect())
    assert records.where("decompressed_length < 96 AND compression <> 'stored'").count() == 0
    assert archive.load(spark, path, "blocks").count() == -(-251 * 1200 // 65536)
    got = sink.validate(spark, path).first()
    assert (got["files_checked"], got["files_without_checksum"], got["checksum_failures"]) == (4, 0, 0)


def test_pushed_filters(spark, made):
    path, _ = made
    paths = archive.load(spark, path, "paths")
    assert [r["path"] for r in paths.where("path = 'small.txt'").collect()] == ["small.txt"]
    assert paths.where(F.col("path").startswith("dir\x1f")).count() == 4
    assert paths.where("path = 'nothing'").count() == 0


def test_attributes_of_members_and_of_the_archive_together(spark, made):
    path, _ = made
    sink.set_attributes(path, {"note": ("string", b"whole")})
    sink.set_attributes(path, {"note": ("string", b"one")}, "small.txt")
    attrs = archive.load(spark, path, "attrs").where("key = 'note'")
    own, top = attrs.where("record_index IS NOT NULL"), attrs.where("record_index IS NULL")
    both = own.select("archive_id", F.col("v_string").alias("a")).join(top.select("archive_id", F.col("v_string").alias("b")), "archive_id")
    assert [tuple(r) for r in both.select("a", "b").collect()] == [("one", "whole")]


def test_append_and_errors(spark, made):
    path, files = made
    more = spark.createDataFrame([("dir\x1fadded.txt", "file", b"added later " * 20)], "path string, record_type string, content binary")
    sink.write(more, path, append=True)
    assert contents(spark, path) == files | {"dir\x1fadded.txt": b"added later " * 20}
    before = open(path, "rb").read()
    for bad in (more, spark.createDataFrame([("x", "link", "nowhere")], "path string, record_type string, target string"), spark.createDataFrame([("small.txt\x1fy", "file", b"z")], "path string, record_type string, content binary")):
        with pytest.raises(Exception, match="there already|isn't"):
            sink.write(bad, path, append=True)
        assert open(path, "rb").read() == before
    assert [f for f in os.listdir(os.path.dirname(path)) if "parts" in f or "draft" in f] == []


def test_damaged_payload(spark, made):
    path, _ = made
    at = archive.load(spark, path, "records").where("name = 'small.txt'").first()["data_offset"]
    raw = bytearray(open(path, "rb").read())
    raw[at] ^= 1
    open(path, "wb").write(raw)
    assert sink.validate(spark, path).first()["checksum_failures"] == 1


def test_extract(spark, made, tmp_path):
    path, files = made
    to = str(tmp_path / "out")
    stats = sink.extract(spark, path, to)
    assert stats["files"] == 4 and stats["links"] == 1 and stats["checksum_failures"] == 0
    for p, body in files.items():
        assert open(os.path.join(to, *p.split("\x1f")), "rb").read() == body
    assert os.readlink(os.path.join(to, "dir", "up")) == "../small.txt"
    with pytest.raises(ExtractError):
        sink.extract(spark, path, str(tmp_path / "none"), members=["missing"])


def test_extract_restores_modes_and_reads_members_only(spark, tmp_path):
    from stowage.sources.wire import encode_value

    archive.register(spark)
    path, to = str(tmp_path / "m.arc"), str(tmp_path / "m")
    mode = lambda m: {"unix.mode": encode_value("vu32", m)}
    rows = [
        ("open\x1fa.sh", "file", b"run " * 50, mode(0o100750) | {"linux.xattr.user.note": b"kept"}), ("open\x1fb.txt", "file", b"text " * 50, {}), ("closed", "directory", None, mode(0o40500)), ("closed\x1fc", "file", b"c", mode(0o100400)),
    ]
    sink.write(spark.createDataFrame(rows, "path string, record_type string, content binary, attrs map<string,binary>"), path, archive_attrs={"unix.mode": ("vu32", encode_value("vu32", 0o100604))})
    stats = sink.extract(spark, path, to, xattrs=True)
    bits = lambda *p: os.stat(os.path.join(to, *p)).st_mode & 0o7777
    # the record's mode, else the archive's
    assert (bits("open", "a.sh"), bits("open", "b.txt"), bits("closed"), bits("closed", "c")) == (0o750, 0o604, 0o500, 0o400) and stats["files"] == 3
    try:
        assert os.getxattr(os.path.join(to, "open", "a.sh"), "user.note") == b"kept"
    except OSError:
        pass  # a file system without extended attributes
    os.chmod(os.path.join(to, "closed"), 0o700)
    # one member: the payloads of others may be damaged
    at = archive.load(spark, path, "records").where("name = 'b.txt'").first()["data_offset"]
    raw = bytearray(open(path, "rb").read())
    raw[at : at + 8] = b"\0" * 8
    open(path, "wb").write(raw)
    only = sink.extract(spark, path, str(tmp_path / "one"), members=["open\x1fa.sh"])
    assert only["files"] == 1 and os.path.exists(tmp_path / "one" / "open" / "a.sh") and not os.path.exists(tmp_path / "one" / "closed")


def test_the_driver_holds_no_entries(spark, tmp_path, monkeypatch):
    """Entries go from the tasks to a task by files; the driver gets the parts' names and publishes the draft."""
    archive.register(spark)
    monkeypatch.setattr(sink, "layout", lambda *_: (_ for _ in ()).throw(AssertionError("laid out by the driver")))
    path = str(tmp_path / "w.arc")
    rows = spark.range(3000).selectExpr("concat('d', id % 7, '\x1ff', id) AS path", "encode(repeat('text ', 400), 'UTF-8') AS content", "id AS position")
    sink.write(rows, path, chunked=True, block_size=512)
    blocks = archive.load(spark, path, "blocks")
    assert blocks.count() == 12000 and blocks.where("record_index = 8").count() == 4 and blocks.where("logical_offset = 1536").count() == 3000
    assert archive.load(spark, path, "paths").count() == 3007 and sink.validate(spark, path).first()["checksum_failures"] == 0
    assert len(pickle.dumps(sink.Prepared("part"))) < 200 and os.listdir(tmp_path) == ["w.arc"]


@pytest.mark.parametrize("order", [1, -1, 7])
def test_padded_payloads_are_copied_in_few_reads(tmp_path, order):
    import io

    from pyarrow import fs

    bodies = [bytes([k % 251]) * (k % 90 + 1) for k in range(2000)]
    (tmp_path / "part").write_bytes(b"".join(bodies))
    starts = [sum(map(len, bodies[:k])) for k in range(2000)]
    out, reads = io.BytesIO(), []
    copy = sink.Copier(fs.LocalFileSystem(), [str(tmp_path / "part")], out)

    class Counted:
        def __init__(self, f):
            self.read_at, self.close = lambda n, at: reads.append(n) or f.read_at(n, at), f.close

    copy.f[0] = Counted(fs.LocalFileSystem().open_input_file(str(tmp_path / "part")))
    ks = list(range(2000))[::order]
    for k in ks:
        copy.add(0, starts[k], len(bodies[k]), 3)
    copy.close()
    assert out.getvalue() == b"".join(b"\0\0\0" + bodies[k] for k in ks)
    # backwards nothing is read ahead
    assert max(reads) <= 90 if order == -1 else len(reads) == 1


def test_links_to_links_before_them(spark, tmp_path):
    archive.register(spark)
    path = str(tmp_path / "l.arc")
    rows = [("a.txt", "file", None, b"a", 0), ("one", "link", "a.txt", None, 1), ("two", "link", "one", None, 2), ("deep\x1fthree", "link", "two", None, 3), ("four", "link", "deep", None, 4)]
    sink.write(spark.createDataFrame(rows, "path string, record_type string, target string, content binary, position int"), path)
    got = {r["record_index"]: r for r in archive.load(spark, path, "records").collect()}
    assert {r["path"]: got[r["link_target_index"]]["path"] for r in got.values() if r["record_type"] == "link"} == {"one": "a.txt", "two": "one", "deep\x1fthree": "two", "four": "deep"}


@pytest.mark.parametrize(("common", "want"), [(0o100640, 0o755), (0o640, 0o755), (0o750, 0o750), (0o40700, 0o700)])
def test_a_files_mode_of_the_archive_closes_no_directory(spark, tmp_path, common, want):
    from stowage.sources.wire import encode_value

    archive.register(spark)
    path, to = str(tmp_path / "d.arc"), str(tmp_path / "d")
    sink.write(spark.createDataFrame([("top\x1fa.txt", b"a")], "path string, content binary"), path, archive_attrs={"unix.mode": ("vu32", encode_value("vu32", common))})
    sink.extract(spark, path, to)
    bits = lambda *p: os.stat(os.path.join(to, *p)).st_mode & 0o7777
    assert (bits("top"), bits("top", "a.txt")) == (want, common & 0o7777)


def test_a_folder_that_cannot_be_listed_is_an_error(tmp_path, monkeypatch):
    (tmp_path / "closed").mkdir()
    scan = os.scandir

    def scandir(p):
        if str(p).endswith("closed"):
            raise PermissionError(13, "Permission denied", str(p))
        return scan(p)

    monkeypatch.setattr(os, "scandir", scandir)
    with pytest.raises(PermissionError):
        sink.listing(str(tmp_path))


def test_create_walks_excludes_and_leaves_itself_out(spark, tmp_path):
    archive.register(spark)
    src = tmp_path / "src"
    (src / "a" / "deep").mkdir(parents=True)
    for name in ("a/x.txt", "a/deep/y.txt", "a/deep/z.log", ".hidden", "top.txt"):
        (src / name).write_text(f"{name} " * 40)
    os.chmod(src / "top.txt", 0o600)
    os.symlink("top.txt", src / "link")
    path = str(src / "self.arc")
    sink.create(spark, str(src), path, exclude=["*.log"], ownership=True)
    shown = lambda: {r["path"].replace("\x1f", "/"): r["record_type"] for r in archive.load(spark, path, "records").collect()}
    want = {"a": "directory", "a/deep": "directory", "a/x.txt": "file", "a/deep/y.txt": "file", "top.txt": "file", "link": "link"}
    assert shown() == want and archive.load(spark, path, "archives").first()["alignment"] == 8
    attrs = archive.load(spark, path, "attrs").collect()
    uid = {(r["record_index"], r["key"]): r["v_long"] for r in attrs if r["key"] == "unix.uid"}
    assert uid == {(None, "unix.uid"): os.getuid()}  # all files have one owner: the archive's
    assert {r["v_long"] for r in attrs if r["key"] == "unix.mode"} >= {0o100600}
    with pytest.raises(Exception, match="exists already"):
        sink.create(spark, str(src), path)
    sink.create(spark, str(src), path, force=True, include_hidden=True, recursive=False)
    assert shown() == want | {"a/deep/z.log": "file", ".hidden": "file"}
    assert {r["path"] for r in sink.walk(spark, str(src), pattern="a/*.txt").select("path").collect()} == {"a\x1fx.txt", "a\x1fdeep\x1fy.txt"}


def test_writer_rules(spark, tmp_path):
    archive.register(spark)
    path, schema = str(tmp_path / "r.arc"), "path string, record_type string, content binary, dictionary binary"
    one = lambda *rows, **options: sink.write(spark.createDataFrame(list(rows), schema), path, **options)
    with pytest.raises(Exception, match="needs bytes"):
        one(("e", "chunked_file", b"", None))
    one(("small", "file", b"s" * 100, None), ("large", "file", b"l" * 900, None), ("empty", "file", b"", None), chunked=True, walked=True, block_size=512)
    kinds = {r["path"]: r["record_type"] for r in archive.load(spark, path, "records").collect()}
    assert kinds == {"small": "file", "large": "chunked_file", "empty": "file"}
    with pytest.raises(Exception, match="share its one dictionary"):
        one(("a", "file", b"a", b"first"), ("b", "file", b"b", b"second"))
    sink.set_attributes(path, {"title": ("string", b"of one")}, member="small")
    got = {(r["record_index"], r["key"]): r["v_string"] for r in archive.load(spark, path, "attrs").where("key = 'title'").collect()}
    index = archive.load(spark, path, "paths").where("path = 'small'").first()["record_index"]
    assert got == {(index, "title"): "of one"}
    with pytest.raises(ArchiveError):
        sink.set_attributes(path, {"title": ("u8", b"x")})


def test_external_links_need_consent(spark, tmp_path):
    archive.register(spark)
    path = str(tmp_path / "ext.arc")
    sink.write(spark.createDataFrame([("out", "external_link", "../x")], "path string, record_type string, external_target string"), path)
    with pytest.raises(ExtractError):
        sink.extract(spark, path, str(tmp_path / "o"))
    assert sink.extract(spark, path, str(tmp_path / "o"), allow_external=True)["links"] == 1


def test_open_errors(spark, tmp_path):
    for name, raw in (("short", b"\xffBO"), ("magic", b"x" * 40), ("zero", bytes.fromhex("ff424f58") + b"\x01" + b"\0" * 27), ("far", bytes.fromhex("ff424f58") + b"\x01" + b"\0" * 11 + (99).to_bytes(8, "little") + b"\0" * 8)):
        p = tmp_path / name
        p.write_bytes(raw)
        with pytest.raises(ArchiveError):
            archive.open_archive(str(p))
    with pytest.raises(OpenError):
        archive.list_archives(str(tmp_path / "absent"))


def test_embedded_archive(spark, made, tmp_path):
    path, _ = made
    p = tmp_path / "embedded"
    p.write_bytes(b"J" * 100 + open(path, "rb").read())
    assert archive.load(spark, str(p), "paths", base_offset=100).count() == archive.load(spark, path, "paths").count()


def test_sql_functions(spark, made):
    path, _ = made
    register_functions(spark)
    assert spark.sql(f"SELECT * FROM archive_entries('{path}')").count() == 7
    row = spark.sql("SELECT hex(vu64_encode(16512)) a, vu64_decode(X'7fff') b, path_normalize('/a/../b') c, hex(blake3(X'')) d, zstd_decompress(zstd_compress(X'0102')) e").first()
    assert (row["a"], int(row["b"]), row["c"], row["d"][:8], bytes(row["e"])) == ("200000", 16511, "b", "AF1349B9", b"\x01\x02")


def test_streams(spark, made, tmp_path, monkeypatch):
    path, _ = made
    q = directory.read_entries(spark, os.path.dirname(path), "*.arc").writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("arrived").count() == 7
    target, put = str(tmp_path / "grown.arc"), None
    put = directory.appender(target)
    for k in range(2):
        df = spark.createDataFrame([(f"f{k}", "file", b"body" * 40)], "path string, record_type string, content binary")
        put(df, k)
        put(df, k)  # a replay adds nothing
    assert archive.load(spark, target, "paths").count() == 2 and directory.last_batch(target) == 1
    # killed just before the rename: neither entries nor number are there, and the replay appends the batch once
    import base64
    import json

    from pyspark.sql import Row

    whole = open(target, "rb").read()
    number = json.dumps({directory.BATCH: ("vu64", base64.b64encode(directory.encode_vu64(2)).decode())})
    writer = sink.Writer({"path": target, "archive_attrs": number}, None, False)
    done = writer.write(iter([Row(path="f2", record_type="file", content=b"body" * 40)]))
    with monkeypatch.context() as m, pytest.raises(OSError, match="killed"):
        m.setattr(sink, "finish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        writer.commit([done])
    assert open(target, "rb").read() == whole and directory.last_batch(target) == 1
    df = spark.createDataFrame([("f2", "file", b"body" * 40)], "path string, record_type string, content binary")
    put(df, 2)
    put(df, 2)
    assert archive.load(spark, target, "paths").count() == 3 and directory.last_batch(target) == 2


def test_walk_and_probe(spark, made, tmp_path):
    path, _ = made
    src = tmp_path / "src"
    (src / "a").mkdir(parents=True)
    (src / "a" / "x.txt").write_text("hello")
    (src / ".hidden").write_text("no")
    assert {r["path"] for r in sink.walk(spark, str(src)).select("path").collect()} == {"a\x1fx.txt"}
    assert {os.path.basename(r["path"]): r["is_archive"] for r in archive.probe(spark, path).collect()} == {"one.arc": True}


def test_ranges(spark, made):
    from stowage.sources import ranges

    path, files = made
    index = {r["path"]: r["record_index"] for r in archive.load(spark, path, "paths").collect()}
    asked = [(path, index[p], o, n, p) for p in ("dir\x1fbig.bin", "dir\x1finner\x1fdeep.txt", "empty.txt") for o, n in ((0, 10), (65530, 20), (131072, 1), (300000, 5000), (10**7, 3), (5, 0))]
    got = ranges.read_ranges(spark.createDataFrame(asked, "uri string, record_index long, offset long, n long, path string")).collect()
    assert len(got) == len(asked)
    for r in got:
        assert bytes(r["content"]) == files[r["path"]][r["offset"] : r["offset"] + r["n"]]
    with ranges.SeekReader(path, index["dir\x1fbig.bin"]) as f:
        f.seek(-7, 2)
        assert f.read() == files["dir\x1fbig.bin"][-7:] and f.seek(65536) == 65536 and f.read(3) == files["dir\x1fbig.bin"][65536:65539]
        with pytest.raises(ArchiveError):
            f.seek(-1)
        assert f.file.block(1) == files["dir\x1fbig.bin"][65536:131072]
    with pytest.raises(ArchiveError):
        ranges.bounds(10, 5, 6, "strict")
    assert ranges.bounds(10, 12, 6) == (10, 10) and ranges.bounds(10, 5, 9, "clamp_end") == (5, 10)


def test_files_dictionary_and_links(spark, tmp_path):
    import base64

    from stowage.sources import files as fl
    from stowage.sources import wire

    archive.register(spark)
    src = tmp_path / "src"
    src.mkdir()
    for k in range(400):
        (src / f"r{k}.txt").write_text(f"record {k} of the same kind of text, number {k * 7}; " * 8)
    os.chmod(src / "r1.txt", 0o600)
    os.symlink("r0.txt", src / "inside")
    os.symlink("/etc/hostname", src / "outside")
    rows = fl.with_attributes(sink.walk(spark, str(src)).where("path NOT IN ('inside', 'outside')"), str(src), timestamps=True, ownership=True)
    d = fl.trained_dictionary(rows, 1024)
    path = str(tmp_path / "d.arc")
    sink.write(rows, path, dictionary=base64.b64encode(d).decode())
    assert contents(spark, path)["r3.txt"] == (src / "r3.txt").read_bytes()
    assert bytes(archive.load(spark, path, "archives").first()["dictionary"]) == d
    attrs = {(r["record_index"], r["key"]): r for r in archive.load(spark, path, "attrs").collect()}
    one = archive.load(spark, path, "paths").where("path = 'r1.txt'").first()["record_index"]
    assert attrs[one, "unix.uid"]["v_long"] == os.stat(src / "r1.txt").st_uid
    with pytest.raises(Exception, match="leaves the archive"):
        fl.capture_links(spark, str(src), ["r0.txt"])
    links = {r["path"]: r["record_type"] for r in fl.capture_links(spark, str(src), ["r0.txt"], True).collect()}
    assert links == {"inside": "link", "outside": "external_link"}
    assert fl.codec_options({"level": "9", "fast": "yes", "name": "x"}) == {"level": 9, "fast": True, "name": "x"}
    assert fl.operand_words(["a", "--xz", "b", "--zstd-chunked", "c"]) == [("a", "zstd", False), ("b", "xz", False), ("c", "zstd", True)]
    assert wire.decode_number("u8", b"\x07") == 7


def test_scan_equals_load_and_is_planned_without_a_data_source(spark, made):
    path, _ = made
    for table in archive.SCHEMAS:
        a, b = archive.scan(spark, path, table), archive.load(spark, path, table)
        assert a.schema == b.schema
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), table
    attrs = archive.scan(spark, path, "attrs")
    plan = attrs.join(archive.scan(spark, path, "records"), ["archive_id", "record_index"])._jdf.queryExecution().toString()
    # no data source, whose planning starts Python processes beside the driver; and nothing whose size isn't known is broadcast
    assert "BatchScan" not in plan and "BroadcastHashJoin" not in plan
    assert "BatchScan" not in sink.validate(spark, path)._jdf.queryExecution().toString()


def test_batches_of_a_scan_are_bounded_in_bytes():
    import pyarrow as pa

    kind = pa.schema([("archive_id", pa.int64()), ("record_index", pa.int64()), ("content", pa.binary())])
    big = archive.SENT_BYTES // 2
    got = list(archive._batched(iter([(0, k, b"x" * big) for k in range(5)]), kind))
    assert [b.num_rows for b in got] == [2, 2, 1] and list(archive._batched(iter([]), kind)) == []


def test_write_through_a_function_of_batches(spark, tmp_path):
    def marked(batches):
        import pyarrow as pa

        for b in batches:
            attrs = pa.array([[("note", c[:1])] for c in b.column("content").to_pylist()], pa.map_(pa.string(), pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("content"), attrs], names=["path", "content", "attrs"])

    path = str(tmp_path / "through.arc")
    rows = [(f"d\x1ff{k}", bytes([65 + k % 26]) * k) for k in range(1, 200)]
    sink.write(spark.createDataFrame(rows, "path string, content binary").repartition(3), path, through=marked)
    got = {r["name"]: bytes(r["attrs"]["note"]) for r in archive.scan(spark, path).where("record_type = 'file'").collect()}
    assert got == {p[2:]: c[:1] for p, c in rows}
    assert sink.validate(spark, path).collect()[0][1:] == (199, 0, 0)
