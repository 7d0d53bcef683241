import hashlib
import os

import pytest
from helpers import rows

from arborix.sources import archives, files, sinks
from arborix.streaming.incremental import duplicate_hash_state, duplicate_hash_stream, windowed_counts


def sampled(data: bytes) -> str:
    h = hashlib.sha256(len(data).to_bytes(8, "little") + data[:4096])
    if len(data) > 4096:
        h.update(data[-4096:])
    return h.hexdigest()


CONTENTS = {"empty": b"", "small": b"abc", "edge": b"x" * 4096, "big": bytes(range(256)) * 64, "sub/deep/f.txt": b"deep"}


@pytest.fixture
def folder(tmp_path):
    for name, data in CONTENTS.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return tmp_path


def test_walk_and_hashes(spark, folder):
    os.symlink(folder / "small", folder / "link")
    tree = files.walk(spark, str(folder)).collect()
    by = {r["path"]: r for r in tree}
    assert len(tree) == 1 + 2 + 5 + 1
    for name, data in CONTENTS.items():
        assert by[f"{folder}/{name}"]["hash"] == sampled(data)
    link = by[f"{folder}/link"]
    assert link["is_symlink"] and not link["is_file"] and link["hash"] == sampled(b"abc")
    assert by[f"{folder}/sub"]["hash"] is None and by[f"{folder}/sub"]["is_directory"]


def test_binary_index_agrees_with_the_walk(spark, folder):
    got = {r["path"]: r["hash"] for r in files.binary_index(spark, str(folder)).collect()}
    assert got == {f"{folder}/{n}": sampled(d) for n, d in CONTENTS.items() if d}
    full = {r["path"]: r["hash"] for r in files.full_hashes(spark, str(folder)).collect()}
    assert full[f"{folder}/big"] == hashlib.sha256(CONTENTS["big"]).hexdigest()


def test_listing_and_missing_folders(spark, folder):
    assert [r["name"] for r in files.folder_entries(spark, str(folder)).collect()] == ["big", "edge", "empty", "small", "sub"]
    gone = files.list_folders(spark.createDataFrame([("/no/such",)], "path string")).first()
    assert gone["traverse_error"] and gone["parent_path"] is None
    for bad in ("", "relative", "/no/such"):
        with pytest.raises(ValueError):
            files.check_folder(bad)
    with pytest.raises(ValueError):
        files.check_inside("/etc/passwd", str(folder))


def test_file_content(spark, folder):
    row = files.file_content(spark, str(folder / "sub/deep/f.txt"), str(folder)).first()
    assert row["is_text"] and row["text"] == "deep" and row["media_type"].startswith("text/plain")


def test_archive(spark, tmp_path):
    d = tmp_path / "risks" / "20240101_120000"
    d.mkdir(parents=True)
    (d / "00012_data.json").write_text('{"id": 7, "x": {"y": 1}}')
    (d / "00012_request.json").write_text('{"id": 8}')
    got = archives.archive(spark, str(tmp_path), "id long, x struct<y: long>").first()
    assert (got["id"], got["x"]["y"], got["run_stamp"], got["sequence"]) == (7, 1, "20240101_120000", 12)


def test_paged_source(spark):
    class Numbers(archives.PagedSource):
        ddl = "n long"

        @classmethod
        def name(cls):
            return "numbers_paged"

        @staticmethod
        def fetch(start, count):
            return [(i,) for i in range(start, start + count)]

    spark.dataSource.register(Numbers)
    got = spark.read.format("numbers_paged").option("total", 25).option("page_size", 10).load()
    assert sorted(r["n"] for r in got.collect()) == list(range(25))
    assert spark.read.format("numbers_paged").option("total", 0).load().count() == 0


def test_settings_are_clamped():
    s = archives.Settings.load({"ARBORIX_MIN_SIMILARITY": "7", "ARBORIX_NEAR_SECONDS": "1", "ARBORIX_DASHBOARD_SECONDS": "x"})
    assert (s.min_similarity, s.near_seconds, s.dashboard_seconds, s.groups_seconds) == (1.0, 30, 60, 120)


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b"), (2, None)], "id int, name string").orderBy("id")
    assert sinks.write_csv(df, str(tmp_path / "o.csv")) == 2
    assert (tmp_path / "o.csv").read_bytes() == b'\xef\xbb\xbfid;name\n1;"a;b"\n2;\n'


def test_tables_logs_and_archives(spark, tmp_path):
    df = spark.createDataFrame([("k", 1), ("k", 2), ("q/x", 3)], "k string, v int")
    sinks.replace_table(df, str(tmp_path / "t"), ["k"])
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [("k", 2), ("q/x", 3)]
    sinks.append_logs(spark.createDataFrame([("DEBUG", "x"), ("INFO", "y")], "level string, message string"), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 1
    sinks.write_archive(df, str(tmp_path / "a"), ["k"])
    assert (tmp_path / "a" / "k=q_x").is_dir()


def test_stream_of_duplicate_hashes(spark, tmp_path):
    schema = "id long, hash string"
    for i, hashes in enumerate((["a", "A ", "b"], ["b", "c", None, ""])):
        spark.createDataFrame([(j, h) for j, h in enumerate(hashes)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        duplicate_hash_stream(source, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    state = duplicate_hash_state(spark, str(tmp_path / "state"))
    assert rows(state, "hash", "n", "is_duplicate") == [("a", 2, True), ("b", 2, True), ("c", 1, False)]
    assert duplicate_hash_state(spark, str(tmp_path / "none")).count() == 0


def test_windows_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    df = spark.sql("SELECT timestamp_seconds(1700000000 + id * 600) AS ts, concat('t', id % 2) AS event_type, double(id) AS value FROM range(40)")
    df.write.parquet(str(tmp_path / "e"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("w")) == rows(windowed_counts(df))
