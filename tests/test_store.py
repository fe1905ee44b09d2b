from pyspark.sql import functions as F

from carnelian.sources.checkouts import from_rows, git_files, read_directory, split_scan
from carnelian.sources.store import Store, write_listing
from carnelian.streaming import refresh

ROWS = [("a", "x.rb", "class X; def m; end; end"), ("a", "y.rb", "class Y; end"), ("b", "x.rb", "class X; def m; end; end")]


def load(spark, store, rows):
    return store.load(*split_scan(from_rows(spark, rows)))


def test_a_load_parses_only_new_contents(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert load(spark, store, ROWS) == {"parsed": 2, "changed": 3}
    assert load(spark, store, ROWS) == {"parsed": 0, "changed": 0}
    assert load(spark, store, [*ROWS[:2], ("b", "z.rb", "Z = 1")]) == {"parsed": 1, "changed": 2}
    assert sorted((r.checkout, r.path) for r in store.files().collect()) == [("a", "x.rb"), ("a", "y.rb"), ("b", "z.rb")]
    assert store.facts("defs").count() == 4
    assert store.compact() and not store.compact() and store.facts("defs").count() == 4
    assert Store(spark, str(tmp_path)).facts("defs").count() == 4 and load(spark, store, [*ROWS[:2], ("b", "z.rb", "Z = 2")])["parsed"] == 1
    assert Store(spark, str(tmp_path), version=999).facts("defs").count() == 0


def test_a_stream_of_saves_equals_a_batch(spark, tmp_path):
    (tmp_path / "saves").mkdir()
    spark.createDataFrame([(*r, 1) for r in ROWS], refresh.SAVES).coalesce(1).write.mode("append").json(str(tmp_path / "saves"))
    streamed = Store(spark, str(tmp_path / "s"))
    refresh.refresh(streamed, refresh.saved_files(spark, str(tmp_path / "saves")), str(tmp_path / "c")).awaitTermination()
    batch = Store(spark, str(tmp_path / "b"))
    load(spark, batch, ROWS)
    key = lambda s: sorted(map(tuple, s.files().select("checkout", "path", "oid").collect()))
    assert key(streamed) == key(batch)
    spark.createDataFrame([("a", "y.rb", "class Y2; end", 2)], refresh.SAVES).coalesce(1).write.mode("append").json(str(tmp_path / "saves"))
    refresh.refresh(streamed, refresh.saved_files(spark, str(tmp_path / "saves")), str(tmp_path / "c")).awaitTermination()
    assert streamed.files().count() == 3 and streamed.facts("defs").where("name = 'Y2'").count() == 1


def test_directories_and_git(spark, tmp_path):
    import subprocess

    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "a.rb").write_text("A = 1\n")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "link.rb").symlink_to("lib/a.rb")
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    tracked = git_files(spark, str(tmp_path), "t").collect()
    assert [r.path for r in tracked] == ["lib/a.rb"]
    files, _ = split_scan(read_directory(spark, str(tmp_path / "lib"), "t"))
    (row,) = files.collect()
    assert (row.path, row.oid) == ("a.rb", tracked[0].oid)


def test_listing_has_a_footer(spark, tmp_path):
    write_listing(spark.range(3), str(tmp_path), "ids")
    assert spark.read.json(f"{tmp_path}/footer").first().asDict() == {"answer": "ids", "rows": 3}
    assert spark.read.json(f"{tmp_path}/rows").agg(F.sum("id")).first()[0] == 3


def test_a_part_is_added_and_a_checkout_dropped(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    load(spark, store, ROWS)
    paths = lambda: sorted((r.checkout, r.path) for r in store.files().collect())
    part = split_scan(from_rows(spark, [("a", "y.rb", "class Y2; end"), ("a", "z.rb", "Z = 1")]))
    assert store.add(*part) == {"parsed": 2, "changed": 2}
    assert paths() == [("a", "x.rb"), ("a", "y.rb"), ("a", "z.rb"), ("b", "x.rb")]
    assert store.drop_checkout("a") == 3 and paths() == [("b", "x.rb")] and store.drop_checkout("a") == 0


def test_utf16_columns_go_there_and_back(spark):
    from carnelian.functions import scalars as S

    lines = ["a = 1", "é = '😀x'", "", "日本 😀😀 z"]
    rows = [(line, len(line[:n].encode()) + 1, len(line[:n].encode("utf-16-le")) // 2) for line in lines for n in range(len(line) + 1)]
    df = spark.createDataFrame(rows, "line string, byte int, units int")
    got = df.select("line", "byte", "units", S.utf16_column(F.col("line"), F.col("byte")).alias("u"), S.byte_column(F.col("line"), F.col("units")).alias("b")).collect()
    assert [(r.u, r.b) for r in got] == [(units, byte) for _, byte, units in rows]
