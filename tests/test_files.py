"""Files as input: drift, bad lines, bad rows, kept results; decoded texts; robots rules."""

import pytest
from pyspark.sql import functions as F

from dossier.plans import intake
from dossier.sources import files


def test_parquet_of_several_files(spark, tmp_path):
    for i in range(2):
        spark.range(3).select((F.col("id") + 3 * i).alias("id"), F.lit("x").alias("more")).write.parquet(f"{tmp_path}/{i}")
    found = files.parquet(spark, [f"{tmp_path}/0", f"{tmp_path}/1"], "id long")
    assert found.columns == ["id"] and sorted(r.id for r in found.collect()) == [0, 1, 2, 3, 4, 5]
    with pytest.raises(files.SchemaChanged, match="id: bigint instead of string; gone: missing"):
        files.parquet(spark, [f"{tmp_path}/0"], "id string, gone int")
    with pytest.raises(ValueError):
        files.parquet(spark, [], "id long")


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 9007199254740993, "b": null}\n{"a": broken\n')
    loose = {(r.a, r.rejected) for r in files.json_lines(spark, str(tmp_path / "a.json"), "a long, b string", strict=False).cache().collect()}
    assert loose == {(9007199254740993, None), (None, '{"a": broken')}
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        files.json_lines(spark, str(tmp_path / "a.json"), "a long, b string").collect()
    whole = spark.createDataFrame([(9007199254740993, None, ["x"])], "a long, b string, c array<string>")
    assert whole.select(files.as_json(whole)).first()[0] == '{"a":9007199254740993,"b":null,"c":["x"]}'


def test_rows_or_fail(spark):
    rows = spark.range(5)
    assert files.rows_or_fail(rows, {"small": F.col("id") < 9}).count() == 5
    with pytest.raises(Exception, match="row breaks the rule small"):
        files.rows_or_fail(rows, {"known": F.col("id") >= 0, "small": F.col("id") < 3}).collect()


def test_kept_result(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for parts in (["q", "r1"], ["q", "r1"], ["q", "r2"]):
        assert files.kept_result(spark, str(tmp_path), parts, make).count() == 3
    assert len(made) == 2


def test_decoded(spark):
    rows = spark.createDataFrame([("2a4b6a4804584559",), ("zz",), ("2a",), ("",), (None,)], "c string")
    assert [r[0] for r in rows.select(intake.decoded_address(F.col("c"))).collect()] == ["a@b.ros", None, None, None, None]
    rows = spark.createDataFrame([("a&#64;b&#x40;c &amp; &#0; &#382;",), ("",), (None,)], "c string")
    assert [r[0] for r in rows.select(intake.decoded_entities(F.col("c"))).collect()] == ["a@b@c &amp; &#0; ž", "", None]


def test_robots(spark):
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/b", True), ("h", "/a/b/*.pdf$", False), ("h", "/q?x", False), ("h", "/same", True), ("h", "/same", False)], "host string, pattern string, allow boolean")
    paths = {"/": True, "/a": False, "/abc": False, "/a/b": True, "/a/b/x.pdf": False, "/a/b/x.pdf?y": True, "/q?x=1": False, "/qx": True, "/same": True}
    urls = spark.createDataFrame([(i, "h", p) for i, p in enumerate(paths)], "url_id int, host string, path string")
    assert {r.url_id: r.allowed for r in intake.robots_verdicts(urls, rules).collect()} == dict(enumerate(paths.values()))
