"""File sources and sinks at their edges."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from catalogq import session
from catalogq.operators import perturb
from catalogq.sources import sinks, tables


def write(path, text):
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def test_csv_edges(spark, tmp_path):
    text = '﻿a,b,c\r\n1,"x,y",3\r\n\r\n"he said ""hi""",short\r\n4,5,6,extra\r\n"line\r\nbreak", pad ,\r\n'
    rows = tables.read_csv(spark, write(tmp_path / "e.csv", text), newlines=True).orderBy("_ord")
    assert rows.columns == ["a", "b", "c", "_ord"]
    assert [tuple(r)[:3] for r in rows.collect()] == [
        ("1", "x,y", "3"), ('he said "hi"', "short", ""), ("4", "5", "6"), ("line\nbreak", " pad ", ""),
    ]


def test_csv_order_over_many_files(spark, tmp_path):
    spark.range(0, 1000, 1, 5).selectExpr("id", "'x' as t").write.option("header", True).csv(str(tmp_path / "many"))
    ids = [int(r["id"]) for r in tables.read_csv(spark, str(tmp_path / "many")).orderBy("_ord").collect()]
    assert ids == list(range(1000))


def test_csv_keeps_white_space_and_quotes(spark, tmp_path):
    cells = [(" a ", 'q"q', "x\ny"), ("", "\\", ",")]
    df = spark.createDataFrame(cells, "a string, b string, c string")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out")).drop("_ord")
    assert sorted(map(tuple, back.collect())) == sorted(cells)


def test_lines_keep_file_order(spark, tmp_path):
    path = write(tmp_path / "l.jsonl", "\n".join(f'{{"name":"{i}"}}' for i in range(500)))
    assert [r["value"] for r in tables.read_lines(spark, path).orderBy("_ord").collect()] == [
        f'{{"name":"{i}"}}' for i in range(500)
    ]
    limited = tables.limit_valid(tables.parse_lines(tables.read_lines(spark, path)), 3)
    assert limited.count() == 3


def test_parquet_table_orders_by_file_position(spark, sf_dir):
    table = tables.parquet_table(spark, f"{sf_dir}/part.parquet")
    assert "_ord" not in table.headers and len(table.headers) == 6
    keys = [r["p_partkey"] for r in table.df.orderBy("_ord").select("p_partkey").collect()]
    assert keys == sorted(keys)


def test_first_table_by_name(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shopdb")
    try:
        with pytest.raises(ValueError):
            tables.first_table(spark, "shopdb")
        for name in ("zeta", "alpha"):
            spark.range(1).write.mode("overwrite").saveAsTable(f"shopdb.{name}")
        assert tables.first_table(spark, "shopdb") == "shopdb.alpha"
    finally:
        spark.sql("DROP DATABASE shopdb CASCADE")


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    folder = spark.conf.get("spark.checkpoint.dir", None) or session.shared_dir(spark)
    assert session.shared_dir(spark) == folder.rstrip("/")
    assert session.new_folder(spark, "x") != session.new_folder(spark, "x")


def test_renaming_rules():
    names = perturb.renamed_headers(["gtin", "breadcrumb_1", "unit_price_eur", "has_pills", "desc_material", "title_subheadline"])
    assert list(names.values()) == [
        "gtin_code", "crumb_1", "price_per_unit_eur_amt", "is_badges", "details_material", "title_subline"]
    twice = perturb.renamed_headers(["pills", "badges", "brand", "pills_"])
    assert twice == {"pills": "badges", "badges": "badges_2", "brand": "brand_name", "pills_": "badges_"}


def test_candidate_sample_is_stable(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    pick = lambda df, seed: {r["p_partkey"] for r in perturb.make_candidate(df, part.columns, ["p_partkey"], seed, 20)[0].collect()}
    assert pick(part, 1) == pick(part.repartition(13), 1) != pick(part, 2)


def test_repeated_headers_last_one_counts(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,a,c2\n1,2,3,4\n5,6\n")
    rows = tables.read_csv(spark, str(tmp_path / "x.csv")).orderBy("_ord").drop("_ord")
    assert rows.columns == ["a", "b", "c2"]
    assert [tuple(r) for r in rows.collect()] == [("3", "2", "4"), ("", "6", "")]


def test_candidate_files_are_in_shuffled_order(spark, tmp_path):
    made, names = perturb.make_candidate(spark.range(300).select(F.col("id").alias("gtin"), F.lit("x").alias("name")), ["gtin", "name"], ["gtin"])
    perturb.write_candidate(made, str(tmp_path / "out"))
    written = [int(r["gtin_code"]) for r in tables.read_csv(spark, str(tmp_path / "out")).orderBy("_ord").collect()]
    assert names == {"gtin": "gtin_code", "name": "product_name"}
    assert written == sorted(range(300), key=lambda i: hashlib.sha256(f"42:{i}".encode()).hexdigest())


def test_folders_are_deleted_after_use(spark, tmp_path):
    with session.scratch(spark):
        kept = session.materialize(spark.range(5), "test")
        path = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert kept.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_shared_folder_of_a_session_that_names_none(spark, monkeypatch):
    class Conf:
        def get(self, name, *default):
            return None if name == "spark.checkpoint.dir" else "file:/warehouse"

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "local[2]"

    assert session.shared_dir(Session()) == "file:/warehouse/catalogq-shared"
    Session.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_large_csv_files_are_split_at_lines_and_open_quotes_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LARGE_CSV", 100)
    good = tmp_path / "good.csv"
    good.write_text('a,b\n' + "".join(f'{i},"x ""{i}"", y"\n' for i in range(50)), encoding="utf-8")
    rows = tables.csv_table(spark, str(good)).df.collect()
    assert len(rows) == 50 and {r["b"] for r in rows} == {f'x "{i}", y' for i in range(50)}
    broken = tmp_path / "broken.csv"
    broken.write_text('a,b\n1,"two\nlines"\n' + "2,x\n" * 50, encoding="utf-8")
    with pytest.raises(ValueError, match="broken.csv.*not closed"):
        tables.csv_table(spark, str(broken))
    assert tables.csv_table(spark, str(broken), multi_line=True).df.where("b = 'two\nlines'").count() == 1
    monkeypatch.setattr(tables, "LARGE_CSV", 1 << 30)
    assert tables.csv_table(spark, str(broken)).df.count() == 51


def test_a_line_beyond_the_limit_is_an_invalid_row(spark, monkeypatch):
    monkeypatch.setattr(tables, "LONGEST_LINE", 40)
    lines = spark.createDataFrame([('{"a": 1}', 1), ('{"a": "' + "x" * 40 + '"}', 2), ("null", 3)], "value string, _ord long")
    counts = tables.line_counts(tables.parse_lines(lines)).first()
    assert (counts["source_rows"], counts["invalid_rows"]) == (3, 1)
