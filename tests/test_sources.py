"""Files in and out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollbook import session
from rollbook.operators.dedupe import keep_first
from rollbook.sources import forms, store


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_forms_of_a_directory(spark, tmp_path, rows):
    write(tmp_path / "Form A core.csv", "CODE,NAME,N\n007,ana,1\n,,\n008,,2\n")
    write(tmp_path / "Form D directed.csv", "CLASS,N\n01,1\n")
    write(tmp_path / "notes.txt", "no form")
    read = forms.read_forms(
        spark, str(tmp_path),
        schemas={"form_d_directed": "CLASS int, N int"}, as_text={"form_d_directed": ["CLASS"]},
    )
    assert sorted(read) == ["form_a_core", "form_d_directed"]
    assert rows(read["form_a_core"]) == [("007", "ana", "1"), ("008", None, "2")]
    assert rows(read["form_d_directed"]) == [("01", 1)]


def test_first_file_wins_among_id_lists(spark, tmp_path, rows):
    write(tmp_path / "a.csv", "combined_number,NAME,extra\n01,ana,x\n02,rui,x\n")
    write(tmp_path / "b.csv", "combined_number,NAME,extra\n01,eva,y\n03,bob,y\n")
    got = forms.read_multi(
        spark, str(tmp_path), "combined_number string, NAME string, extra string",
        ["combined_number", "NAME"],
    )
    assert rows(got) == [("01", "ana"), ("02", "rui"), ("03", "bob")]


def test_correction_sheets(spark, tmp_path, rows):
    write(tmp_path / "s1.csv", "NAME,permids,dobs,grades\ntitle,,,\nNAME,permids,dobs,grades\n"
                               "ana,p1,37000,5\n,p2,1,1\nrui,p3,x,y\n")
    write(tmp_path / "s2.csv", "NAME,permids,class_names\nNAME,permids,class_names\nana,p1,B\n")
    write(tmp_path / "s3.csv", "NAME,permids\nnobody,p4\n")
    paths = [str(tmp_path / f"s{i}.csv") for i in (1, 2, 3)]
    got = forms.type_corrections(forms.read_sheets(spark, paths, headerless="skip"))
    ordered = got.sort("correction_order").select("NAME", "permids", "dobs", "grades", "class_names")
    assert [tuple(r) for r in ordered.collect()] == [
        ("ana", "p1", dt.date(2001, 4, 19), 5.0, None), ("rui", "p3", None, None, None),
        ("ana", "p1", None, None, "B"),
    ]


def test_table_named_by_position(spark, tmp_path, rows):
    write(tmp_path / "c.csv", "a,b,c\n1,x,2.5\n")
    got = forms.read_table(spark, str(tmp_path / "c.csv"), ["house", "region", "lat"],
                           "house string, region string, lat double")
    assert got.columns == ["house", "region", "lat"] and rows(got) == [("1", "x", 2.5)]


def test_snapshot_is_computed_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "snap")
    assert store.cached(spark, path, compute).count() == 3
    assert store.cached(spark, path, compute).count() == 3
    assert len(calls) == 1


def test_results_as_csv(spark, tmp_path):
    store.write_results({"a": spark.range(2), "b": spark.range(3)}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "b")).count() == 3


def test_initial_partitions_have_no_ceiling():
    assert session.initial_partitions(10, 8) == 8
    assert session.initial_partitions(2**40, 8) == 32768
    assert session.initial_partitions(100 * 2**40) == 3_276_800


def test_queries_leave_the_settings_alone(spark):
    from workload.base import Tables

    before = spark.conf.getAll
    Tables(spark, "/nowhere")
    assert spark.conf.getAll == before


def test_stored_tables_go_to_the_shared_folder(spark):
    df = session.materialize(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    assert df.count() == 5
    assert session.shared_folder(spark) in df.inputFiles()[0].replace("file://", "")
    assert session.cut_lineage(df).agg(F.sum("x")).first()[0] == 20


def test_columns_are_found_by_name(spark, tmp_path, rows):
    write(tmp_path / "f.csv", "B,A\n1,2\n")
    assert rows(forms.read_form(spark, str(tmp_path / "f.csv"), "A int, B int")) == [(2, 1)]
    assert rows(forms.read_form(spark, str(tmp_path / "f.csv"), "A int, C int")) == [(2, None)]


def test_lists_of_different_column_order(spark, tmp_path, rows):
    write(tmp_path / "a.csv", "combined_number,NAME\n01,ana\n")
    write(tmp_path / "b.csv", "NAME,combined_number\nrui,02\neva,01\n")
    got = forms.read_multi(spark, str(tmp_path), "combined_number string, NAME string", ["combined_number", "NAME"])
    assert rows(got) == [("01", "ana"), ("02", "rui")]


def test_quotes_commas_and_line_breaks(spark, tmp_path, rows):
    write(tmp_path / "f.csv", 'A,"B, b",C\n1,"say ""hi"", x",2\n')
    write(tmp_path / "g.csv", 'A,B\n1,"two\nlines"\n2,x\n')
    assert rows(forms.read_form(spark, str(tmp_path / "f.csv"))) == [("1", 'say "hi", x', "2")]
    assert rows(forms.read_form(spark, str(tmp_path / "g.csv"), multi_line=True)) == [("1", "two\nlines"), ("2", "x")]


def test_forms_stored_as_folders(spark, tmp_path, rows):
    tables = {"one": spark.createDataFrame([("01", 'a "b", c')], "k string, t string").repartition(1), "two": spark.range(3)}
    store.write_results(tables, str(tmp_path / "out"))
    write(tmp_path / "out" / "Three x.csv", "k\n7\n")
    read = forms.read_forms(spark, str(tmp_path / "out"))
    assert sorted(read) == ["one", "three_x", "two"]
    assert rows(read["one"]) == [("01", 'a "b", c')] and read["two"].count() == 3 and rows(read["three_x"]) == [("7",)]


def test_failed_casts_are_counted(spark, tmp_path, rows):
    write(tmp_path / "f.csv", "A,B\n1,x\n,2\nz,y\n")
    assert rows(forms.read_form(spark, str(tmp_path / "f.csv"), "A int, B int")) == [(1, None), (None, 2)]
    assert rows(forms.failed_casts(spark, str(tmp_path / "f.csv"), "A int, B int")) == [("A", 1), ("B", 2)]


def test_a_sheet_without_its_header_is_an_error(spark, tmp_path):
    write(tmp_path / "s.csv", "NAME,permids\nnobody,p4\n")
    with pytest.raises(ValueError, match="s.csv"):
        forms.read_sheets(spark, [str(tmp_path / "s.csv")])
    assert forms.read_sheets(spark, [str(tmp_path / "s.csv")], headerless="skip").count() == 0


def test_headers_cost_the_same_for_long_files(spark, tmp_path, rows):
    for name, lines in (("short", 3), ("long", 400_000)):
        write(tmp_path / f"{name}.csv", "\ufeffk,t\n" + "1,some text\n" * lines)
    write(tmp_path / "none.csv", "")
    write(tmp_path / "wide.csv", ",".join(f"column_{k}" for k in range(5000)) + "\r\n")
    heads = {r.file.rsplit("/", 1)[1]: r for r in forms.first_lines(spark, str(tmp_path)).collect()}
    assert sorted(heads) == ["long.csv", "short.csv", "wide.csv"]
    assert heads["long.csv"].header == heads["short.csv"].header == "k,t"
    assert heads["long.csv"].read <= forms.HEADER_BYTES and (tmp_path / "long.csv").stat().st_size > 4_000_000
    assert heads["wide.csv"].header.endswith(",column_4999")


def test_headers_by_the_text_reader_are_the_same(spark, tmp_path, rows, monkeypatch):
    write(tmp_path / "a.csv", "k,t\n1,x\n")
    write(tmp_path / "b.csv", "t,k,u\ny,2,z\n")
    path = "file://" + str(tmp_path)
    own = rows(forms.first_lines(spark, path), "file", "header")
    monkeypatch.setattr(forms, "OPENED", ())
    assert rows(forms.first_lines(spark, path), "file", "header") == own and len(own) == 2
    assert rows(forms.read_text_columns(spark, path)) == [("1", "x", None), ("2", "y", "z")]


def test_forms_of_equal_table_name_are_an_error(spark, tmp_path):
    write(tmp_path / "a b.csv", "k\n1\n")
    write(tmp_path / "A_B.csv", "k\n2\n")
    with pytest.raises(ValueError, match="A_B.csv and .*a b.csv"):
        forms.form_files(spark, str(tmp_path))


def test_the_first_entered_row_counts_over_splits(spark, tmp_path):
    write(tmp_path / "f.csv", "id,n\n" + "".join(f"{(k * 7919) % 5000},{k}\n" for k in range(60_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        form = forms.read_form(spark, str(tmp_path / "f.csv"), "id int, n int", entered="at")
        assert form.rdd.getNumPartitions() > 5 and form.select("at.block").distinct().count() > 5
        kept = keep_first(form, ["id"], [F.col("at")])
        assert kept.count() == 5000 and kept.agg(F.max("n")).first()[0] == 4999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_broken_write_is_not_served(spark, tmp_path):
    path = str(tmp_path / "snap")

    def broken():
        return spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error("lost")).otherwise(F.col("id")).alias("id"))

    with pytest.raises(Exception, match="lost"):
        store.cached(spark, path, broken)
    spark.range(25).write.parquet(f"{path}/table-half")  # complete, but never entered
    assert store.cached(spark, path, lambda: spark.range(100)).count() == 100
    assert store.cached(spark, path, broken).count() == 100


def test_changed_inputs_and_parameters_are_computed_anew(spark, tmp_path):
    source, path, calls = str(tmp_path / "in"), str(tmp_path / "snap"), []
    spark.range(3).write.parquet(source)

    def run(**parameters):
        def compute():
            calls.append(parameters)
            return spark.read.parquet(source)

        return store.cached(spark, path, compute, inputs=[source], parameters=parameters)

    first = run(a=1)
    assert run(a=1).count() == 3 and len(calls) == 1
    assert run(a=2).count() == 3 and len(calls) == 2
    spark.range(10).write.mode("append").parquet(source)
    assert run(a=1).count() == 13 and len(calls) == 3
    assert first.count() == 3 and run(a=1).count() == 13 and len(calls) == 3
