"""Databases, spreadsheets, processed tables, replaced partitions and workflows of several granularities."""

import datetime
import io
import os
import subprocess
import sys
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from cadence.operators import evaluate, panel
from cadence.plans import catalogue, files
from cadence.sources import readers, sinks, workbooks


@pytest.fixture
def url(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = [(i, f"n{i % 3}", float(i), None if i % 5 else i) for i in range(100)]
    spark.createDataFrame(rows, "id int, name string, v double, w int").write.format("jdbc").options(url=url, dbtable="things").save()
    return url


def test_database_scan_pushes_filters_columns_and_limit(spark, url, capsys):
    df = readers.table(spark, "things", url, columns=["id", "v"], where=F.col("v") > 90)
    assert sorted(map(tuple, df.collect())) == [(i, float(i)) for i in range(91, 100)]
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(v,90.0)" in plan and "ReadSchema: struct<id:int,v:double>" in plan
    assert readers.table(spark, "things", url, limit=7).count() == 7


def test_database_scan_in_ranges(spark, url):
    df = readers.table(spark, "things", url, split_by="id", parts=5)
    assert df.rdd.getNumPartitions() == 5 and df.count() == 100 and df.agg(F.sum("v")).first()[0] == 4950
    assert readers.table(spark, "things", url, split_by="w", parts=3).count() == 100  # rows without a value, too
    spark.createDataFrame([], "id int").write.format("jdbc").options(url=url, dbtable="nothing").save()
    assert readers.table(spark, "nothing", url, split_by="id").count() == 0


def workbook(path, shared=False):
    data = workbooks.workbook_bytes([("Data & more", ["name", "n", "name"], [("a <b>", 1, "x"), (None, 2.5, None), (None, None, None), (" c ", -3, "y\nz")]), ("Other", ["k"], [(True,), ("é",)])])
    if shared:  # as other programs write it: strings in a table, cells without places
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
            for n in old.namelist():
                if n != "xl/worksheets/sheet2.xml":
                    new.writestr(n, old.read(n))
            new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbooks.MAIN}"><si><t>k</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
            new.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{workbooks.MAIN}"><sheetData><row><c t="s"><v>0</v></c></row><row><c t="s"><v>1</v></c></row></sheetData></worksheet>')
        data = out.getvalue()
    with open(path, "wb") as f:
        f.write(data)
    return str(path)


def test_spreadsheet(spark, tmp_path):
    path = workbook(tmp_path / "a.xlsx")
    got = workbooks.sheet(spark, path)
    assert got.columns == ["name", "n", "name_C"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a <b>", "1", "x"), (None, "2.5", None), (" c ", "-3", "y\nz")], key=str)
    assert [r[0] for r in workbooks.sheet(spark, path, "Other").orderBy("k").collect()] == ["True", "é"]
    with pytest.raises(ValueError):
        workbooks.sheet(spark, path, "absent")


def test_spreadsheet_with_shared_strings(spark, tmp_path):
    assert workbooks.sheet(spark, workbook(tmp_path / "b.xlsx", shared=True), "Other").collect()[0]["k"] == "rich"


def test_spreadsheet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", i / 8) for i in range(40)], "id int, name string, v double")
    workbooks.write_sheet(df, f"{tmp_path}/t.xlsx")
    back = workbooks.to_csv(spark, f"{tmp_path}/t.xlsx", f"{tmp_path}/t.csv")
    assert sorted((int(r["id"]), r["name"], float(r["v"])) for r in back.collect()) == [(i, f"n{i}", i / 8) for i in range(40)]
    assert [workbooks.column_number(workbooks.column_name(n)) for n in (1, 26, 27, 702, 703, 16384)] == [1, 26, 27, 702, 703, 16384]


def test_processed_table_is_made_only_when_stale(spark, tmp_path):
    source, base, made = f"{tmp_path}/in", f"{tmp_path}/out", []

    def run(first):
        def make():
            made.append(first)
            return spark.read.parquet(source).where(F.col("id") >= first)

        return readers.processed(spark, base, [source], {"first": first}, make)

    spark.range(10).write.parquet(source)
    assert [(run(f)[0].count(), run(f)[1]) for f in (0, 0, 4)] == [(10, True), (10, True), (6, True)] and made == [0, 4]
    spark.range(20).write.mode("append").parquet(source)
    df, there = run(0)
    assert not there and df.count() == 30 and made == [0, 4, 0]
    with pytest.raises(FileNotFoundError):
        readers.processed(spark, base, [f"{tmp_path}/absent"], {}, lambda: spark.range(1))


def test_a_table_whose_job_failed_is_made_again(spark, tmp_path):
    source, base = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(3).write.parquet(source)
    with pytest.raises(Exception, match="broken"):
        readers.processed(spark, base, [source], {}, lambda: spark.range(3).select(F.raise_error(F.lit("broken")).cast("int").alias("x")))
    assert readers.processed(spark, base, [source], {}, lambda: spark.range(3))[1] is False
    assert readers.processed(spark, base, [source], {}, lambda: spark.range(3))[1] is True


def test_replacing_the_backtest_leaves_the_rest(spark, tmp_path):
    path, day = f"{tmp_path}/p", datetime.date(2020, 1, 6)
    schema = "department string, age_group string, model string, split string, date date, actual double, predicted double"
    old = [(d, "all", "naive", s, day, 1.0, 2.0) for d in ("a", "b") for s in ("train", "val", "test", "backtest")]
    sinks.write_splits(spark.createDataFrame(old, schema), path)
    points = [("a", "all", "naive", 10, h, day + datetime.timedelta(days=7 * (h // 2)), 5.0, None if h == 1 else float(h)) for h in (1, 2, 3)]
    frame = spark.createDataFrame(points, "department string, age_group string, model string, te int, h int, date date, actual double, predicted double")
    sinks.replace_backtest(frame, path)
    read = lambda: sorted((r["department"], r["split"], str(r["date"]), r["actual"], r["predicted"]) for r in spark.read.parquet(path).collect())
    week = day + datetime.timedelta(days=7)
    kept = [(d, s, str(day), 1.0, 2.0) for d in ("a", "b") for s in ("train", "val", "test", "backtest") if (d, s) != ("a", "backtest")]
    got = read()
    assert got == sorted([*kept, ("a", "backtest", str(day), 5.0, None), ("a", "backtest", str(week), 5.0, 2.0)])
    broken = frame.withColumn("actual", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        sinks.replace_backtest(broken, path)
    assert read() == got


def test_levels_name_their_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 4.0), (None, 1, 5.0)], "k string, y int, v double")
    got = {(r["k"], r["y"], r["level"]): r["s"] for r in panel.levels(df, [["y"], ["k", "y"], []], ["k", "y"], s=F.sum("v")).collect()}
    assert got == {(None, 1, "y"): 11.0, (None, 2, "y"): 3.0, ("a", 1, "k,y"): 2.0, ("a", 2, "k,y"): 3.0, ("b", 1, "k,y"): 4.0, (None, 1, "k,y"): 5.0, (None, None, ""): 14.0}


def test_metric_grid_agrees_with_single_levels(spark):
    rows = [(d, m, datetime.date(2020, 1, 1 + i), float(i * k), float(i + k)) for k, d in enumerate("ab", 1) for m in "xy" for i in range(6)]
    df = spark.createDataFrame(rows, "department string, model string, date date, actual double, predicted double")
    grid = {(r["department"], r["model"]): r for r in evaluate.metric_grid(df).collect()}
    for r in evaluate.metrics(df, ["department", "model"]).collect():
        assert all(grid[r["department"], r["model"]][c] == pytest.approx(r[c]) for c in evaluate.METRICS)
    assert grid[None, "x"]["n"] == 12 and grid[None, "x"]["mae"] == pytest.approx((grid["a", "x"]["mae"] + grid["b", "x"]["mae"]) / 2)


@pytest.mark.parametrize("name", ["csv_weekly_cases", "saved_models", "department_series", "prediction_files", "report_files", "backtest_replaced", "processed_series"])
def test_a_second_run_leaves_the_first_result(spark, tmp_path, name):
    from .test_catalogue import write_tables

    d = write_tables(spark, tmp_path)
    run = catalogue.queries()[name]
    first = run(spark, d)
    second = run(spark, d)
    assert sorted(map(str, second.collect())) == sorted(map(str, first.collect()))


ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
scan = entry.queries()["jdbc_scan"](spark, sys.argv[1]).collect()
print("GOT", len(scan), sum(r.o_orderkey for r in scan), *entry.queries()["jdbc_limit"](spark, sys.argv[1]).first())
"""


def test_executors_of_their_own_see_the_database(spark, tmp_path):
    from .test_catalogue import write_tables

    d = write_tables(spark, tmp_path / "tables")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, d, f"file://{tmp_path}/shared"], capture_output=True, text=True, cwd=tmp_path, timeout=300,
                         env={k: v for k, v in os.environ.items() if k != "PYSPARK_GATEWAY_PORT"} | {"PYTHONPATH": os.pathsep.join([root, *sys.path])})
    want = spark.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 200000 and o_orderstatus = 'F'").agg(F.count("*"), F.sum("o_orderkey")).first()
    assert f"GOT {want[0]} {want[1]} 100 100" in run.stdout, run.stderr[-3000:]


def test_a_database_keeps_odd_rows(spark, tmp_path):
    odd = [(1, None, 'a,"b"\nc', 0.1 + 0.2, datetime.date(2020, 1, 6)), (2, 7, "é" * 40, None, None), (None, 8, "F", 1e300, datetime.date(1, 1, 1))]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date"
    for name, rows in (("some", odd), ("none", [])):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}/orders.parquet")
        assert sorted(map(tuple, files.orders(spark, f"{tmp_path}/{name}").collect()), key=str) == sorted(rows, key=str)
    spark.createDataFrame([(i, i, "F", float(i), None) for i in range(250)], schema).repartition(3).write.parquet(f"{tmp_path}/more/orders.parquet")
    assert len(files.database(spark, f"{tmp_path}/more")) == 3 and tuple(files.jdbc_limit(spark, f"{tmp_path}/more").first()) == (100, 100)
