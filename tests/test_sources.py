import datetime as dt

from tallyloom.sources import readers, writers
from tallyloom.sources.schemas import REGISTRY
from tallyloom.sources.tables import CsvTables


def test_csv_tables_are_typed_leniently(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(
        "order_id,order_date,customer_id,zip,order_status,payment_method,device_type,order_source\n"
        "1,2020-01-05,7.0,100,delivered,cod,web,ads\n"
        "2,05 Jan,8,,shipped,,web,\n"
        "3,2020-02-01 00:00:00,9,101,cancelled,cod,app,mail\n"
    )
    rows = CsvTables(spark, str(tmp_path)).orders().orderBy("order_id").collect()
    assert [r.order_date for r in rows] == [dt.date(2020, 1, 5), None, dt.date(2020, 2, 1)]
    assert [r.customer_id for r in rows] == [7, 8, 9]
    assert rows[1].zip is None and rows[1].payment_method is None


def test_header_names_and_optional_columns(spark, tmp_path):
    (tmp_path / "sales.csv").write_text("Date,Revenue,COGS\n2020-01-01,10.5,4\n")
    (tmp_path / "web_traffic.csv").write_text(
        "date,sessions,unique_visitors,page_views,bounce_rate,avg_session_duration_sec,traffic_source,conversion_rate\n"
        "2020-01-01,10,9,30,0.5,12.5,ads,0.1\n"
    )
    tables = CsvTables(spark, str(tmp_path))
    assert tables.sales().collect()[0].asDict() == {"date": dt.date(2020, 1, 1), "revenue": 10.5, "cogs": 4.0}
    assert tables.table("web_traffic").collect()[0].conversion_rate == 0.1
    assert tables.raw("sales").collect()[0].date == "2020-01-01"


def test_star_views_have_the_declared_types(tables):
    for name in ("products", "customers", "orders_with_zip", "order_items", "payments", "shipments", "returns", "sales", "web_traffic"):
        spec = REGISTRY.tables[name.replace("_with_zip", "")]
        declared = {n: t.simpleString() for n, t, _ in spec.fields}
        for column, kind in tables.table(name).dtypes:
            assert declared[column] == kind, (name, column)


def test_evidence_round_trip_and_sorted_csv(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    writers.write_evidence(df, str(tmp_path), "t")
    assert {tuple(r) for r in readers.read_evidence(spark, str(tmp_path), "t").collect()} == {("a", 1), ("b", 2)}
    writers.write_csv(df, str(tmp_path / "csv"), ["k"])
    lines = [line for p in sorted((tmp_path / "csv").glob("part-*")) for line in p.read_text().splitlines() if line != "k,v"]
    assert lines == ["a,1", "b,2"]


def test_export_keeps_template_order_and_shows_missing_days(spark):
    day = dt.date(2020, 1, 1)
    template = spark.createDataFrame([(1, day + dt.timedelta(2)), (2, day), (3, day + dt.timedelta(1))], "row_id int, date date")
    forecast = spark.createDataFrame([(day, 1.0), (day + dt.timedelta(2), 3.0)], "date date, v double")
    got = writers.ordered_export(template, forecast, [], ["v"]).collect()
    assert [(r.row_id, r.date, r.v) for r in got] == [(1, "2020-01-03", 3.0), (2, "2020-01-01", 1.0), (3, "2020-01-02", None)]


def test_lines_are_summed_before_they_meet_products(spark, tables):
    plan = tables.sales(keys=("segment",))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line or "Aggregate" in line]
    assert "Aggregate" in joins[0] and "Join" in joins[1] and "Aggregate" in joins[2]


def test_a_template_of_any_length_and_number_of_files(spark, tmp_path):
    from tallyloom.sources.tables import CsvTables

    days = [dt.date(2023, 1, 1) + dt.timedelta(i) for i in range(600)]
    for k in range(3):
        rows = [(d, 0.0, 0.0) for d in days[k::3]]
        spark.createDataFrame(rows, "Date date, Revenue double, COGS double").coalesce(1).write.mode("append").option(
            "header", True
        ).csv(str(tmp_path / "sample_submission.csv"))
    t = CsvTables(spark, str(tmp_path))
    got = t.horizon().orderBy("row_id").collect()
    assert [r.date for r in got] == days and [r.row_id for r in got] == list(range(1, 601)) and t.horizon_days == 600


def test_an_order_without_customer_is_blamed_on_the_order(spark, tables, monkeypatch):
    """It stays in the view, so its lines have a parent and its own key is what fails."""
    from tallyloom.operators.audit import foreign_key_report
    from tallyloom.sources.tables import StarTables

    real = StarTables.base

    def planted(self, name):
        df = real(self, name)
        if name != "orders":
            return df
        row = df.orderBy("o_orderkey").limit(1).selectExpr(
            "o_orderkey", "cast(-1 as long) as o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
        )
        return df.join(row.select("o_orderkey"), "o_orderkey", "left_anti").unionByName(row)

    def report():
        views = {n: tables.orders_with_zip() if n == "orders" else tables.table(n) for n in ("orders", "customers", "geography", "order_items", "products", "promotions")}
        return {(r.child_table, r.child_column): r.invalid_fk_count for r in foreign_key_report(REGISTRY.foreign_keys, views).collect()}

    before = report()
    monkeypatch.setattr(StarTables, "base", planted)
    after = report()
    assert after["orders", "customer_id"] == before["orders", "customer_id"] + 1
    assert after["order_items", "order_id"] == before["order_items", "order_id"]


def test_a_section_writes_all_its_tables(spark, tmp_path):
    from tallyloom.runs import SECTIONS, run_section, section_queries

    from .conftest import DATA

    paths = run_section(spark, DATA, "descriptive", str(tmp_path))
    assert len(paths) == len(section_queries("descriptive")) >= 14
    assert spark.read.parquet(paths[0]).count() > 0
    assert all(section_queries(s) for s in SECTIONS)


def test_sections_run_on_csv_files_as_well(spark, tables, tmp_path):
    """The star tables written as the fourteen CSV files give the same answers."""
    from tallyloom.runs import run_section

    folder = tmp_path / "csv"
    for name, spec in REGISTRY.tables.items():
        if name == "sample_submission":
            df = tables.horizon(548).orderBy("row_id").selectExpr("date", "0.0 as revenue", "0.0 as cogs").coalesce(1)
        else:
            df = tables.orders_with_zip() if name == "orders" else tables.table(name)
        missing = [c for c in spec.schema.names if c not in df.columns and c != "conversion_rate"]
        df.selectExpr("*", *[f"cast(null as string) as {c}" for c in missing]).write.option("header", True).csv(
            str(folder / f"{name}.csv")
        )
    out = tmp_path / "out"
    for section in ("audit", "questions", "descriptive", "diagnostic"):
        run_section(spark, str(folder), section, str(out), "csv")
    load = lambda name: spark.read.parquet(str(out / name)).collect()
    from tallyloom.plans.catalog import run

    from .conftest import DATA

    for name in ("A01_median_order_gap", "A12_return_rate_by_size", "X08_return_rate_by_category", "D11_rating_distribution", "Q16_status_requires_child"):
        assert sorted(map(repr, load(name))) == sorted(map(repr, run(name, spark, DATA).collect())), name
    totals = {r.acquisition_channel: r.total_revenue for r in load("X04_channel_totals")}
    for r in run("X04_channel_totals", spark, DATA).collect():
        assert abs(totals[r.acquisition_channel] - r.total_revenue) < 1e-2
