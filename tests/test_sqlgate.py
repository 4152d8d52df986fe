import datetime
import json
from decimal import Decimal

import fleets
import pandas as pd
import pytest
from plan_text import plan

from readyscope import ReadinessBoard, SqlGate
from readyscope.operators.enrich import enrich
from readyscope.plans.sqlgate import QueryRefused, guard, json_records


@pytest.fixture(scope="module")
def fleet(spark):
    return enrich(fleets.golden_equipment(spark), fleets.golden_targets(spark))


@pytest.fixture(scope="module")
def gate(fleet):
    return SqlGate(fleet)


def test_aggregate_over_the_view(gate):
    answer = gate.answer(
        "select level_of_connection, count(*) as n from df_merged group by 1 order by n desc"
    )
    assert json.loads(answer) == [
        {"level_of_connection": "SRS READY", "n": 1646},
        {"level_of_connection": "NOT CONNECTED", "n": 411},
        {"level_of_connection": "CONNECTED BUT NOT SRS READY", "n": 229},
    ]


def test_documented_columns(gate):
    assert gate.query("SELECT * FROM df_merged").columns == [
        "equipment_serial_number", "level_of_connection", "system_id", "system_name",
        "business_line", "city", "state", "service_region", "current_connectivity_status",
        "equipment_installation_date", "material_id", "mobile_system_or_fixed_system?",
        "target_srs_ready",
    ]
    rows = json.loads(gate.answer(
        "SELECT `mobile_system_or_fixed_system?` AS m, count(*) AS n FROM df_merged"
        " GROUP BY 1 ORDER BY 1"
    ))
    assert [r["m"] for r in rows] == [None, "FIXED SYSTEM", "MOBILE SYSTEM"]


def test_row_cap(gate, fleet):
    assert len(json.loads(gate.answer("SELECT * FROM df_merged"))) == 20
    assert gate.query("SELECT * FROM df_merged LIMIT 3").count() == 3
    small = SqlGate({"t": fleet}, row_cap=5)
    assert small.query("SELECT * FROM t").count() == 5
    assert small.is_cut("SELECT * FROM t") and not small.is_cut("SELECT * FROM t LIMIT 5")
    whole = SqlGate({"t": fleet}, row_cap=None)
    assert whole.query("SELECT * FROM t").count() == 2286
    assert len(json.loads(whole.answer("SELECT system_id FROM t"))) == 2286


def test_an_answer_tells_when_rows_are_left_out(gate, caplog):
    gate.answer("SELECT * FROM df_merged LIMIT 20")
    assert not caplog.records
    gate.answer("SELECT * FROM df_merged")
    assert "only 20 rows" in caplog.text


@pytest.mark.parametrize(
    "query, answer",
    [
        ("WITH t AS (SELECT 1) SELECT * FROM t", "ERRO: somente consultas SELECT são permitidas."),
        ("drop view df_merged", "ERRO: somente consultas SELECT são permitidas."),
        ("", "ERRO: somente consultas SELECT são permitidas."),
        ("SELECT 1; SELECT 2", "ERRO: múltiplas instruções SQL não são permitidas."),
        ("SELECT ';' AS x", '[{"x":";"}]'),
        ("SELECT 'reflect identifier transform' AS x", '[{"x":"reflect identifier transform"}]'),
        ("SELECT 1 AS x UNION ALL SELECT 1", '[{"x":1},{"x":1}]'),
        ("(SELECT 1 AS x LIMIT 1)", '[{"x":1}]'),
        ("VALUES (1)", "ERRO: somente consultas SELECT são permitidas."),
        ("TABLE df_merged", "ERRO: somente consultas SELECT são permitidas."),
        ("SET x = 1", "ERRO: somente consultas SELECT são permitidas."),
        ("INSERT INTO df_merged SELECT * FROM df_merged", "ERRO: somente consultas SELECT são permitidas."),
        ("SELECT * FROM df_merged WHERE city = 'nowhere'", "Nenhum dado encontrado."),
        ("  select 1 as x;  ", '[{"x":1}]'),
    ],
)
def test_messages(gate, query, answer):
    assert gate.answer(query) == answer


def test_failures_are_answers(gate):
    assert gate.answer("SELECT pais FROM df_merged").startswith("SQL_ERROR: ")
    assert gate.answer("SELECT 1 AS a, 2 AS a").startswith("SQL_ERROR: ")
    assert gate.answer("SELECT 1/0 AS x").startswith("SQL_ERROR: ")


@pytest.mark.parametrize(
    "query",
    [
        "SELECT java_method('java.lang.System', 'getProperty', 'user.dir')",
        "SELECT `reflect`('java.lang.System', 'getProperty', 'user.dir')",
        "SELECT try_reflect /* */ ('java.lang.System', 'getProperty', 'user.dir')",
        "SELECT IDENTIFIER('java_' || 'method')('java.lang.System', 'getProperty', 'user.dir')",
        "SELECT TRANSFORM(system_id) USING 'cat' AS (x) FROM df_merged",
        "SELECT * FROM (SELECT TRANSFORM(system_id) USING 'cat' AS (x) FROM df_merged)",
        "SELECT 1 WHERE EXISTS (SELECT reflect('java.lang.System', 'nanoTime'))",
        "SELECT * FROM (WITH t AS (SELECT java_method('java.lang.System', 'nanoTime')) SELECT * FROM t)",
        "SELECT * FROM IDENTIFIER('df_' || 'merged')",
    ],
)
def test_java_calls_are_refused(spark, gate, query):
    with pytest.raises(QueryRefused):
        guard(spark, query, ["df_merged"])
    assert gate.answer(query).startswith("SQL_ERROR: ")


def test_files_cannot_be_read_by_path(spark, gate, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert gate.answer(f"SELECT * FROM parquet.`{path}`").startswith("SQL_ERROR: ")
    assert spark.sql(f"SELECT * FROM parquet.`{path}`").count() == 3


def test_gate_sees_only_its_views_and_leaves_none_behind(spark, gate):
    spark.range(1).createOrReplaceTempView("private_view")
    assert gate.answer("SELECT * FROM private_view").startswith("SQL_ERROR: ")
    spark.range(1).createOrReplaceGlobalTempView("shared_view")
    try:
        for name in ("global_temp.shared_view", "default.df_merged", "information_schema.tables"):
            assert gate.answer(f"SELECT * FROM {name}").startswith("SQL_ERROR: there is no view")
            inner = f"SELECT 1 AS x WHERE 1 IN (SELECT 1 FROM {name})"
            assert gate.answer(inner).startswith("SQL_ERROR: there is no view")
    finally:
        spark.catalog.dropGlobalTempView("shared_view")
    own = "SELECT * FROM (WITH t AS (SELECT 1 AS x) SELECT * FROM t)"
    assert gate.answer(own) == '[{"x":1}]'
    outside = "SELECT * FROM (WITH t AS (SELECT 1 AS x) SELECT * FROM t) JOIN t"
    assert gate.answer(outside).startswith("SQL_ERROR: there is no view t")
    assert [t.name for t in spark.catalog.listTables("global_temp")] == ["private_view"]
    assert not spark.catalog.tableExists("df_merged")


def test_gate_takes_over_settings(spark, fleet):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        answer = SqlGate(fleet).answer("SELECT current_timezone() AS z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert json.loads(answer) == [{"z": "America/Sao_Paulo"}]


def test_queries_that_need_no_target_skip_the_join(gate):
    text = plan(gate.query("SELECT business_line, count(*) AS n FROM df_merged GROUP BY 1"))
    assert "Join" not in text


def test_records_equal_those_of_a_pandas_frame(spark):
    rows = [
        (1, 1 / 3, Decimal("72.00"), "ação a/b \"x\"", True, datetime.date(2024, 2, 29),
         datetime.datetime(2024, 2, 29, 12, 30, 15, 500000)),
        (None, None, None, None, None, None, None),
        (-5, 1e-12, Decimal("-0.05"), "", False, datetime.date(1969, 12, 31),
         datetime.datetime(1969, 12, 31, 23, 0)),
        (7, float("nan"), Decimal("1"), "ß", False, datetime.date(2000, 1, 1),
         datetime.datetime(2000, 1, 1)),
        (8, float("inf"), Decimal("1"), "z", False, datetime.date(2000, 1, 1),
         datetime.datetime(2000, 1, 1)),
    ]
    schema = "i bigint, x double, d decimal(10,2), s string, b boolean, day date, t timestamp"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    found = [json.loads(r["record"]) for r in json_records(df).collect()]
    assert found == json.loads(df.toPandas().to_json(orient="records", force_ascii=False))
    naive = df.selectExpr("cast(t AS timestamp_ntz) AS t")
    assert [json.loads(r["record"])["t"] for r in json_records(naive).collect()] == [
        r["t"] for r in found
    ]


def test_board_answers(spark):
    board = ReadinessBoard(fleets.edge_equipment(spark), fleets.edge_targets(spark))
    assert json.loads(board.sql("SELECT count(target_srs_ready) AS n FROM df_merged")) == [{"n": 9}]
    assert json.loads(board.sql(
        "SELECT equipment_installation_date AS d FROM df_merged"
        " WHERE equipment_serial_number = '1'"
    )) == [{"d": int(pd.Timestamp("2024-03-15").timestamp() * 1000)}]


@pytest.mark.parametrize(
    "query",
    [
        "SELECT * FROM range(5)",
        "SELECT count(*) FROM df_merged, range(100000000000)",
        "SELECT * FROM VALUES (1), (2)",
        "SELECT * FROM sql_keywords()",
        "SELECT * FROM LATERAL explode(sequence(1, 1000000000))",
        "SELECT * FROM df_merged LATERAL VIEW explode(sequence(1, 1000000000)) t AS x",
        "SELECT * FROM df_merged, LATERAL (SELECT system_id)",
        "SELECT 1 WHERE 1 IN (SELECT id FROM range(3))",
        "SELECT (SELECT max(id) FROM range(3)) AS x",
        "FROM df_merged |> SELECT 1",
        "FROM df_merged SELECT city",
        "SELECT input_file_name() FROM df_merged",
        "SELECT city FROM df_merged WHERE input_file_block_start() > 0",
        "SELECT _metadata.file_path FROM df_merged",
        "SELECT df_merged._metadata FROM df_merged",
        "SELECT * FROM (SELECT * FROM (VALUES (1)))",
    ],
)
def test_other_relations_and_paths_are_refused(spark, gate, query):
    with pytest.raises(QueryRefused):
        guard(spark, query, ["df_merged"])
    assert gate.answer(query).startswith(("SQL_ERROR: ", "ERRO: "))


@pytest.mark.parametrize(
    "query",
    [
        "SELECT collect_list(city) AS x FROM df_merged",
        "SELECT business_line, array_agg(DISTINCT city) AS x FROM df_merged GROUP BY 1",
        "SELECT size(collect_set(city)) AS x FROM df_merged",
        "SELECT listagg(city, ',') AS x FROM df_merged",
        "SELECT 1 AS x WHERE 5 < (SELECT size(collect_list(city)) FROM df_merged)",
        "SELECT explode(sequence(1, 1000000000)) AS x",
        "SELECT stack(2, city, state) AS x FROM df_merged",
        "SELECT city, collect_list(state) OVER (PARTITION BY city) AS x FROM df_merged",
        "SELECT count(*) AS n FROM df_merged a, df_merged b",
        "SELECT count(*) AS n FROM df_merged a JOIN df_merged b ON a.target_srs_ready < b.target_srs_ready",
        "SELECT count(*) AS n FROM df_merged WHERE EXISTS (SELECT 1 FROM df_merged b JOIN df_merged c)",
    ],
)
def test_queries_without_a_bound_are_refused(gate, fleet, query):
    with pytest.raises(QueryRefused):
        gate.query(query)
    assert gate.answer(query).startswith("SQL_ERROR: ")


def test_bounds_can_be_lifted(fleet):
    free = SqlGate(fleet, bounded=False)
    lines = json.loads(free.answer("SELECT sort_array(collect_set(level_of_connection)) AS x FROM df_merged"))
    assert len(lines[0]["x"]) == 3


def test_bounded_queries_pass(gate):
    for query in (
        "SELECT a.system_id, count(*) AS n FROM df_merged a JOIN df_merged b"
        " ON a.equipment_serial_number = b.equipment_serial_number GROUP BY 1",
        "SELECT /* c */ city, count(*) AS n FROM df_merged TABLESAMPLE (100 PERCENT) GROUP BY city",
        "-- all lines\nSELECT business_line, max(target_srs_ready) AS t FROM df_merged GROUP BY ALL",
        "SELECT * FROM (SELECT business_line, level_of_connection FROM df_merged)"
        " PIVOT (count(*) FOR level_of_connection IN ('SRS READY' AS ready))",
        "SELECT city FROM df_merged WHERE target_srs_ready > (SELECT avg(target_srs_ready) FROM df_merged)",
        "SELECT city FROM df_merged WHERE city IN (SELECT city FROM df_merged WHERE state = 'SP')",
        "SELECT 'input_file_name _metadata' AS x",
    ):
        assert not gate.answer(query).startswith(("SQL_ERROR: ", "ERRO: ")), gate.answer(query)


def test_a_wide_record_fails_in_its_task(fleet):
    gate = SqlGate(fleet, value_limit=200)
    assert json.loads(gate.answer("SELECT repeat('x', 150) AS x")) == [{"x": "x" * 150}]
    assert "more than 200 bytes" in gate.answer("SELECT repeat('x', 300) AS x")


def test_window_and_set_operations(gate):
    best = json.loads(gate.answer(
        "SELECT service_region, business_line, n FROM ("
        " SELECT service_region, business_line, count(*) AS n, row_number() OVER (PARTITION BY service_region"
        " ORDER BY count(*) DESC, business_line) AS place FROM df_merged GROUP BY 1, 2)"
        " WHERE place <= 2 ORDER BY service_region, n DESC, business_line"
    ))
    assert len(best) == 12
    both = "SELECT business_line FROM df_merged WHERE level_of_connection = 'SRS READY' {} " \
        "SELECT business_line FROM df_merged WHERE business_line <> 'AXA' ORDER BY 1"
    assert {"business_line": "AXA"} not in json.loads(gate.answer(both.format("INTERSECT")))
    assert json.loads(gate.answer(both.format("EXCEPT"))) == [{"business_line": "AXA"}]
