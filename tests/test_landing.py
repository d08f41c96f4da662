import pytest

from tenora.sources import landing as L
from tenora.sources import sinks as K
from tenora.sources.audit import AuditLog
from tenora.sources.query import fetch

CSV = 'Customer ID,Monthly Charge,Joined On,Note,Empty\n1,10.5,2024-01-02,"a, b",\n40000,7,2024-02-03,x,\n,1e2,2024-03-04,7,\n'


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in_cleaned"  # only file names are filtered, not folders
    src.mkdir()
    (src / "people.csv").write_text(CSV)
    (src / "people_transformed.csv").write_text(CSV)
    (src / "other.csv").write_text("a\n1\n")
    (src / "notes.txt").write_text("x")
    return src


def test_discovery_registry_and_missing_files(spark, folder):
    files = L.discover(spark, str(folder))
    assert {r["file_name"] for r in files.collect()} == {"people.csv", "other.csv"}
    names = L.registry_frame(spark, {"people.csv": "Customers", "gone.csv": "Gone"})
    assert [r["table_name"] for r in L.mapped_files(files, names).collect()] == ["Customers"]
    assert [r["file_name"] for r in L.missing_files(files, names).collect()] == ["gone.csv"]
    assert L.has_sources(files, names) and not L.has_sources(files, L.registry_frame(spark, {"no.csv": "N"}))


def test_type_ladder_looks_at_all_rows(spark, folder):
    text = L.read_text(spark, str(folder / "people.csv"))
    assert text.columns == ["Customer_ID", "Monthly_Charge", "Joined_On", "Note", "Empty"]
    kinds = {r["column"]: r["type"] for r in L.infer_types(text).collect()}
    assert kinds == {
        "Customer_ID": "int", "Monthly_Charge": "decimal(18,3)", "Joined_On": "date", "Note": "string", "Empty": "string"}
    first = {r["column"]: r["type"] for r in L.infer_types(text, "first").collect()}
    assert first["Customer_ID"] == "smallint"


def test_typed_load_fails_whole_and_reject_variant_splits(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    (tmp_path / "x.csv").write_text("a,b\n1,2\nbad,3\n4,5\n")
    schema = L.T.StructType.fromDDL("a int, b int")
    with pytest.raises(Exception):
        L.load_typed(spark, path, schema).collect()
    good, bad = L.load_with_rejects(spark, path, schema)
    assert sorted(map(tuple, good.collect())) == [(1, 2), (4, 5)]
    assert [tuple(r) for r in bad.collect()] == [("bad", "3")]


def test_positional_staging_keeps_quoted_commas(spark, folder):
    got = L.read_positional(spark, str(folder / "people.csv"), 5).orderBy("col3").first()
    assert (got["col1"], got["col4"], got["col5"]) == ("1", "a, b", None)
    assert dict(L.read_inferred(spark, str(folder / "people.csv")).dtypes)["Customer_ID"] == "int"


def test_import_folder_logs_and_exports(spark, folder, tmp_path):
    log = AuditLog(spark, str(tmp_path / "log"))
    target = str(tmp_path / "out")
    done = L.import_folder(spark, str(folder), {"people.csv": "Customers", "gone.csv": "Gone"}, target, log)
    assert list(done) == ["Customers"]
    table = spark.read.parquet(done["Customers"])
    assert table.count() == 3 and dict(table.dtypes)["Monthly_Charge"] == "decimal(18,3)"
    assert K.read_export(spark, f"{target}/export/Customers").schema == table.schema
    latest = {(r["FileName"], r["Status"]) for r in log.latest().collect()}
    assert latest == {("people.csv", "Success"), ("gone.csv", "Failed"), (None, "Success")}


def test_failed_import_is_logged_with_its_condition(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "t.csv").write_text("a\n1\n99999\n")
    log = AuditLog(spark, str(tmp_path / "log"))
    assert L.import_folder(spark, str(src), {"t.csv": "T"}, str(tmp_path / "out"), log, infer_rows="first") == {}
    assert {r["Status"] for r in log.latest().collect() if r["TableName"]} == {"Data Import Failed"}
    assert [r["Operation"] for r in log.errors().collect()] == ["import T"]


def test_failed_import_keeps_the_earlier_table(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    log, target, names = AuditLog(spark, str(tmp_path / "log")), str(tmp_path / "out"), {"t.csv": "T"}
    (src / "t.csv").write_text("a\n1\n")
    assert list(L.import_folder(spark, str(src), names, target, log)) == ["T"]
    (src / "t.csv").write_text("a\n1\n99999\n")
    assert L.import_folder(spark, str(src), names, target, log, infer_rows="first") == {}
    assert [r.a for r in L.imported(spark, target, "T").collect()] == [1]
    assert list(L.import_folder(spark, str(src), names, target, log)) == ["T"]
    assert sorted(r.a for r in L.imported(spark, target, "T").collect()) == [1, 99999]


def test_no_sources_stops_and_logs(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "t.csv").write_text("a\n1\n")
    log = AuditLog(spark, str(tmp_path / "log"))
    assert L.import_folder(spark, str(src), {"u.csv": "U"}, str(tmp_path / "out"), log) == {}
    assert [r["Status"] for r in log.imports().collect()] == ["Failed"]


def test_publish_switches_versions_only_after_validation(spark, tmp_path):
    root = str(tmp_path / "dw")
    one, two = spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([(2,)], "v int")
    K.publish({"t": one}, root, "v1", lambda t: t["t"].filter("v > 1"))
    with pytest.raises(ValueError):
        K.publish({"t": two}, root, "v2", lambda t: t["t"].filter("v > 1"))
    assert K.published(spark, root, ["t"])["t"].first()["v"] == 1
    K.publish({"t": two}, root, "v3")
    assert K.published(spark, root, ["t"])["t"].first()["v"] == 2


def test_reports_tables_and_sql(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    K.write_report({"r": df}, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep" / "r")).count() == 1
    K.save_table(df, "saved_table", L.T.StructType.fromDDL("id smallint, s string"))
    assert dict(spark.table("saved_table").dtypes)["id"] == "smallint"
    assert fetch(spark, "SELECT count(*) AS n FROM {t}", t=df).first()["n"] == 1
    with pytest.raises(FileNotFoundError):
        K.load_model(spark, str(tmp_path / "nothing"))


def test_split_is_literal(spark):
    from tenora.sources.landing import split_cells

    for mark in ("|", ".", "\\", "^", "[", "||", ","):
        cells = split_cells(spark.createDataFrame([(f"a{mark}b",)], "line string"), "line", mark).collect()
        assert [c.cell for c in cells] == ["a", "b"], mark


def test_positional_staging_rejects_a_wider_header(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("a,b,c\n1,2,3\n")
    assert L.read_positional(spark, str(tmp_path / "wide.csv"), 3).first()["col3"] == "3"
    with pytest.raises(ValueError, match="3 columns"):
        L.read_positional(spark, str(tmp_path / "wide.csv"), 2)


def test_numbers_too_long_for_the_declared_decimal_stay_text(spark):
    rows = spark.createDataFrame([("1234567890123456", "123456789012345.5"), ("1", "2")], "long_id string, fits string")
    found = {r["column"]: r["type"] for r in L.infer_types(rows).collect()}
    assert found == {"long_id": "string", "fits": "decimal(18,3)"}


def test_ledger_imports_only_what_is_new(spark, tmp_path):
    from tenora.sources.ledger import ImportLedger, import_new

    src = tmp_path / "in a+b"
    src.mkdir()
    for name, text in (("a.csv", "The id,v\n1,007\n2,8\n"), ("b.csv", "The id,v\n3,9\n"), ("x_cleaned.csv", "q\n1\n"), ("u.csv", "q\n1\n")):
        (src / name).write_text(text)
    names = {"a.csv": "T", "b.csv": "T", "part.csv": "T", "gone.csv": "T", "e.csv": "E"}
    ledger = ImportLedger(spark, str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        ledger.table("T")

    def run():
        read = import_new(ledger, str(src), names)
        last = ledger.entries().agg(L.F.max("Run")).first()[0]
        got = ledger.entries().filter(f"Run = {last} AND FileName IS NOT NULL").collect()
        return read, {r.FileName: (r.Action, r.Rows) for r in got if r.Action != "missing"}

    def table():
        return sorted((r.The_id, r.v) for r in ledger.table("T").collect())

    assert run() == ({"T": 2}, {"a.csv": ("new", 2), "b.csv": ("new", 1)})
    assert table() == [(1, 7), (2, 8), (3, 9)] and dict(ledger.table("T").dtypes)["v"] == "smallint"
    assert run() == ({}, {"a.csv": ("unchanged", None), "b.csv": ("unchanged", None)})
    (src / "part.csv").mkdir()  # a source of several files
    (src / "part.csv" / "part-0.csv").write_text("The id,v\n4,1\n")
    (src / "part.csv" / "part-1.csv").write_text("The id,v\n5,2\n")
    (src / "b.csv").write_text("The id,v\n3,10\n33,11\n")
    (src / "e.csv").write_text("only,header\n")
    assert run() == ({"E": 1, "T": 2}, {
        "a.csv": ("unchanged", None), "b.csv": ("changed", 2), "part.csv": ("new", 2), "e.csv": ("new", 0)})
    assert table() == [(1, 7), (2, 8), (3, 10), (4, 1), (5, 2), (33, 11)] and ledger.table("E").count() == 0
    (src / "b.csv").write_text("The id,v\n3,word\n")  # text: every source of the table is read again
    read, actions = run()
    assert read == {"T": 3} and actions["a.csv"] == ("retyped", 2)
    assert table() == [(1, "007"), (2, "8"), (3, "word"), (4, "1"), (5, "2")]
    ids = [r.LogID for r in ledger.entries().orderBy("LogID").collect()]
    assert ids == list(range(1, len(ids) + 1))


def test_ledger_keeps_the_table_of_a_failed_import(spark, tmp_path):
    from tenora.sources.ledger import CORRECTABLE, ImportLedger, import_new

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("id\n1\n")
    (src / "o.csv").write_text("id\n5\n")
    ledger, names = ImportLedger(spark, str(tmp_path / "out")), {"a.csv": "T", "o.csv": "Other"}
    import_new(ledger, str(src), names, {"T": "id int"})
    (src / "a.csv").write_text("id\nword\n")
    (src / "o.csv").write_text("id\n6\n7\n")
    assert import_new(ledger, str(src), names, {"T": "id int"}) == {"Other": 1}
    failed = ledger.entries().filter("Run = 2 AND TableName = 'T'").first()
    assert (failed.Action, failed.Status, failed.ErrorSeverity) == ("changed", "Data Import Failed", CORRECTABLE)
    assert failed.ErrorNumber and failed.ErrorState and failed.ErrorProcedure == "_load" and failed.ErrorLine > 0
    assert [r.id for r in ledger.table("T").collect()] == [1]
    (src / "a.csv").write_text("id\n2\n")
    assert import_new(ledger, str(src), names, {"T": "id int"}) == {"T": 1}
    assert [r.id for r in ledger.table("T").collect()] == [2]
    (src / "a.csv").write_text("other\n2\n")
    import_new(ledger, str(src), names)
    assert ledger.entries().orderBy("LogID").filter("Run = 4 AND TableName = 'T'").first().ErrorNumber == "ValueError"


def test_ledger_without_sources(spark, tmp_path):
    from tenora.sources.ledger import ImportLedger, import_new

    (tmp_path / "in").mkdir()
    ledger = ImportLedger(spark, str(tmp_path / "out"))
    assert import_new(ledger, str(tmp_path / "in"), {"a.csv": "T"}) == {}
    got = [(r.LogID, r.FileName, r.Status, r.ErrorMessage) for r in ledger.entries().orderBy("LogID").collect()]
    assert got == [(1, None, "Failed", "No source files found"), (2, "a.csv", "Failed", "File a.csv does not exist")]


def test_type_ladder_tries_whole_numbers_once_and_counts_each_failure(spark):
    from pyspark.sql import functions as F

    values = ["1", " -5 ", "40000", "-32768", "3000000000", "1234567890123456", "1.5", ".", "1e3", "1e99", "2020-01-02", "2020-13-45", "x", "", None, "+7", "\t8"]
    text = spark.createDataFrame([(v, "1" if v else None) for v in values], "a string, b string")

    def failures(column):
        bad = []
        for _, cast, shape in L.TYPE_LADDER:
            ok = F.when(F.col(column).rlike(shape), F.col(column).try_cast(cast).isNotNull()).otherwise(False)
            bad.append(text.filter(F.col(column).isNotNull() & ~ok).count())
        return bad

    got = {r.column: (r.position, r.non_null, [r.bad_0, r.bad_1, r.bad_2, r.bad_3]) for r in L.infer_types(text).collect()}
    assert got == {"a": (0, 16, failures("a")), "b": (1, 15, failures("b"))}
    plan = L.infer_types(text)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and plan.count("RLIKE") <= 6
