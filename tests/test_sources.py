from __future__ import annotations

import os

import pytest

from conftest import collect
from folio.schemas import PRIMARY_KEY, REQUIRED_COLUMNS, SPINE_TABLES, declared
from folio.session import scratch_path, shared_folder
from folio.sources import labels, spine


def write(path, text: str, encoding: str = "utf-8") -> str:
    path.write_text(text, encoding=encoding, newline="")
    return str(path)


NOTES = '''note_id,customer_id,scenario,note_text,note_date,extra
N1,C1,s,"a, ""quoted""
second line",2024-01-05,x
N2,C1,s,plain,not a date,y
'''


def test_csv_cells_may_hold_commas_quotes_and_breaks(spark, tmp_path):
    path = write(tmp_path / "customer_notes.csv", NOTES)
    rows = {r.note_id: r for r in spine.read_csv(spark, path, "customer_notes").collect()}
    assert rows["N1"].note_text == 'a, "quoted"\nsecond line' and str(rows["N1"].note_date) == "2024-01-05"
    assert rows["N2"].note_date is None and rows["N2"].note_text == "plain"
    assert rows["N2"]._corrupt_record is not None and rows["N1"]._corrupt_record is None


def test_missing_columns_are_named_in_order(spark, tmp_path):
    path = write(tmp_path / "orders.csv", "order_id,order_date\nO1,2024-01-01\n")
    with pytest.raises(spine.SchemaDrift, match=r"\['customer_id', 'delivery_status'\]"):
        spine.read_csv(spark, path, "orders")


def test_load_stamps_the_tenant_and_stored_tables_come_back(spark, tmp_path):
    for table in SPINE_TABLES:
        names = [f.name for f in declared(table)]
        write(tmp_path / f"{table}.csv", ",".join(names) + "\n" + ",".join("1" if n.endswith("_id") else "" for n in names) + "\n")
    loaded = spine.load_spine(spark, str(tmp_path), "demo")
    assert set(loaded) == set(SPINE_TABLES) and all(set(df.columns) >= {*REQUIRED_COLUMNS.get(t, ()), "tenant_id"} for t, df in loaded.items())
    folder = str(tmp_path / "stored")
    spine.write_spine(loaded, folder)
    stored = spine.read_spine(spark, folder)
    assert collect(spine.table_counts(stored)) == sorted((t, 1) for t in SPINE_TABLES)
    assert collect(spine.for_tenant(stored["orders"], "demo"), "order_id") == ["1"]
    assert collect(spine.for_tenant(stored["orders"], "other")) == []


def test_snapshot_is_taken_once(spark, tmp_path):
    source, backup = str(tmp_path / "source"), str(tmp_path / "bak")
    spark.range(3).write.parquet(f"{source}/orders")
    spine.snapshot_once(spark, source, backup, ("orders",))
    spark.range(9).write.mode("overwrite").parquet(f"{source}/orders")
    spine.snapshot_once(spark, source, backup, ("orders",))
    assert spark.read.parquet(f"{backup}/orders").count() == 3


def test_sheets(spark, tmp_path):
    a = write(tmp_path / "sheet_a.csv", "case_id,decision,confidence,labeler,notes\nH001,monitor,3,alex,\nH002,,,alex,\nH003,maybe,1,alex,\n", "utf-8-sig")
    assert collect(labels.read_label_sheets(spark, a)) == [("alex", "H001", "Monitor")]
    b = write(tmp_path / "sheet_b.csv", 'case_id,decision,confidence,labeler,notes\nH001,Escalate,,,"x\ny"\nH001, STABILIZE ,,,\n,Monitor,,,\n')
    assert collect(labels.read_label_sheets(spark, a, b)) == [("alex", "H001", "Monitor"), ("sheet_b", "H001", "Stabilize")]
    c = write(tmp_path / "sheet_c.csv", "case_id,decision,confidence,labeler,notes\nH009,Escalate,,alex,\n")
    assert collect(labels.read_label_sheets(spark, a, b, c)) == [("alex", "H009", "Escalate"), ("sheet_b", "H001", "Stabilize")]


def test_predictions_keep_the_last_valid_one(spark, tmp_path):
    path = write(tmp_path / "p.json", '{"model": "m", "predictions": [{"case_id": "H1", "predicted_decision": "monitor"},\n{"case_id": "H1", "predicted_decision": "Escalate"},'
                 '{"case_id": "H1", "predicted_decision": "?"}, {"case_id": "H2", "predicted_decision": ""}]}')
    assert collect(labels.read_predictions(spark, path)) == [("H1", "Escalate")]


def test_written_cases_have_an_empty_sheet(spark, tmp_path):
    cases = spark.createDataFrame([("H002", "R2"), ("H001", "R1")], "case_id string, review_id string")
    labels.write_cases(cases, str(tmp_path / "set"))
    sheet = [f for f in os.listdir(tmp_path / "set" / "label_sheet") if f.endswith(".csv")]
    assert len(sheet) == 1
    lines = (tmp_path / "set" / "label_sheet" / sheet[0]).read_text().splitlines()
    assert lines == ["case_id,decision,confidence,labeler,notes", "H001,,,,", "H002,,,,"]
    assert spark.read.json(str(tmp_path / "set" / "cases")).count() == 2
    labels.write_eval(cases, str(tmp_path / "eval"), headline=spark.range(1))
    assert spark.read.json(str(tmp_path / "eval" / "headline")).count() == 1


def test_every_keyed_table_declares_its_key():
    assert all(key in declared(table).names for table, key in PRIMARY_KEY.items())


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named and scratch_path(spark, "x").startswith(named)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
