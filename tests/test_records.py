from plazamill.sources import records

SCHEMA = "id:long, decision:string"


def test_event_readers(spark, tmp_path):
    forms = {"lines": '{"id": 1, "decision": "a"}\n{"id": 2}\n', "list": '[{"id": 1, "decision": "a"},\n {"id": 2}]', "object": '{"results":\n [{"id": 1, "decision": "a"}, {"id": 2}]}'}
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
        assert sorted(map(tuple, records.events(spark, str(tmp_path / name), SCHEMA).collect())) == [(1, "a"), (2, None)], name


def test_catalog_and_append(spark, tmp_path):
    (tmp_path / "c.json").write_text('﻿{"metadata": {}, "instituciones": [{"id": 1, "nombre": "Ñuble"}, {"id": 2}]}', encoding="utf-8")
    rows = records.catalog(spark, str(tmp_path / "c.json"), "id:long, nombre:string")
    assert sorted(map(tuple, rows.collect())) == [(1, "Ñuble"), (2, None)]
    for _ in range(2):
        records.append(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
