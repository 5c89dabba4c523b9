import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from orbitspark.sources import delimited, documents, ledger, records


def test_catalogue_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Object Name,NORAD Cat Id,Launch-Date,Period\nVANGUARD 1,5,1958-03-17,132.7\nX, 7 ,oops,\n")
    kinds = {"object_name": "string", "norad_cat_id": "long", "launch_date": "date", "period": "double", "rcs": "double"}
    got = [tuple(r) for r in delimited.read_catalogue_csv(spark, str(p), kinds).collect()]
    assert got == [("VANGUARD 1", 5, dt.date(1958, 3, 17), 132.7, None), ("X", 7, None, None, None)]
    assert {r[0]: r[1] for r in delimited.bad_cells(spark, str(p), kinds).collect()}["launch_date"] == 1


def test_commented_tsv(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text("#JCAT\tName\tMass\tX\n# banner\nS1\tAlpha\t12\tq\nS2\t-\theavy\nS3\tB\t1\ty\textra\n")
    got = delimited.read_commented_tsv(spark, str(p), {"JCAT": "jcat", "Name": "name", "Mass": "mass"}, {"mass": "double"}).orderBy("jcat").collect()
    assert [(r["jcat"], r["name"], r["mass"], r["extra"]) for r in got] == [("S1", "Alpha", 12.0, {"X": "q"}), ("S2", None, None, {"_unparsed_mass": "heavy"}), ("S3", "B", 1.0, {"X": "y"})]


def test_mapped_and_keyword_tables(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("DATE,KP1\n2024-01-01,23\n,5\n")
    assert delimited.read_mapped_csv(spark, str(p), {"DATE": "day", "KP1": "kp1"}, {"day": "date", "kp1": "int"}).collect()[0][1] == 23
    with pytest.raises(delimited.SchemaDrift):
        delimited.read_mapped_csv(spark, str(p), {"DATE": "day"}, {"day": "date"})
    t = spark.createDataFrame([(0, ["Report"]), (1, ["Call Sign", "Satellite Name"]), (2, ["", "section"]), (3, ["S1", "N/A"])], "i int, cells array<string>")
    assert [tuple(r) for r in delimited.read_keyword_table(t, "cells", "i", {"call_sign": ("call",), "name": ("name",)}).collect()] == [("S1", None)]
    s = tmp_path / "s.txt"
    s.write_text("Name;COSPAR;Users\nAlpha;2020-001A;Civil\n")
    r = delimited.read_seed(spark, str(s), {"Name": "name", "COSPAR": "cospar_id"}, "name", "cospar_id").first()
    import hashlib

    assert r["row_key"] == hashlib.sha1(b"Alpha|2020-001A").hexdigest() and r["extra"] == {"Users": "Civil"}


def test_record_dump(spark, tmp_path):
    raw = "1|Caf\xe9 €|a\r\nb|x|tail|^|\r\n2|short|^|\r\n".encode("cp1252")
    p = tmp_path / "d.zip"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("T.dat", raw)
        z.writestr("other/U.dat", b"3|y|^|\r\n")
    want = [("1", "Café €", "a\r\nb", "x"), ("2", "short", None, None)]
    names = ["a", "b", "c", "d"]
    assert [tuple(r) for r in records.read_zipped_records(spark, str(p), names, "T.dat").collect()] == want
    assert records.read_zipped_records(spark, str(p), names).count() == 3
    (tmp_path / "d.dat").write_bytes(raw)
    assert [tuple(r) for r in records.read_records(spark, str(tmp_path / "d.dat"), names).collect()] == want


def test_elements_and_api(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text('[{"NORAD_CAT_ID":"5","EPOCH":"2024-01-01T00:00:00","MEAN_MOTION":"15.1"},{"NORAD_CAT_ID":"x","EPOCH":"2024-01-01T00:00:00"}]')
    ok, skipped = documents.read_elements(spark, str(p), "gp")
    assert ok.first()["norad_id"] == 5 and ok.first()["mean_motion"] == 15.1 and skipped.first()[0] == 1
    q = tmp_path / "t.json"
    q.write_text('{"next":null,"results":[{"uuid":"a","alive":true,"zzz":1}]}')
    assert [tuple(r) for r in documents.read_known_keys(spark, str(q), "uuid string, alive boolean, baud double").collect()] == [("a", True, None)]
    assert spark.range(1).select(documents.is_error_stub(F.lit('[{"error":"limit"}]'))).first()[0] is True


def test_html_and_trees(spark):
    assert documents.badges('<a href="t.php?file=x"><b>3</b></a><a href="legend">9</a>', "file=") == {"t.php?file=x": 3}
    with pytest.raises(documents.StructureChanged):
        documents.badges("<p>none</p>", "file=")
    assert documents.code_table("<table><tr><td> AB </td><td><a href='#'>Abbey</a></td></tr></table>") == {"AB": "Abbey"}
    tree = '{"date":{"display_value":"2024-01-02 10:00","value":"x"},"x":[[{"name":" n ","url":"h/a/u1?x=1"}],{"y":{"name":"m","url":"h/v","date":"2023-05-06"}},{"name":"again","url":"h/b/v/"},{"name":"none","url":7}]}'
    df = spark.createDataFrame([(1, tree), (2, "{bad"), (3, None), (4, "[]")], "k int, body string")
    got = sorted(tuple(r) for r in documents.walk_json(df, "k", "body").collect())
    assert got == [(1, "u1", "n", "h/a/u1", "2024-01-02"), (1, "v", "again", "h/b/v/", "2024-01-02")]


def test_reports(spark):
    pages = ["Applicant: Acme\nSchedule S\nInclination Angle 53.0", "Apogee 550\nInclination Angle 70.0\nApogee 560"]
    df = spark.createDataFrame([("F1", pages)], "file string, pages array<string>")
    assert df.select(documents.is_report(F.col("pages"), ["Schedule S", "Applicant", "zzz"])).first()[0] is True
    s = documents.scalars(df, "file", {"applicant": r"Applicant: (\w+)", "none": r"Nothing (\d)"}).first()
    assert (s["applicant"], s["applicant_page"], s["none"]) == ("Acme", 1, None)
    g = documents.labelled_groups(df, "file", r"(Inclination Angle|Apogee) ([\d.]+)", {"Inclination Angle": "inc", "Apogee": "apo"}).orderBy("block").collect()
    assert [(r["inc"], r["inc_page"], r["apo"], r["apo_page"]) for r in g] == [(53.0, 1, 550.0, 2), (70.0, 2, 560.0, 2)]
    b = spark.createDataFrame([(bytearray(b"%PDF-1.7 ... %%EOF\n"),), (bytearray(b"%PDF-1.7 cut"),)], "c binary")
    assert [r[0] for r in b.select(documents.is_complete_pdf(F.col("c"))).collect()] == [True, False]


def test_ledger_and_sinks(spark, tmp_path):
    now = dt.datetime(2024, 1, 2)
    runs = spark.createDataFrame([(1, "s", "e", "running", dt.datetime(2024, 1, 1), None), (1, "s", "e", "ok", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 1)), (2, "s", "e", "error", now, now)], "ingest_run_id long, source string, endpoint string, status string, started_at timestamp, finished_at timestamp")
    one = ledger.collapse(runs)
    assert {r["ingest_run_id"]: r["status"] for r in one.collect()} == {1: "ok", 2: "error"}
    assert ledger.is_fresh(one, "s", "e", now, dt.timedelta(days=2)) and not ledger.is_fresh(one, "s", "e", now, dt.timedelta(hours=1))
    df = spark.createDataFrame([(1, "a|b")], "k int, v string")
    ledger.append_run(df, str(tmp_path / "raw"), 7)
    assert spark.read.parquet(str(tmp_path / "raw")).first()["ingest_run_id"] == 7
    path = f"file://{tmp_path}/board"
    ledger.publish(df, path)
    ledger.publish(df.union(df), path)
    assert ledger.current(spark, path).count() == 2
    assert ledger.markdown_table(df, [F.col("k")]) == "| k | v |\n|---|---|\n| 1 | a\\|b |\n"
    y = tmp_path / "s.yml"
    y.write_text("- {name: Acme, code: AC, zz: 1}\n- {name: Bee}\n")
    assert [tuple(r) for r in ledger.read_seed(spark, str(y), "name string, code string").collect()] == [("Acme", "AC"), ("Bee", None)]
