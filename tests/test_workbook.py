"""Workbooks made by hand against the delimited files that say the same."""

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from orbitspark.sources import delimited, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(sheets: dict[str, str], strings=(), formats="", styles=(0,), more="") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f"<workbook {NS} {REL}>{more}<sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{sheets[n]}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {NS}><numFmts>{formats}</numFmts><cellXfs>" + "".join(f'<xf numFmtId="{f}"/>' for f in styles) + "</cellXfs></styleSheet>")
    return out.getvalue()


def test_cells_of_every_kind():
    row = (
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3"><v>41</v></c><c r="D3"><v>0.5</v></c><c r="E3" t="b"><v>1</v></c><c r="F3" s="1"><v>45292</v></c>'
        '<c r="G3" s="2"><v>45292.5</v></c><c r="H3" t="inlineStr"><is><r><t>two</t></r><r><t> runs</t></r></is></c><c r="I3" t="e"><v>#N/A</v></c><c r="J3" t="str"><f>A1</f><v>=x</v></c><c r="AA3"><v>1E3</v></c></row><row><c><v>7</v></c></row>'
    )
    b = workbook.Book(book({"one": row, "two": ""}, ["<t>shared</t><rPh><t>hint</t></rPh>"], '<numFmt numFmtId="170" formatCode="&quot;d&quot; 0.0"/><numFmt numFmtId="171" formatCode="yyyy\\-mm"/>', (0, 14, 171, 170)))
    (n, cells), (m, last) = b.rows("one")
    assert (n, m, last) == (3, 4, ["7"]) and list(b.rows("two")) == [] and b.dates == {1, 2}
    assert cells[:10] == ["shared", None, "41", "0.5", "true", "2024-01-01", "2024-01-01 12:00:00", "two runs", None, "=x"] and cells[26] == "1000" and len(cells) == 27
    old = workbook.Book(book({"s": '<row><c s="1"><v>0</v></c></row>'}, styles=(0, 14), more='<workbookPr date1904="1"/>'))
    assert list(old.rows("s")) == [(1, ["1904-01-01"])]


def test_a_workbook_reads_as_its_csv(spark, tmp_path):
    rows = [("List of stations", None, None), (None, None, None), ("Call Sign", "Satellite Name", "In-orbit date"), ("Region 1", None, None)]
    rows += [(f"S{i}", None if i % 7 == 0 else f"Bird & <{i}>", None if i % 3 else f"2024-01-{i % 28 + 1:02}") for i in range(5_000)] + [(None, "footnote", None)]
    strings, at = [], {}

    def cell(ref, v):
        if v is None:
            return ""
        if v not in at:
            at[v] = len(strings)
            strings.append(f"<t>{escape(v)}</t>")
        return f'<c r="{ref}" t="s"><v>{at[v]}</v></c>'

    xml = "".join(f'<row r="{i}">' + "".join(cell(f"{c}{i}", v) for c, v in zip("ABC", r, strict=True)) + "</row>" for i, r in enumerate(rows, 1))
    (tmp_path / "a.xlsx").write_bytes(book({"notes": '<row r="1"><c r="A1"><v>1</v></c></row>', "data": xml}, strings))
    keywords = {"call_sign": ("call", "sign"), "name": ("satellite",), "since": ("in-orbit",)}
    got = workbook.read_workbook_table(spark, f"file://{tmp_path}/a.xlsx", keywords, "data", 3)
    csv = spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows, 1)], "row long, cells array<string>")
    want = delimited.read_keyword_table(csv, "cells", "row", keywords, 3)
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 5_000
    assert workbook.read_workbook(spark, f"file://{tmp_path}/a.xlsx").groupBy("sheet").agg(F.count(F.lit(1))).count() == 2
