import zipfile

from evispark.sources import workbooks as W

BOOK = '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="S" sheetId="1" r:id="i1"/></sheets></workbook>'
LINKS = '<Relationships xmlns="p"><Relationship Id="i1" Target="worksheets/sheet1.xml"/></Relationships>'
SHARED = '<sst xmlns="m"><si><t>gene</t></si><si><r><t>BR</t></r><r><t>CA1</t></r></si></sst>'
SHEET = '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AA1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="AA2"><v>12.0</v></c><c r="B2"/></row></sheetData></worksheet>'


def test_cells_and_records(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        for name, body in (("xl/workbook.xml", BOOK), ("xl/_rels/workbook.xml.rels", LINKS), ("xl/sharedStrings.xml", SHARED), ("xl/worksheets/sheet1.xml", SHEET)):
            z.writestr(name, body)
    (tmp_path / "b.txt").write_text("no")
    cells = W.workbook_cells(spark, str(tmp_path))
    assert {(r["sheet"], r["row"], r["col"], r["value"]) for r in cells.collect()} == {("S", 0, 0, "gene"), ("S", 0, 26, "n"), ("S", 1, 0, "BRCA1"), ("S", 1, 26, "12.0")}
    assert [r["fields"] for r in W.records(cells).collect()] == [{"gene": "BRCA1", "n": "12.0"}]
