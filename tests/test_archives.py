"""Workbooks, text documents and PDFs: round trips, odd values, files of others, broken files."""

import random
import zipfile

import pytest

from studylake.sources import office, pdf


@pytest.fixture(scope="module")
def sources(spark):
    office.register(spark)
    return spark


ODD = [(1, 0.1, True, " lead and trail "), (None, None, None, None), (2**60, float("inf"), False, ""), (-3, 1e300, None, "tab\tline\nnew\r\x01 <&> _x0041_ ￾ 日本 😀")]


@pytest.mark.parametrize("strings", ["shared", "inline"])
def test_workbooks_keep_odd_values(sources, tmp_path, strings):
    df = sources.createDataFrame(ODD, "a long, b double, c boolean, d string").repartition(2)
    path = f"file://{tmp_path}/book"
    df.write.format("xlsx").option("strings", strings).mode("append").save(path)
    read = sources.read.format("xlsx").schema("d string, a long, b double, c boolean, more string").load(path)
    assert sorted(map(str, (tuple(r) for r in read.select("a", "b", "c", "d").collect()))) == sorted(map(str, ODD))
    assert {r.more for r in read.collect()} == {None}
    df.limit(1).write.format("xlsx").mode("append").save(path)
    assert sources.read.format("xlsx").schema("a long").load(path).count() == 5
    df.limit(2).write.format("xlsx").mode("overwrite").save(path)
    assert sources.read.format("xlsx").schema("a long").load(path).count() == 2


def test_workbooks_of_others(sources, tmp_path):
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{office.MAIN}" xmlns:r="{office.OFFICE}"><sheets><sheet name="One" sheetId="1" r:id="a"/><sheet name="Two" sheetId="2" r:id="b"/><sheet name="Gone" sheetId="3" r:id="z"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{office.PACKAGE}/relationships"><Relationship Id="a" Target="worksheets/x.xml"/><Relationship Id="b" Target="/xl/worksheets/y.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{office.MAIN}"><si><t>k</t></si><si><r><t>ri</t></r><r><rPr/><t>ch</t></r><rPh><t>no</t></rPh></si></sst>',
        "xl/worksheets/x.xml": f'<worksheet xmlns="{office.MAIN}"><sheetData><row><c t="s"><v>0</v></c><c r="C1" t="str"><v>v</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><f>1+1</f><v>2</v></c></row><row><c r="C3" t="e"><v>#N/A</v></c></row></sheetData></worksheet>',
        "xl/worksheets/y.xml": f'<worksheet xmlns="{office.MAIN}"><sheetData><row><c t="inlineStr"><is><t>v</t></is></c></row><row><c t="b"><v>1</v></c></row></sheetData></worksheet>',
    }
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/b.xlsx").write_bytes(office._zip(parts))
    (tmp_path / "~lock.xlsx").write_bytes(b"no archive")
    read = sources.read.format("xlsx").schema("k string, v string").load(f"file://{tmp_path}")
    assert sorted(map(str, (tuple(r) for r in read.collect()))) == ["('rich', '2')", "(None, 'true')", "(None, None)"]
    assert sources.read.format("xlsx").schema("v int").load(f"file://{tmp_path}").where("v = 2").count() == 1


def test_cells_have_a_limit(sources, tmp_path):
    with pytest.raises(Exception, match="32767"):
        sources.createDataFrame([("x" * 40_000,)], "a string").write.format("xlsx").mode("append").save(f"file://{tmp_path}/long")
    assert not list(tmp_path.glob("long/*.xlsx"))


def test_sheets_have_a_limit(tmp_path, monkeypatch):
    monkeypatch.setattr(office, "SHEET_ROWS", 3)
    monkeypatch.setattr(office, "_attempt", lambda: "00000-1")
    from pyspark.sql.types import LongType, StructField, StructType

    writer = office._SheetWriter(f"file://{tmp_path}", False, StructType([StructField("a", LongType())]), True)
    assert len(writer.write(iter([(1,), (2,), (3,)])).names) == 2


def test_text_documents(sources, tmp_path):
    rows = [("a", "one\ntwo\t\tthree\n\n last "), ("b", ""), ("c", None), ("d", "_x000D_ \x02 <w:p> & \r")]
    path = f"file://{tmp_path}/docs"
    sources.createDataFrame(rows, "name string, text string").write.format("docx").mode("append").save(path)
    lines = {}
    for r in sources.read.format("docx").load(path).orderBy("file", "place").collect():
        lines.setdefault(r.file.split("-")[0], []).append(r.text)
    assert {k: "\n".join(v) for k, v in lines.items()} == {k: v or "" for k, v in rows}
    body = '<w:tbl><w:tr><w:tc><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>He</w:t></w:r><w:r><w:t>ad</w:t><w:br/></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>'
    with zipfile.ZipFile(tmp_path / "docs/other.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{office.WORD}"><w:body>{body}</w:body></w:document>')
    assert [(r.place, r.style, r.text) for r in sources.read.format("docx").load(path).where("file = 'other.docx'").orderBy("place").collect()] == [(0, "Heading1", "Head\n"), (1, None, "")]


def test_empty_folders(sources, tmp_path):
    assert sources.read.format("xlsx").schema("a int").load(f"file://{tmp_path}").count() == 0 == sources.read.format("docx").load(f"file://{tmp_path}").count()


@pytest.mark.parametrize("streams", [False, True])
@pytest.mark.parametrize("pages", [0, 1, 7, 300])
def test_pages_of_both_forms(pages, streams):
    data = pdf.made(pages, streams)
    assert pdf.count_pages(data) == pages
    # an update at the end of the file, whose table points to the one before it
    start = int(data.rpartition(b"startxref\n")[2].split()[0])
    more = data + b"2 0 obj\n<< /Count 99 /Kids [] /Type /Pages /Note (a \\) b (c)) /X <41> >>\nendobj\n"
    at = len(more)
    more += b"xref\n2 1\n%010d 00000 n \ntrailer\n<< /Size 9 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (len(data), start, at)
    assert pdf.count_pages(more) == 99


def test_broken_files_have_no_count():
    for data in (None, b"", b"%PDF-1.4", b"no", b"%PDF-1.4\nstartxref\n5\n%%EOF", b"%PDF-1.4\nstartxref\n99999999999999\n%%EOF"):
        assert pdf.count_pages(data) is None
    rnd = random.Random(2)
    for streams in (False, True):
        data = pdf.made(5, streams)
        for n in range(0, len(data) - 12, 3):
            assert pdf.count_pages(data[:n]) is None
        for _ in range(3000):
            bad = bytearray(data)
            for _ in range(rnd.randrange(1, 6)):
                bad[rnd.randrange(len(bad))] = rnd.choice([0, 48, 57, 60, 62, 91, 93, 40, 41, rnd.randrange(256)])
            found = pdf.count_pages(bytes(bad))  # never raises
            assert found is None or found >= 0
    loop = b"%PDF-1.4\n1 0 obj\n1 0 R\nendobj\nxref\n0 2\n0000000000 65535 f \n0000000009 00000 n \ntrailer\n<< /Root 1 0 R /Prev 36 >>\nstartxref\n36\n%%EOF"
    assert pdf.count_pages(loop) is None
    assert pdf.count_pages(b"%PDF-1.4\n" + b"[" * 200_000 + b"startxref\n9\n%%EOF") is None
