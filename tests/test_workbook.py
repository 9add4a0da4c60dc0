"""Workbooks made by hand, part by part, and workbooks written and read back."""

from __future__ import annotations

import glob
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from weekloom.params import SalesColumns
from weekloom.sources import sales as so
from weekloom.sources import workbook as wb

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _workbook(path, sheets: dict[str, str], shared: str = "", styles: str = "", properties: str = "") -> str:
    """An archive with the given sheet data; targets are written with and without a leading slash."""
    names = list(sheets)
    with zipfile.ZipFile(path, "w") as out:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}">{properties}<sheets>{listed}</sheets></workbook>')
        targets = [f"/xl/worksheets/s{i}.xml" if i % 2 else f"worksheets/s{i}.xml" for i in range(1, len(names) + 1)]
        links = "".join(f'<Relationship Id="r{i}" Target="{t}"/>' for i, t in enumerate(targets, 1))
        out.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x">{links}</Relationships>')
        for i, data in enumerate(sheets.values(), 1):
            out.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{data}</sheetData></worksheet>')
        if shared:
            out.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{shared}</sst>')
        if styles:
            out.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
    return str(path)


STYLES = (
    '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="[Red]0.00&quot;days&quot;"/>'
    '<numFmt numFmtId="166" formatCode="[$-409]d mmm"/></numFmts>'
    '<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf/></cellXfs>'
)
SHARED = (
    "<si><t>State</t></si><si><t>Date</t></si><si><r><t>Oh</t></r><r><rPr/><t xml:space=\"preserve\">io </t></r><rPh><t>no</t></rPh></si>"
    "<si><t>13-02-2019</t></si><si><t>a_x000D_b &amp; _x005F_x0041_</t></si>"
)
ROWS = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>Total</t></is></c></row>'
    '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" s="1"><v>43509</v></c><c r="C2"><v>9</v></c><c r="D2"><v>1.5E3</v></c></row>'
    '<row r="3"><c r="A3" t="s"><v>4</v></c><c r="B3" t="s"><v>3</v></c><c r="D3" s="3"><v>2</v></c></row>'
    '<row r="4"/><row r="5"><c r="D5" t="e"><v>#N/A</v></c></row>'
    '<row r="6"><c r="B6" s="2"><v>43509.75</v></c><c r="D6" t="b"><v>1</v></c></row>'
    '<row r="7"><c t="str"><v>by place</v></c><c s="4"><v>59</v></c><c/><c s="5"><v>-0.25</v></c></row>'
    '<row r="8"><c r="B8" s="1"><v>61</v></c><c r="D8" t="str"><f>1+1</f></c></row>'
)


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_cells_of_every_kind(spark, tmp_path):
    path = _workbook(tmp_path / "a.xlsx", {"first": ROWS, "second": ROWS.replace("Total", "Sum")}, SHARED, STYLES)
    df = wb.read_workbooks(spark, path)
    assert df.columns == ["State", "Date", "Total"] and set(dict(df.dtypes).values()) == {"string"}
    assert _rows(df) == [
        ("Ohio ", "2019-02-13", "1.5E3"),
        ("a\rb & _x0041_", "13-02-2019", "2"),
        (None, "2019-02-13 18:00:00", "true"),
        ("by place", "1900-02-28", "-0.25"),
        (None, "1900-03-01", None),
    ]


def test_sheets_and_the_other_date_system(spark, tmp_path):
    properties = '<workbookPr date1904="1"/>'
    path = _workbook(tmp_path / "a.xlsx", {"first": ROWS, "second": ROWS.replace("Total", "Sum")}, SHARED, STYLES, properties)
    second = wb.read_workbooks(spark, path, "second")
    assert second.columns[-1] == "Sum" and _rows(second.select("Date"))[0] == ("2023-02-14",)
    both = wb.read_workbooks(spark, path, "*")
    assert both.count() == 10 and both.rdd.getNumPartitions() == 2
    # The sheet that lacks a column of the first leaves it empty.
    assert sorted(r[0] or "" for r in both.select("Total").collect()).count("") == 6
    with pytest.raises(Exception, match="no sheet 'third'"):
        wb.read_workbooks(spark, path, "third").collect()


def test_broken_and_missing_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        so.read_raw(spark, str(tmp_path / "none.xlsx"))
    head = '<row r="1"><c r="A1" t="str"><v>a</v></c><c r="B1" t="str"><v>a</v></c></row>'
    with pytest.raises(Exception, match="comes twice"):
        wb.read_workbooks(spark, _workbook(tmp_path / "twice.xlsx", {"s": head})).collect()
    empty = wb.read_workbooks(spark, _workbook(tmp_path / "head.xlsx", {"s": head.replace('B1" t="str"><v>a', 'B1" t="str"><v>b')}))
    assert empty.columns == ["a", "b"] and empty.count() == 0


def test_written_and_read_back(spark, tmp_path, monkeypatch):
    odd = ["", " lead", "a\tb\nc", "<&>\"'", "_x0041_", "\x01", "é😀", "2020-01-05", None, "x" * 5000]
    rows = [(i, odd[i % len(odd)], "2020-02-29" if i % 2 else "29-02-2020", i / 7, i % 3 == 0, date(2021, 3, 4), datetime(2021, 3, 4, 5, 6, 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, s string, d string, v double, b boolean, day date, at timestamp").repartition(3)
    path = str(tmp_path / "out")
    wb.write_workbooks(df, path, native_dates=("d",))
    assert len(glob.glob(f"{path}/*.xlsx")) == 3 == len(glob.glob(f"{path}/*"))
    got = {int(r["i"]): r for r in wb.read_workbooks(spark, path).collect()}
    for i, s, d, v, b, _, _ in rows:
        r = got[i]
        assert (r["s"], r["d"], float(r["v"]), r["b"]) == (s or None, d, v, str(b).lower())
        assert (r["day"], r["at"]) == ("2021-03-04", "2021-03-04 05:06:07")
    # Text that looks like a date stays text where the column is not named.
    assert got[7]["s"] == "2020-01-05"
    wb.write_workbooks(df.limit(2), path, mode="append")
    assert wb.read_workbooks(spark, path).count() == 502
    wb.write_workbooks(df.limit(2), path, mode="overwrite")
    assert wb.read_workbooks(spark, path).count() == 2


def test_a_full_sheet_starts_another_workbook(tmp_path, monkeypatch):
    import pyarrow as pa
    from pyspark.sql.types import StructType

    monkeypatch.setattr(wb, "SHEET_ROWS", 5)
    monkeypatch.setattr(wb, "SHARED_STRINGS", 2)
    writer = wb.WorkbookWriter(str(tmp_path), StructType.fromDDL("a string"), set(), False)
    message = writer.write(iter([pa.record_batch({"a": [f"v{i}" for i in range(11)]})]))
    writer.commit([message, None])
    reader = wb.WorkbookReader(str(tmp_path), None, StructType.fromDDL("a string"))
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert [b.num_rows for b in batches] == [4, 4, 3]
    assert [v for b in batches for v in b.column("a").to_pylist()] == [f"v{i}" for i in range(11)]


def test_a_failed_job_leaves_no_workbook(spark, tmp_path):
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("a"))
    with pytest.raises(Exception, match="stop"):
        wb.write_workbooks(bad.repartition(2), str(tmp_path / "out"))
    assert not [f for f in glob.glob(f"{tmp_path}/out/*") if not f.rsplit("/", 1)[-1].startswith("_")]


def test_sales_in_a_workbook(spark, tmp_path):
    path = _workbook(tmp_path / "sales.xlsx", {"first": ROWS.replace('<row r="6">', '<row r="6"><c r="A6" t="str"><v>Iowa</v></c>').replace(' t="b"', "")}, SHARED, STYLES)
    columns = SalesColumns("State", "Date", "Total", "State")
    got = so.scan_sales(spark, path, columns).select("series_id", "ds", "value").where("value > 1").collect()
    assert [tuple(r) for r in got] == [("Ohio ", date(2019, 2, 13), 1500.0), ("a\rb & _x0041_", date(2019, 2, 13), 2.0)]


@pytest.mark.parametrize(
    "code,is_date",
    [("General", False), ("0.00", False), ("yyyy-mm-dd", True), ('0 "days"', False), ("[h]:mm", True), ("[Red]0", False),
     ("#,##0_d", False), ("\\d0", False), ("d-mmm-yy;@", True), ("@", False), ('"Day" d', True)],
)
def test_date_formats(code, is_date):
    assert wb._is_date_code(code) == is_date


def test_column_letters():
    assert [wb.column_letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(wb.column_number(wb.column_letters(n) + "7") == n for n in range(0, 3000, 7))
