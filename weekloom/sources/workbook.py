"""Spreadsheet workbooks (.xlsx) as a Spark data source, to read and to write.

A workbook is a ZIP archive of XML parts. A path names a workbook or a folder of them; every worksheet
part that is asked for is a partition of its own, whose archive member is parsed as a stream, so a task
holds the workbook's shared strings and one batch of rows. The format bounds both: a sheet has at most
1,048,576 rows.

All columns are read as text, like those of a CSV file, named by the first row of the sheet: numbers as
they are stored, cells with a date style as ISO dates (with a time where they have one), in either of
the two date systems. Cells that are missing, empty or hold an error are NULL, rows without any value are
left out. A sheet of another workbook may have its columns in another order; columns it lacks are NULL.

Writing makes one workbook per task, or several where a sheet would be full. Files become visible under
their names when the whole job is committed; a job that fails leaves none. Columns named by the option
``native_dates`` are text in which ISO dates become cells with a date style and all else stays text.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

FORMAT = "workbook"
BATCH_ROWS = 8192
# Fixed values of the format: rows of a sheet, number formats that are dates, first days, error texts' type.
SHEET_ROWS = 1_048_576
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
DAY_ZERO, DAY_ZERO_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Distinct strings a written workbook shares; later ones are written in their cells.
SHARED_STRINGS = 100_000


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def workbook_files(path: str) -> list[str]:
    """The workbook at ``path``, or those of the folder, in the order of their names."""
    fs, inner = _located(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no dataset at {path}")
    if info.type != pafs.FileType.Directory:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(inner))
    names = sorted(f.base_name for f in found if f.base_name.endswith(".xlsx") and f.base_name[0] not in "._~")
    return [f"{path.rstrip('/')}/{name}" for name in names]


def _attribute(element, name: str, default: str | None = None) -> str | None:
    return element.get(name, default)


def _unescaped(text: str) -> str:
    """Control characters are written as _x000D_ in the format."""
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _text_of(element) -> str:
    """The text of a string item: its own or that of its runs, without phonetic hints."""
    parts = []
    for child in element:
        if child.tag == f"{_MAIN}t":
            parts.append(child.text or "")
        elif child.tag == f"{_MAIN}r":
            parts += [t.text or "" for t in child.findall(f"{_MAIN}t")]
    return _unescaped("".join(parts))


def _is_date_code(code: str) -> bool:
    """Whether a number format shows a date or time: its letters outside quotes, brackets and escapes."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?![hms]+\])[^\]]*\]', "", code.split(";")[0].lower())
    return bool(re.search("[dmyhs]", bare.replace("general", "")))


class Workbook:
    """An open workbook: its sheets in order, and their rows."""

    def __init__(self, file):
        self.archive = zipfile.ZipFile(file)
        book = ElementTree.fromstring(self.archive.read("xl/workbook.xml"))
        properties = book.find(f"{_MAIN}workbookPr")
        is_1904 = properties is not None and _attribute(properties, "date1904", "0") in ("1", "true")
        self.day_zero = DAY_ZERO_1904 if is_1904 else DAY_ZERO
        links = ElementTree.fromstring(self.archive.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): r.get("Target") for r in links}
        self.sheets = {
            s.get("name"): posixpath.normpath(posixpath.join("xl", targets[s.get(f"{_REL}id")])).lstrip("/")
            for s in book.iter(f"{_MAIN}sheet")
        }
        self.sheets = {n: t.removeprefix("xl//") for n, t in self.sheets.items()}

    def _member(self, name: str):
        return self.archive.open(name) if name in self.archive.NameToInfo else None

    def shared_strings(self) -> list[str]:
        member = self._member("xl/sharedStrings.xml")
        if member is None:
            return []
        found = []
        with member:
            for _, element in ElementTree.iterparse(member):
                if element.tag == f"{_MAIN}si":
                    found.append(_text_of(element))
                    element.clear()
        return found

    def date_styles(self) -> set[int]:
        member = self._member("xl/styles.xml")
        if member is None:
            return set()
        with member:
            root = ElementTree.parse(member).getroot()
        codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
        cells = root.find(f"{_MAIN}cellXfs")
        numbers = [int(x.get("numFmtId", "0")) for x in cells] if cells is not None else []
        return {
            i for i, n in enumerate(numbers) if (_is_date_code(codes[n]) if n in codes else n in DATE_FORMATS)
        }

    def _date_text(self, value: str) -> str:
        days = float(value)
        # The older system counts a 29 February 1900 that never was.
        if self.day_zero == DAY_ZERO and days < 60:
            days += 1
        moment = self.day_zero + timedelta(seconds=round(days * 86400))
        return moment.strftime("%Y-%m-%d" if moment.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")

    def rows(self, sheet: str, head_only: bool = False) -> Iterator[dict[int, str]]:
        """The rows of a sheet as texts by column number, as they stream in."""
        shared, dates = self.shared_strings(), self.date_styles()
        with self.archive.open(self.sheets[sheet]) as member:
            parent = None
            for event, element in ElementTree.iterparse(member, ("start", "end")):
                if event == "start":
                    parent = element if element.tag == f"{_MAIN}sheetData" else parent
                elif element.tag == f"{_MAIN}row":
                    yield self._row(element, shared, dates)
                    if head_only:
                        return
                    parent.clear()

    def _row(self, row, shared: list[str], dates: set[int]) -> dict[int, str]:
        out, at = {}, -1
        for cell in row:
            at = column_number(cell.get("r")) if cell.get("r") else at + 1
            text = self._cell(cell, shared, dates)
            if text:
                out[at] = text
        return out

    def _cell(self, cell, shared: list[str], dates: set[int]) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            held = cell.find(f"{_MAIN}is")
            return None if held is None else _text_of(held)
        value = cell.find(f"{_MAIN}v")
        if value is None or value.text is None or kind == "e":
            return None
        if kind == "s":
            return shared[int(value.text)]
        if kind == "b":
            return "true" if value.text.strip() == "1" else "false"
        if kind == "n" and int(cell.get("s", "0")) in dates:
            return self._date_text(value.text)
        return _unescaped(value.text)


def column_number(reference: str) -> int:
    """0 for A1, 27 for AB3."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_letters(number: int) -> str:
    letters = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


@dataclass
class SheetPart(InputPartition):
    path: str
    sheet: str | None = None

    def __post_init__(self):
        super().__init__((self.path, self.sheet))


def _chosen(book: Workbook, sheet: str | None) -> list[str]:
    names = list(book.sheets)
    if sheet is None:
        return names[:1]
    if sheet == "*":
        return names
    if sheet not in book.sheets:
        raise ValueError(f"no sheet {sheet!r}; found {names}")
    return [sheet]


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, schema: StructType):
        if any(not isinstance(f.dataType, StringType) for f in schema.fields):
            raise ValueError("the columns of a workbook are read as strings; cast them afterwards")
        self.path, self.sheet, self.names = path, sheet, schema.names

    def partitions(self) -> list[SheetPart]:
        parts = []
        for path in workbook_files(self.path):
            if self.sheet != "*":
                parts.append(SheetPart(path, self.sheet))
                continue
            fs, inner = _located(path)
            with fs.open_input_file(inner) as file:
                parts += [SheetPart(path, name) for name in Workbook(file).sheets]
        return parts

    def read(self, partition: SheetPart) -> Iterator[pa.RecordBatch]:
        fs, inner = _located(partition.path)
        with fs.open_input_file(inner) as file:
            book = Workbook(file)
            for sheet in _chosen(book, partition.sheet):
                yield from self._batches(book.rows(sheet))

    def _batches(self, rows: Iterator[dict[int, str]]) -> Iterator[pa.RecordBatch]:
        header = {name: at for at, name in next(rows, {}).items()}
        places = [header.get(name) for name in self.names]
        held: list[list[str | None]] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([row[k] for row in held], pa.string()) for k in range(len(self.names))]
            return pa.RecordBatch.from_arrays(columns, names=self.names)

        for row in rows:
            if row:
                held.append([row.get(at) for at in places])
            if len(held) >= BATCH_ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    paths: tuple[str, ...]


class _Sheet:
    """One workbook being written: rows are streamed into its only sheet."""

    def __init__(self, fs: pafs.FileSystem, path: str, schema: pa.Schema, native_dates: set[str]):
        self.stream = fs.open_output_stream(path)
        self.archive = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_DEFLATED)
        self.native = [name in native_dates for name in schema.names]
        self.letters = [column_letters(k) for k in range(len(schema.names))]
        self.shared: dict[str, int] = {}
        self.rows = 0
        self._parts()
        self.sheet = self.archive.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self._write(f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>')
        self.add([[name] for name in schema.names])

    def _write(self, xml: str) -> None:
        self.sheet.write(xml.encode())

    def _parts(self) -> None:
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        package = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        relations = "http://schemas.openxmlformats.org/package/2006/relationships"
        office = _REL[1:-1]
        kinds = {
            "/xl/workbook.xml": "sheet.main",
            "/xl/worksheets/sheet1.xml": "worksheet",
            "/xl/styles.xml": "styles",
            "/xl/sharedStrings.xml": "sharedStrings",
        }
        overrides = "".join(f'<Override PartName="{p}" ContentType="{package}.{k}+xml"/>' for p, k in kinds.items())
        links = (("worksheet", "worksheets/sheet1.xml"), ("styles", "styles.xml"), ("sharedStrings", "sharedStrings.xml"))
        parts = {
            "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/>{overrides}</Types>',
            "_rels/.rels": f'<Relationships xmlns="{relations}"><Relationship Id="rId1" Type="{office}/officeDocument"'
            ' Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets>'
            '<sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{relations}">'
            + "".join(f'<Relationship Id="rId{k}" Type="{office}/{t}" Target="{p}"/>' for k, (t, p) in enumerate(links, 1))
            + "</Relationships>",
            "xl/styles.xml": f'<styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills>'
            '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3">'
            '<xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
        }
        for name, xml in parts.items():
            self.archive.writestr(name, head + xml)

    def _string(self, at: str, text: str) -> str:
        clean = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
        clean = re.sub("[\x00-\x08\x0b-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", clean)
        number = self.shared.get(clean)
        if number is None and len(self.shared) < SHARED_STRINGS:
            number = self.shared[clean] = len(self.shared)
        if number is not None:
            return f'<c r="{at}" t="s"><v>{number}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'

    def _cell(self, at: str, value, native: bool) -> str:
        if native and self.rows and isinstance(value, str) and re.fullmatch(r"\d{4}-\d\d-\d\d", value):
            value = date.fromisoformat(value)
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, datetime):
            spent = value.replace(tzinfo=None) - DAY_ZERO
            return f'<c r="{at}" s="2"><v>{spent / timedelta(days=1)!r}</v></c>'
        if isinstance(value, date):
            return f'<c r="{at}" s="1"><v>{(value - DAY_ZERO.date()).days}</v></c>'
        if isinstance(value, float) and value - value != 0:  # not a number, or infinite
            return self._string(at, str(value))
        if isinstance(value, str):
            return self._string(at, value)
        return f'<c r="{at}"><v>{value!r}</v></c>' if isinstance(value, float) else f'<c r="{at}"><v>{value}</v></c>'

    def add(self, columns: list[list]) -> None:
        for values in zip(*columns):
            number = self.rows + 1
            cells = [
                self._cell(f"{letters}{number}", value, native)
                for letters, value, native in zip(self.letters, values, self.native)
                if value is not None
            ]
            self._write(f'<row r="{number}">{"".join(cells)}</row>')
            self.rows = number

    def close(self) -> None:
        self._write("</sheetData></worksheet>")
        self.sheet.close()
        with self.archive.open("xl/sharedStrings.xml", "w") as out:
            out.write(f'<sst xmlns="{_MAIN[1:-1]}" uniqueCount={quoteattr(str(len(self.shared)))}>'.encode())
            for text in self.shared:
                out.write(f'<si><t xml:space="preserve">{escape(text)}</t></si>'.encode())
            out.write(b"</sst>")
        self.archive.close()
        self.stream.close()


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, native_dates: set[str], overwrite: bool):
        self.path, self.names, self.native_dates, self.overwrite = path, schema.names, native_dates, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _located(self.path)
        fs.create_dir(folder, recursive=True)
        sheet, paths = None, []
        for batch in iterator:
            start = 0
            while start < batch.num_rows:
                if sheet is None:
                    # A name of its own per attempt: a task that is run again writes beside the first.
                    paths.append(f"{folder}/_{self.job}-{uuid.uuid4().hex}.xlsx")
                    sheet = _Sheet(fs, paths[-1], batch.schema, self.native_dates)
                part = batch.slice(start, SHEET_ROWS - sheet.rows)
                sheet.add([column.to_pylist() for column in part.columns])
                start += part.num_rows
                if sheet.rows == SHEET_ROWS:
                    sheet.close()
                    sheet = None
        if sheet is not None:
            sheet.close()
        return Written(tuple(paths))

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _located(self.path)
        old = [_located(p)[1] for p in workbook_files(self.path)] if self.overwrite and self._exists() else []
        paths = [path for message in messages if message for path in message.paths]
        for number, path in enumerate(paths):
            fs.move(path, f"{folder}/part-{self.job}-{number:05d}.xlsx")
        for path in old:
            fs.delete_file(path)

    def _exists(self) -> bool:
        fs, folder = _located(self.path)
        return fs.get_file_info(folder).type == pafs.FileType.Directory

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _located(self.path)
        for message in messages:
            for path in message.paths if message else ():
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    fs.delete_file(path)


class WorkbookSource(DataSource):
    """``spark.read.format("workbook")``: options ``sheet`` (a name, or * for all; else the first)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        files = workbook_files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no workbook in {self.options['path']}")
        fs, inner = _located(files[0])
        with fs.open_input_file(inner) as file:
            book = Workbook(file)
            sheet = _chosen(book, self.options.get("sheet"))[0]
            head = next(book.rows(sheet, head_only=True), {})
        if len(set(head.values())) < len(head):
            raise ValueError(f"a column name comes twice in the first row: {list(head.values())}")
        return StructType([StructField(head[at], StringType()) for at in sorted(head)])

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self.options.get("sheet"), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        native = {c.strip() for c in self.options.get("native_dates", "").split(",")}
        return WorkbookWriter(self.options["path"], schema, native, overwrite)


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    _registered(spark)
    reader = spark.read.format(FORMAT)
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def write_workbooks(df: DataFrame, path: str, native_dates: tuple[str, ...] = (), mode: str = "append") -> None:
    _registered(df.sparkSession)
    df.write.format(FORMAT).mode(mode).option("native_dates", ",".join(native_dates)).save(path)
