"""Workbooks (XLSX) and text documents (DOCX) as data sources: both are ZIP archives of XML parts. Register with `register(spark)`.

    spark.read.format("xlsx").schema("a long, b string").load(folder)         one partition for each sheet of each file
    df.write.format("xlsx").mode("append").save(folder)                       one file a task that has rows
    spark.read.format("docx").load(folder)                                    file, place, style, text of each paragraph; table cells are paragraphs
    spark.read.format("docx").option("rows", "documents").load(folder)        file, styles, texts of each document, the paragraphs in order
    df.write.format("docx").mode("append").save(folder)                       columns name, text: one file a row, one paragraph a line

Paths are folders that driver and executors share, on any file system that Arrow opens by its address. A task writes files whose names hold the
attempt; commit() keeps those of the attempts that won and deletes others, abort() deletes all. Overwriting empties the folder of such files at the
commit. Text documents stand in folders of FILES files and FOLDER_BYTES at most, of one attempt each: driver and messages know these folders alone, a reader's task
lists its own. A workbook goes to its file row by row, so a task holds a row and the texts that it shares, SHARED characters at most; further texts stand in
their cells. Characters that XML can't hold are written as _xHHHH_, as the format has it, in both kinds of files.

Defined results: null is a cell that is not there; an empty text stays one; a sheet's first row holds the names of columns, in any order; columns that a
sheet has not are null and those that nobody asked for are left out; a value that is not of its column's type is null. A sheet holds 1,048,576 rows
and SHEET_BYTES at most, so a task with more writes several; a cell holds 32,767 characters at most, and a longer text is an error. Texts that are read may
be shared, inline or rich.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from itertools import chain
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the formats: rows of a sheet, characters of a cell, names of parts and namespaces.
SHEET_ROWS, CELL_CHARACTERS = 1 << 20, 32_767
#: Bytes of a sheet, well under the 2 GB of a part of unknown size, and characters of the texts that a workbook shares, with so many more for each text.
SHEET_BYTES, SHARED, EACH_SHARED = 1 << 30, 16 << 20, 64
#: Bytes that go to a part at once.
BUFFER = 1 << 18
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
ODD_CHARACTER = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\r]")
FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|\r|_x[0-9A-Fa-f]{4}_")
ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def to_xml(text: str) -> str:
    """Text for an XML part; what XML can't hold as _xHHHH_, and a text that looks like that with its first character so."""
    if "_x" in text or ODD_CHARACTER.search(text):
        text = FORBIDDEN.sub(lambda m: f"_x{ord(m[0][0]):04X}_" + m[0][1:], text)
    return escape(text)


def from_xml(text: str) -> str:
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _files(folder: str, ending: str) -> list[str]:
    from pyarrow import fs

    store, root = _open(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(ending) and not f.base_name.startswith(("_", ".", "~")))


def _archive(folder: str, path: str) -> zipfile.ZipFile:
    store, _ = _open(folder)
    return zipfile.ZipFile(store.open_input_file(path))


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets by id of the relations of a part."""
    folder, _, name = part.rpartition("/")
    try:
        root = ElementTree.fromstring(archive.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    return {r.get("Id", ""): r.get("Target", "").lstrip("/") if r.get("Target", "").startswith("/") else f"{folder}/{r.get('Target')}" for r in root}


# ---- workbooks
def _letters(column: int) -> str:
    out = ""
    while column >= 0:
        column, digit = divmod(column, 26)
        out, column = chr(65 + digit) + out, column - 1
    return out


def _column(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _texts(root: ElementTree.Element) -> str:
    """The runs of a text; phonetic guides are none."""
    own = [x.text or "" for x in root.findall(f"{{{MAIN}}}t")] + [x.text or "" for r in root.findall(f"{{{MAIN}}}r") for x in r.findall(f"{{{MAIN}}}t")]
    return from_xml("".join(own))


class _Sheet(InputPartition):
    def __init__(self, path: str, part: str):
        super().__init__((path, part))


def _as(value: object, kind: T.DataType) -> object:
    """A cell's value in its column's type, null if it is none."""
    try:
        if isinstance(kind, T.StringType):
            return ("true" if value else "false") if isinstance(value, bool) else str(value)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "1": True, "false": False, "0": False}.get(str(value).lower())
        if isinstance(kind, T.IntegralType):
            return int(value) if re.fullmatch(r"[+-]?\d+", str(value)) else int(float(str(value))) if float(str(value)).is_integer() else None
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            return float(str(value))
    except (ValueError, OverflowError):
        return None
    raise TypeError(f"workbooks have no {kind.simpleString()}; read text and cast it")


class _SheetReader(DataSourceReader):
    def __init__(self, folder: str, schema: T.StructType):
        self.folder, self.schema = folder, schema

    def partitions(self) -> list[_Sheet]:
        out = []
        for path in _files(self.folder, ".xlsx"):
            with _archive(self.folder, path) as archive:
                targets = _relations(archive, "xl/workbook.xml")
                sheets = ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")
                out += [_Sheet(path, targets[s.get(f"{{{OFFICE}}}id")]) for s in sheets if s.get(f"{{{OFFICE}}}id") in targets]
        return out or [_Sheet("", "")]

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        path, part = partition.value
        if not path:
            return
        with _archive(self.folder, path) as archive:
            shared = self._shared(archive) if "xl/sharedStrings.xml" in archive.namelist() else []
            names: list[str | None] = []
            with archive.open(part) as stream:
                for row in self._rows(stream, shared):
                    if not names:
                        names = [str(v) if v is not None else None for v in row]
                        continue
                    cells = dict(zip(names, row, strict=False))
                    yield tuple(None if (v := cells.get(f.name)) is None else _as(v, f.dataType) for f in self.schema)

    @staticmethod
    def _shared(archive: zipfile.ZipFile) -> list[str]:
        """The shared texts as they come; what has been read is cleared."""
        out = []
        with archive.open("xl/sharedStrings.xml") as stream:
            events = ElementTree.iterparse(stream, events=("start", "end"))
            _, root = next(events)
            for event, x in events:
                if event == "end" and x.tag == f"{{{MAIN}}}si":
                    out.append(_texts(x))
                    root.clear()
        return out

    @staticmethod
    def _rows(stream, shared: list[str]) -> Iterator[list]:
        """Rows of a sheet as they come; each is cleared when it has been read."""
        top = None
        for event, x in ElementTree.iterparse(stream, events=("start", "end")):
            if event == "start":
                top = x if x.tag == f"{{{MAIN}}}sheetData" else top
                continue
            if x.tag != f"{{{MAIN}}}row":
                continue
            row: list = []
            for at, cell in enumerate(x):
                place = _column(cell.get("r")) if cell.get("r") else at
                row += [None] * (place + 1 - len(row))
                kind, value = cell.get("t", "n"), cell.find(f"{{{MAIN}}}v")
                if kind == "inlineStr":
                    row[place] = _texts(cell.find(f"{{{MAIN}}}is"))
                elif kind in ("s", "str", "b", "n") and (value is not None or kind == "str"):
                    raw = (value.text or "") if value is not None else ""
                    row[place] = shared[int(raw)] if kind == "s" else from_xml(raw) if kind == "str" else raw == "1" if kind == "b" else raw
            yield row
            if top is not None:
                top.clear()


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _FolderWriter(DataSourceWriter):
    """Files of one kind in a folder; names hold the job and the attempt."""

    def __init__(self, folder: str, overwrite: bool, ending: str):
        self.folder, self.overwrite, self.ending, self.job = folder, overwrite, ending, uuid.uuid4().hex[:12]

    def _stream(self, name: str):
        store, root = _open(self.folder)
        store.create_dir(root, recursive=True)
        return store.open_output_stream(f"{root}/{name}")

    def _drop(self, keep: set[str]) -> None:
        store, root = _open(self.folder)
        for path in _files(self.folder, self.ending):
            name = path.rpartition("/")[2]
            if name not in keep and (self.overwrite or f"-{self.job}-" in name):
                store.delete_file(path)

    def commit(self, messages: list) -> None:
        store, root = _open(self.folder)
        store.create_dir(root, recursive=True)
        self._drop({n for m in messages if m for n in m.names})
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        self.overwrite = False
        self._drop(set())


def _attempt() -> str:
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{task.partitionId():05d}-{task.taskAttemptId()}"


class _SheetWriter(_FolderWriter):
    def __init__(self, folder: str, overwrite: bool, schema: T.StructType, inline: bool):
        super().__init__(folder, overwrite, ".xlsx")
        self.names, self.inline = schema.names, inline

    def write(self, rows: Iterator) -> _Written:
        attempt, names, rows = _attempt(), [], iter(rows)
        while (first := next(rows, None)) is not None:
            name, left = self._book(chain([first], rows), attempt, len(names))
            names.append(name)
            rows = chain(left, rows)
        return _Written(names)

    def _book(self, rows: Iterator, attempt: str, number: int) -> tuple[str, list]:
        """Write one workbook of as many rows as a sheet takes; its name and the row, if any, that came and did not fit."""
        numbers: dict[str, int] = {}
        letters, room, left = [_letters(k) for k in range(len(self.names))], SHARED, []

        def cell(place: str, value: object) -> str:
            nonlocal room
            if value is None:
                return ""
            if isinstance(value, bool):
                return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
            if isinstance(value, (int, float)):
                return f'<c r="{place}"><v>{value!r}</v></c>'
            text = str(value)
            if len(text) > CELL_CHARACTERS:
                raise ValueError(f"a cell holds {CELL_CHARACTERS} characters, not {len(text)}")
            if not self.inline and text not in numbers and len(text) + EACH_SHARED <= room:
                room -= len(text) + EACH_SHARED
                numbers[text] = len(numbers)
            if text not in numbers:
                return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{to_xml(text)}</t></is></c>'
            return f'<c r="{place}" t="s"><v>{numbers[text]}</v></c>'

        types = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        kind = f"{OFFICE}/"
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{types}sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}worksheet+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="{types}sharedStrings+xml"/></Types>',
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{kind}officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{kind}worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{kind}sharedStrings" Target="sharedStrings.xml"/></Relationships>',
        }
        name = f"part-{self.job}-{attempt}-{number}.xlsx"
        with self._stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for part, xml in parts.items():
                archive.writestr(part, HEAD + xml)
            with io.BufferedWriter(archive.open("xl/worksheets/sheet1.xml", "w"), BUFFER) as sheet:
                size = sheet.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                for i, row in enumerate(chain([self.names], rows), 1):
                    line = f'<row r="{i}">{"".join(cell(f"{at}{i}", v) for at, v in zip(letters, row, strict=True))}</row>'.encode()
                    if i > 2 and size + len(line) > SHEET_BYTES:
                        left = [row]
                        break
                    size += sheet.write(line)
                    if i == SHEET_ROWS:
                        break
                sheet.write(b"</sheetData></worksheet>")
            with io.BufferedWriter(archive.open("xl/sharedStrings.xml", "w"), BUFFER) as texts:
                texts.write(f'{HEAD}<sst xmlns="{MAIN}">'.encode())
                for text in numbers:
                    texts.write(f'<si><t xml:space="preserve">{to_xml(text)}</t></si>'.encode())
                texts.write(b"</sst>")
        return name, left


def _zip(parts: dict[str, str]) -> bytes:
    """An archive of parts; short ones are stored as they are."""
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        for name, xml in parts.items():
            archive.writestr(name, HEAD + xml, zipfile.ZIP_DEFLATED if len(xml) > SHORT else zipfile.ZIP_STORED, 1)
    return made.getvalue()


class Workbooks(DataSource):
    """Format xlsx. Options: path; strings = shared or inline when writing."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SheetReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _SheetWriter(self.options["path"], overwrite, schema, self.options.get("strings") == "inline")


# ---- text documents
#: Files and bytes of a folder that a writer makes and of a partition of a reader; bytes of a batch of whole documents; characters of a short part; bytes of a file that is read at once.
FILES, FOLDER_BYTES, BATCH_BYTES, SHORT, AT_ONCE = 2048, 16 << 20, 1 << 20, 600, 1 << 20
FOLDER = re.compile(r"docx-([0-9a-f]{12})-\d+-\d+-\d+")
BREAKS = {f"{{{WORD}}}tab": "\t", f"{{{WORD}}}br": "\n", f"{{{WORD}}}cr": "\n", f"{{{WORD}}}noBreakHyphen": "‑"}
PARAGRAPH, PROPERTIES, STYLE, VALUE, RUN_TEXT = (f"{{{WORD}}}{x}" for x in ("p", "pPr", "pStyle", "val", "t"))
FIXED = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
}


def _folders(folder: str) -> tuple[list[str], list]:
    """The folders that writers have made in a folder, and its other files and folders."""
    from pyarrow import fs

    store, root = _open(folder)
    info = store.get_file_info(root)
    found = store.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info]
    own = [f.path for f in found if f.type == fs.FileType.Directory and FOLDER.fullmatch(f.base_name)]
    return sorted(own), [f for f in found if f.path not in set(own)]


def _documents(store, found: list) -> list:
    """Text documents among files and, however deep, in folders."""
    from pyarrow import fs

    deep = [x for f in found if f.type == fs.FileType.Directory for x in store.get_file_info(fs.FileSelector(f.path, recursive=True))]
    return sorted((f for f in [*found, *deep] if f.type == fs.FileType.File and f.base_name.lower().endswith(".docx") and not f.base_name.startswith(("_", ".", "~"))), key=lambda f: f.path)


class _Files(InputPartition):
    """A folder that a writer has made, or paths of files."""

    def __init__(self, paths: str | list[str]):
        super().__init__(paths)


class _TextReader(DataSourceReader):
    def __init__(self, folder: str, whole: bool = False):
        self.folder, self.whole = folder, whole

    def partitions(self) -> list[_Files]:
        own, others = _folders(self.folder)
        out, size = [_Files(path) for path in own], FOLDER_BYTES
        loose: list[list[str]] = []
        for f in _documents(_open(self.folder)[0], others):
            if size + f.size > FOLDER_BYTES or len(loose[-1]) == FILES:
                loose.append([])
                size = 0
            loose[-1].append(f.path)
            size += f.size
        return out + [_Files(paths) for paths in loose] or [_Files([])]

    def read(self, partition: _Files) -> Iterator:
        from pyarrow import fs

        store, _ = _open(self.folder)
        paths = partition.value
        if isinstance(paths, str):
            paths = [f.path for f in _documents(store, store.get_file_info(fs.FileSelector(paths)))]
        return self._whole(store, paths) if self.whole else ((path.rpartition("/")[2], place, *x) for path in paths for place, x in enumerate(self._paragraphs(store, path)))

    def _whole(self, store, paths: list[str]) -> Iterator:
        """Arrow batches of a document a row, of BATCH_BYTES or one document."""
        import pyarrow as pa

        lists, files, styles, texts, size = pa.list_(pa.string()), [], [], [], 0
        batch = lambda: pa.record_batch([pa.array(files, pa.string()), pa.array(styles, lists), pa.array(texts, lists)], names=["file", "styles", "texts"])
        for path in paths:
            found = list(self._paragraphs(store, path))
            files.append(path.rpartition("/")[2])
            styles.append([x for x, _ in found])
            texts.append([x for _, x in found])
            size += sum(map(len, texts[-1]))
            if size >= BATCH_BYTES:
                yield batch()
                files, styles, texts, size = [], [], [], 0
        if files:
            yield batch()

    @staticmethod
    def _paragraphs(store, path: str) -> Iterator[tuple[str | None, str]]:
        with store.open_input_file(path) as file, zipfile.ZipFile(io.BytesIO(file.read()) if file.size() <= AT_ONCE else file) as archive, archive.open("word/document.xml") as stream:
            for _, x in ElementTree.iterparse(stream):
                if x.tag != PARAGRAPH:
                    continue
                properties = x.find(PROPERTIES)
                style = None if properties is None else properties.find(STYLE)
                pieces = [(r.text or "") if r.tag == RUN_TEXT else BREAKS.get(r.tag, "") for r in x.iter()]
                yield None if style is None else style.get(VALUE), from_xml("".join(pieces))
                x.clear()


class _TextWriter(_FolderWriter, DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool, schema: T.StructType):
        super().__init__(folder, overwrite, ".docx")
        self.name, self.text = schema.names.index("name"), schema.names.index("text")

    def write(self, batches: Iterator) -> _Written:
        attempt, names, room, files = _attempt(), [], 0, 0
        store, root = _open(self.folder)
        for name, text in (row for b in batches for row in zip(b.column(self.name).to_pylist(), b.column(self.text).to_pylist(), strict=True)):
            if room <= 0 or files == FILES:
                names.append(f"docx-{self.job}-{attempt}-{len(names)}")
                store.create_dir(f"{root}/{names[-1]}", recursive=True)
                room, files = FOLDER_BYTES, 0
            made = self._document(text or "")
            with store.open_output_stream(f"{root}/{names[-1]}/{name}-{self.job}-{attempt}-{files}.docx") as out:
                out.write(made)
            room, files = room - len(made), files + 1
        return _Written(names)

    def _drop(self, keep: set[str]) -> None:
        store, _ = _open(self.folder)
        own, others = _folders(self.folder)
        for path in own:
            name = path.rpartition("/")[2]
            if name not in keep and (self.overwrite or FOLDER.fullmatch(name)[1] == self.job):
                store.delete_dir(path)
        for f in _documents(store, others) if self.overwrite else []:
            store.delete_file(f.path)

    @staticmethod
    def _document(text: str) -> bytes:
        run, end = '<w:t xml:space="preserve">', "</w:t>"
        lines = to_xml(text).replace("\t", f"{end}<w:tab/>{run}").replace("\n", f"{end}</w:r></w:p><w:p><w:r>{run}")
        return _zip(FIXED | {"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body><w:p><w:r>{run}{lines}{end}</w:r></w:p></w:body></w:document>'})


class TextDocuments(DataSource):
    """Format docx. Options: path; rows = paragraphs or documents when reading. Reads file, place, style, text of paragraphs, or file, styles, texts of documents; writes columns name, text."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return "file string, styles array<string>, texts array<string>" if self._whole() else "file string, place int, style string, text string"

    def _whole(self) -> bool:
        return self.options.get("rows") == "documents"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TextReader(self.options["path"], self._whole())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _TextWriter(self.options["path"], overwrite, schema)


def register(spark: SparkSession) -> None:
    for source in (Workbooks, TextDocuments):
        spark.dataSource.register(source)
