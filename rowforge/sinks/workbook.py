"""Workbook output as a Spark data source: every task streams the workbooks of its partition.

Input rows: ``file_name, sheet_no, sheet_name, sheet_row, text_cells, cells``, with all rows of a
workbook in one partition, sorted by file, sheet and row; the row numbers only give the order. Cells are text; those past ``text_cells``
are numbers.
"""

from __future__ import annotations

import re
import sys
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "rowforge_workbook"
SCHEMA = (
    "file_name string, sheet_no long, sheet_name string, sheet_row long, text_cells int, cells array<string>"
)

# The parts of the open workbook format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
BOOK_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"
DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
# Characters a sheet cannot hold as they are, and text that reads like their escape.
_ESCAPED = re.compile(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def cell_xml(text: str | None, number: bool = False) -> str:
    """One cell. Text is always plain text, never a formula or a link."""
    if not text:
        return "<c/>"
    if number:
        return f"<c><v>{text}</v></c>"
    safe = escape(_ESCAPED.sub(lambda m: f"_x{ord(m[0]):04X}_", text))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{safe}</t></is></c>'


class Workbook:
    """One workbook written front to back into a stream."""

    def __init__(self, stream) -> None:
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        self.names: list[str] = []
        self.sheet = None
        self.rows = 0

    def _entry(self, name: str) -> zipfile.ZipInfo:
        # A fixed date keeps repeated runs byte for byte equal.
        entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
        entry.compress_type = zipfile.ZIP_DEFLATED
        return entry

    def start_sheet(self, name: str) -> None:
        self._end_sheet()
        self.names.append(name)
        self.rows = 0
        entry = self._entry(f"xl/worksheets/sheet{len(self.names)}.xml")
        self.sheet = self.zip.open(entry, "w", force_zip64=True)
        self.sheet.write(f'{DECLARATION}<worksheet xmlns="{MAIN}"><sheetData>'.encode())

    def write_row(self, cells: str) -> None:
        self.rows += 1
        self.sheet.write(f'<row r="{self.rows}">{cells}</row>'.encode("utf-8"))

    def _end_sheet(self) -> None:
        if self.sheet is not None:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()

    def close(self) -> None:
        self._end_sheet()
        numbers = range(1, len(self.names) + 1)
        sheets = "".join(
            f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, self.names)
        )
        links = "".join(
            f'<Relationship Id="rId{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>'
            for i in numbers
        )
        types = "".join(
            f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{SHEET_TYPE}"/>' for i in numbers
        )
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>',
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" '
            f'Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" '
            'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override '
            f'PartName="/xl/workbook.xml" ContentType="{BOOK_TYPE}"/>{types}</Types>',
        }
        for name, xml in parts.items():
            self.zip.writestr(self._entry(name), DECLARATION + xml)
        self.zip.close()


@dataclass
class Written(WriterCommitMessage):
    """Temporary and final path of each workbook of a task."""

    moves: list


def file_system(path: str):
    """File system of a path, local or any the cluster's Arrow library reaches."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = re.sub("^file:/+", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        moves, book, stream, place = [], None, None, (None, None)
        try:
            for batch in iterator:
                files, sheets, names, texts = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
                for i, cells in enumerate(batch.column(5).to_pylist()):
                    if files[i] != place[0]:
                        if book:
                            book.close()
                            stream.close()
                        temporary = f"{folder}/.{uuid.uuid4().hex}.tmp"
                        moves.append((temporary, f"{folder}/{files[i]}"))
                        stream = system.open_output_stream(temporary)
                        book = Workbook(stream)
                        place = (files[i], None)
                    if sheets[i] != place[1]:
                        book.start_sheet(names[i])
                        place = (files[i], sheets[i])
                    text_cells = len(cells) if texts[i] is None else texts[i]
                    book.write_row("".join(cell_xml(c, k >= text_cells) for k, c in enumerate(cells)))
            if book:
                book.close()
                stream.close()
        except BaseException:
            _delete(system, moves)
            raise
        return Written(moves)

    def commit(self, messages: list) -> None:
        system, _ = file_system(self.path)
        for message in messages:
            for temporary, final in message.moves if message else ():
                system.move(temporary, final)

    def abort(self, messages: list) -> None:
        system, _ = file_system(self.path)
        for message in messages:
            _delete(system, message.moves if message else ())


def _delete(system, moves) -> None:
    for temporary, _ in moves:
        try:
            system.delete_file(temporary)
        except OSError:
            pass


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"])


def write_workbooks(rows: DataFrame, path: str, observed: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write workbooks from rows of the schema above, one task per workbook at most.

    ``observed`` is put to the rows of the stage that writes.
    """
    # Ship this module with the job, so that executors need no installation.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark = rows.sparkSession
    spark.dataSource.register(WorkbookSource)
    keys = ["file_name", "sheet_no", "sheet_row"]
    columns = ["file_name", "sheet_no", "sheet_name", "sheet_row", "text_cells", "cells"]
    placed = rows.select(*columns).repartition("file_name")
    placed = (observed(placed) if observed else placed).sortWithinPartitions(*keys)
    placed.write.format(FORMAT).mode("append").save(path)
