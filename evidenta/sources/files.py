"""Sources and sinks: bounded CSV and workbook scans, published tables, exports, proof log and lesson store."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenta.functions.scalars import MISSING_MARKERS, escape_cell
from evidenta.operators.evaluation import upsert
from evidenta.operators.prepare import markers_to_null, text_to_numbers

MAX_ROWS = 200_000


def read_csv(spark: SparkSession, path: str, max_rows: int | None = None, encoding: str = "UTF-8", markers: tuple[str, ...] = MISSING_MARKERS) -> DataFrame:
    """A CSV table with typed columns; missing markers become null before types are decided.

    ``max_rows`` refuses a longer file (it is a guard for interactive use, not a limit of the engine).
    """
    raw = spark.read.option("header", True).option("encoding", encoding).option("multiLine", False).csv(path)
    if max_rows is not None and raw.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return text_to_numbers(markers_to_null(raw, markers))


def read_workbook(spark: SparkSession, path: str, max_rows: int = MAX_ROWS, markers: tuple[str, ...] = MISSING_MARKERS) -> DataFrame:
    """The first sheet of an XLSX workbook, read with the standard library.

    A workbook holds at most about a million rows in one zip archive, so one task reads it; ``max_rows`` is its guard.
    """
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    rows = sheet_rows(bytes(content))
    if not rows:
        return spark.createDataFrame([], "empty string")
    header, body = rows[0], rows[1:]
    if len(body) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    width = len(header)
    names = [h if h is not None else f"column_{i + 1}" for i, h in enumerate(header)]
    schema = ", ".join(f"`{n}` string" for n in names)
    return text_to_numbers(markers_to_null(spark.createDataFrame([(r + [None] * width)[:width] for r in body], schema), markers))


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cells of the first sheet as text, row by row."""
    import io

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        strings = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si"):
                strings.append("".join(t.text or "" for t in item.iter(f"{ns}t")))
        sheet = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{ns}row"):
            cells: list[str | None] = []
            for cell in row.iter(f"{ns}c"):
                place = _column(cell.get("r", ""))
                while place is not None and len(cells) < place:
                    cells.append(None)
                value = cell.find(f"{ns}v")
                if cell.get("t") == "s" and value is not None:
                    cells.append(strings[int(value.text)])
                elif cell.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in cell.iter(f"{ns}t")))
                else:
                    cells.append(value.text if value is not None else None)
            out.append(cells)
    return out


def _column(ref: str) -> int | None:
    letters = re.match(r"[A-Z]+", ref)
    if not letters:
        return None
    n = 0
    for c in letters[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def publish(df: DataFrame, path: str) -> str:
    """An immutable Parquet table; publishing the same run again keeps what is there."""
    df.write.mode("ignore").parquet(path)
    return path


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """JSON or CSV; in CSV text that a spreadsheet would run as a formula is escaped."""
    if kind == "json":
        df.write.mode("errorifexists").json(path)
    elif kind == "csv":
        safe = df.select(*[escape_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
        safe.write.mode("errorifexists").option("header", True).csv(path)
    else:
        raise ValueError(kind)


def append_proofs(proofs: DataFrame, path: str) -> None:
    """One JSON record per line, never rewritten."""
    proofs.write.mode("append").json(path)


def read_proofs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_lessons(spark: SparkSession, path: str, lessons: DataFrame, key: str = "record_id") -> None:
    """Append the records that the store does not have; a repeated write changes nothing."""
    try:
        store = spark.read.parquet(path)
    except Exception as e:  # the store does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        store = lessons.limit(0)
    new = upsert(store.limit(0), lessons, key).join(store.select(key), key, "left_anti")
    new.write.mode("append").parquet(path)
