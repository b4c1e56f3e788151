"""Writing JSON, workbooks, manifests and reports."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.plans.order import bucketed_last
from quirelake.operators.bom import TABLE

_CONTENT = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{sheets}</Types>'
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_ROOT = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_BOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'
_SHEET = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>'
_STRICT = re.compile(r"^-?[\d,]+\.?\d*$")


def sheet_name(base: str, used: set[str]) -> str:
    """A free sheet name of at most 31 characters; `_2`, `_3` for repeats."""
    base = re.sub(r"[\[\]:*?/\\]", "_", re.sub(r"\s+", " ", base or "")).strip(" .'") or "데이터"
    name, n = base[:31], 1
    while name in used:
        n += 1
        tail = f"_{n}"
        name = base[: 31 - len(tail)] + tail
    used.add(name)
    return name


def column_letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def number_of(value: str) -> float | int | None:
    """Number of a cell for a workbook; leading zeros and lone marks stay text."""
    t = (value or "").strip()
    plain = t.replace(",", "")
    if not _STRICT.match(t) or re.match(r"^-?0\d", plain) or not re.search(r"\d", plain):
        return None
    return float(plain) if "." in plain else int(plain)


def _cell(r: int, c: int, value) -> str:
    ref = f"{column_letters(c)}{r}"
    n = number_of(value) if isinstance(value, str) else value
    if value is None or value == "":
        return ""
    if isinstance(n, (int, float)) and not isinstance(n, bool):
        return f'<c r="{ref}"><v>{n!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(chr(0) + "|[\x01-\x08\x0b\x0c\x0e-\x1f]", "", str(value)))}</t></is></c>'


def write_workbook(path: str, sheets: Iterable[tuple[str, list[list]]]) -> None:
    """An .xlsx file of (name, rows); no sheet gives one empty sheet."""
    used: set[str] = set()
    named = [(sheet_name(n, used), rows) for n, rows in sheets] or [("데이터", [])]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _CONTENT.format(sheets="".join(_SHEET_TYPE.format(n=i + 1) for i in range(len(named)))))
        z.writestr("_rels/.rels", _ROOT)
        z.writestr("xl/workbook.xml", _BOOK.format(sheets="".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (n, _) in enumerate(named))))
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format(rels="".join(f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(named)))))
        for i, (_, rows) in enumerate(named):
            body = "".join(f'<row r="{r}">' + "".join(_cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", _SHEET.format(rows=body))


def read_workbook(path: str, max_rows: int = 100, max_cols: int = 50) -> tuple[list[list[str]], bool]:
    """(rows, truncated) of the first sheet: a preview, so rows and columns are bounded."""
    from xml.etree import ElementTree

    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        rows = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).findall(".//m:row", ns)
    out = []
    for row in rows[:max_rows]:
        line: list[str] = []
        for c in row.findall("m:c", ns):
            col = 0
            for ch in re.match(r"[A-Z]+", c.get("r"))[0]:
                col = col * 26 + ord(ch) - 64
            line += [""] * (col - 1 - len(line))
            v = c.find("m:v", ns)
            text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else (shared[int(v.text)] if c.get("t") == "s" else v.text) if v is not None else ""
            line.append(text or "")
        out.append(line[:max_cols])
    return out, len(rows) > max_rows


def put(path: str, content: bytes) -> None:
    """Write a file of a folder on any file system that Arrow knows: a plain path, or a URI such as s3:// or hdfs://."""
    known, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    known.create_dir(place.rpartition("/")[0] or ".", recursive=True)
    with known.open_output_stream(place) as f:
        f.write(content)


def write_workbooks(annotated: DataFrame, folder: str) -> DataFrame:
    """(doc_id, path, sheets): a workbook a document from the annotated tables.

    `folder` must be shared by the executors. Each document is one task's group
    and bounded by its own tables.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc = pdf["doc_id"].iat[0]
        order = pdf.sort_values(["section_ord", "table_ord"])
        sheets = [(f"{r.role}", [list(r.headers), *[list(x) for x in r.rows]]) for r in order.itertuples()]
        path = f"{folder.rstrip('/')}/{doc}.xlsx"
        buffer = io.BytesIO()
        write_workbook(buffer, sheets)
        put(path, buffer.getvalue())
        return pd.DataFrame([(doc, path, len(sheets))], columns=["doc_id", "path", "sheets"])

    return annotated.select(*TABLE, "role", "headers", "rows").groupBy("doc_id").applyInPandas(run, "doc_id string, path string, sheets int")


def sheet_values(content: bytes, first_row: int = 2) -> int:
    """Cells of all sheets of a workbook, from row `first_row` on, that are not blank."""
    n = 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = re.findall(r"(?s)<si>(.*?)</si>", z.read("xl/sharedStrings.xml").decode()) if "xl/sharedStrings.xml" in z.namelist() else []
        for name in z.namelist():
            if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", name):
                for row, cells in re.findall(r'(?s)<row r="(\d+)"[^>]*>(.*?)</row>', z.read(name).decode()):
                    if int(row) >= first_row:
                        for attrs, body in re.findall(r"(?s)<c([^>]*)>(.*?)</c>", cells):
                            v = re.search(r"(?s)<v>(.*?)</v>", body)
                            if v and 't="s"' in attrs:
                                body = shared[int(v.group(1))]
                            n += re.sub(r"<[^>]+>", "", body).strip() != ""
    return n


def workbook_values(written: DataFrame) -> DataFrame:
    """(doc_id, path, sheet_values) of written workbooks, each read by one task."""

    def run(batches):
        for pdf in batches:
            counts = []
            for path in pdf["path"]:
                known, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with known.open_input_file(place) as f:
                    counts.append(sheet_values(f.read()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "path": pdf["path"], "sheet_values": counts})

    return written.select("doc_id", "path").mapInPandas(run, "doc_id string, path string, sheet_values long")


def section_json(sections: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, json): sections with their tables nested, in order, as one JSON text a document."""
    t = tables.groupBy("doc_id", "section_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_ord", "headers", "rows", "domain", "role"))), lambda x: x).alias("tables"))
    s = sections.join(t, ["doc_id", "section_ord"], "left")
    return s.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("section_ord", "section_id", "title", "tables")))).alias("json"))


def write_json_sig(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, path): every (doc_id, json) as its own UTF-8 file with byte-order mark."""

    def run(batches):
        for pdf in batches:
            paths = []
            for d, j in zip(pdf["doc_id"], pdf["json"]):
                paths.append(f"{folder.rstrip('/')}/{d}.json")
                put(paths[-1], j.encode("utf-8-sig"))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "path": paths})

    return docs.select("doc_id", "json").mapInPandas(run, "doc_id string, path string")


def append_manifest(entries: DataFrame, path: str) -> None:
    """Manifest entries appended to a table; readers see whole appends only."""
    entries.write.mode("append").parquet(path)


def run_summary(manifest: DataFrame) -> DataFrame:
    """(line_no, line) of a Markdown report: counts, then domains in order."""
    domains = manifest.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    totals = manifest.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality_status") == "fail").alias("bad"))
    head = totals.select(F.explode(F.array(F.struct(F.lit(0).alias("line_no"), F.lit("# Run summary").alias("line")), F.struct(F.lit(1).alias("line_no"), F.format_string("- tables: %d", "n").alias("line")), F.struct(F.lit(2).alias("line_no"), F.format_string("- verdict: %s", F.when(F.col("bad") > 0, "FAIL").otherwise("PASS")).alias("line")))).alias("x")).select("x.*")
    return head.unionByName(domains.select((F.lit(3) + F.dense_rank().over(Window.orderBy("domain")) - 1).alias("line_no"), F.format_string("- %s: %d", "domain", "n").alias("line")))


def parse_report(lines: DataFrame) -> DataFrame:
    """(heading, key, value) of `- key: value` lines under their `## heading`; the last of a key wins."""
    mark = F.when(F.col("line").startswith("## "), F.trim(F.substr("line", F.lit(4))))
    t = bucketed_last(lines.withColumn("_h", mark), [], F.floor(F.col("line_no") / 10_000), ["line_no"], "_h", "heading")
    t = t.filter(F.col("line").rlike(r"^- [^:]+:")).select("line_no", "heading", F.trim(F.regexp_extract("line", r"^- ([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^- [^:]+:(.*)$", 1)).alias("value"))
    return t.groupBy("heading", "key").agg(F.max_by("value", "line_no").alias("value"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job records of a folder of JSON files; jobs that were under way when the service
    stopped come back as failed."""
    j = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema("job_id string, status string, created_at string, preset string").json(path)
    return j.filter("job_id is not null").withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))
