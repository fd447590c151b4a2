"""Readers and sinks of records in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of {"metadata": …, "instituciones": […]}; a byte order mark is skipped by the JSON reader."""
    whole = spark.read.schema(f"instituciones array<struct<{schema}>>").option("multiLine", True).json(path)
    return whole.select(F.inline("instituciones"))


def events(spark: SparkSession, path: str, schema: str, lines: bool | None = None) -> DataFrame:
    """Flat records (schema: "name:type, ...") as JSON lines, a JSON list, or an object that holds them under records, results or events.

    lines: None looks at the first character: a list or an object that spans lines is read as one document.
    """
    if lines is None:
        first = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("v")).first()
        lines = bool(first) and first["v"].startswith("{") and first["v"].endswith("}") and not any(f'"{k}"' in first["v"][:40] for k in ("records", "results", "events"))
    if lines:
        return spark.read.schema(_ddl(schema)).json(path)
    parts = ", ".join(f"{k} array<struct<{schema}>>" for k in ("records", "results", "events"))
    listed = spark.read.schema(f"{parts}, {_ddl(schema)}").option("multiLine", True).json(path)
    held = F.coalesce("records", "results", "events")
    names = [c.split(":")[0].strip() for c in schema.split(",")]
    return listed.select(F.when(held.isNotNull(), held).otherwise(F.array(F.struct(*names))).alias("r")).select(F.inline("r"))


def _ddl(schema: str) -> str:
    return ", ".join(c.strip().replace(":", " ", 1) for c in schema.split(","))


def append(rows: DataFrame, path: str) -> None:
    """Append-only event sink."""
    rows.write.mode("append").parquet(path)


def append_each(tables: dict[str, tuple[DataFrame, str]]) -> dict[str, str | None]:
    """Appends each table to its path; one that fails leaves the others alone. Name to error, null where it went well."""
    said: dict[str, str | None] = {}
    for name, (rows, path) in tables.items():
        try:
            append(rows, path)
            said[name] = None
        except Exception as e:  # the report says which; the caller decides
            said[name] = f"{type(e).__name__}: {e}"[:500]
    return said


def last_success(runs: DataFrame) -> DataFrame:
    """(institucion_id, evaluated_at) of the newest run that extracted."""
    return runs.where("decision = 'extract'").groupBy("institucion_id").agg(F.max("evaluated_at").alias("evaluated_at"))


def _sheet(raw: bytes, sheet: str | None) -> list[list[str]]:
    """The cells of a sheet of an ODS or XLSX file as text, row by row; a repeated cell stands for its copies."""
    import io
    import re
    import xml.etree.ElementTree as ET
    import zipfile

    local = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if "content.xml" in z.namelist():
            tables = [e for e in ET.fromstring(z.read("content.xml")).iter() if local(e) == "table"]
            attr = lambda e, n: next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == n), None)
            table = next((t for t in tables if sheet is None or attr(t, "name") == sheet), None)
            if table is None:
                raise ValueError(f"no sheet {sheet!r}")
            rows = []
            for row in (e for e in table if local(e) == "table-row"):
                cells = [e for e in row if local(e) == "table-cell"]
                texts = [(" ".join("".join(p.itertext()).strip() for p in c.iter() if local(p) == "p").strip(), int(attr(c, "number-columns-repeated") or 1)) for c in cells]
                while texts and not texts[-1][0]:
                    texts.pop()
                rows.append([t for t, n in texts for _ in range(n)])
            return rows
        names = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(e.itertext()) for e in ET.fromstring(z.read("xl/sharedStrings.xml")) if local(e) == "si"]
        rows = []
        for row in (e for e in ET.fromstring(z.read(names[0])).iter() if local(e) == "row"):
            cells: dict[int, str] = {}
            for c in row:
                at = 0
                for ch in re.match("[A-Z]*", c.get("r", "")).group():
                    at = at * 26 + ord(ch) - 64
                text = "".join("".join(v.itertext()) for v in c if local(v) in ("v", "is"))
                cells[at or len(cells) + 1] = shared[int(text)] if c.get("t") == "s" and text else text
            while len(rows) + 1 < int(row.get("r", len(rows) + 1)):
                rows.append([])
            rows.append([cells.get(i, "") for i in range(1, max(cells, default=0) + 1)])
        return rows


def spreadsheet(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None, header: int = 1, rename: dict[str, str] | None = None) -> DataFrame:
    """Rows of ODS or XLSX files (all matched by path, one file a task) as text columns, by the names in the header row;
    rows that are all empty are left out, missing cells are empty, `rename` maps header names."""
    import pyarrow as pa

    def read(batches):
        for b in batches:
            for raw in b.column(0):
                rows = _sheet(raw.as_buffer().to_pybytes(), sheet)
                if len(rows) < header:
                    continue
                names = [(rename or {}).get(h.strip(), h.strip()) for h in rows[header - 1]]
                held = [dict(zip(names, r)) for r in rows[header:] if any(r)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c, "") for r in held], pa.string()) for c in columns], columns)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, ", ".join(f"`{c}` string" for c in columns))


def run_log(reports: DataFrame) -> DataFrame:
    """One row per run: totals and the details as JSON."""
    detail = F.to_json(F.array_sort(F.collect_list(F.struct("institucion", "nuevas", "errores"))))
    return reports.groupBy("run_id").agg(F.count("*").alias("instituciones"), F.sum("nuevas").alias("nuevas"), F.sum("errores").alias("errores"), detail.alias("detalle"))
