"""Where results go: JSON lines and Parquet by Spark, a workbook of bounded size, a web hook."""

from __future__ import annotations

import json
import re
import sys
import urllib.request
import zipfile
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one sheet; a workbook is for people, larger results belong in Parquet.
MOST_ROWS = 100_000
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def summary(bundles: DataFrame, documents: int, read_errors: int) -> dict:
    """Counts of a run, as one small object; bundles has a row a dossier with its status."""
    by = {r["status"]: r["n"] for r in bundles.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad = sum(n for s, n in by.items() if s in ("KO_BLOQUANT", "KO", "MANQUE_DOC"))
    return {"documents": documents, "bundles": sum(by.values()), "read_errors": read_errors, "by_status": dict(sorted(by.items())), "anomalies": bad}


def tab_name(name: str, taken: set[str]) -> str:
    """A sheet name without forbidden characters, 31 characters long before a number that keeps it unique."""
    base = re.sub(r"[\\/*?:\[\]]", "_", name)[:31] or "_"
    out, n = base, 1
    while out in taken:
        n += 1
        out = f"{base[: 31 - len(f'_{n}')]}_{n}"
    taken.add(out)
    return out


def _sheet(columns: Sequence[str], rows: Iterable[Sequence]) -> str:
    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        clean = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in (columns, *rows))
    return f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'


def workbook(tabs: dict[str, DataFrame], path: str) -> None:
    """One sheet for each DataFrame. More than MOST_ROWS rows are an error, never cut."""
    taken: set[str] = set()
    sheets = []
    for name, df in tabs.items():
        rows = df.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"{name}: more than {MOST_ROWS} rows; write it as Parquet")
        sheets.append((tab_name(name, taken), _sheet(df.columns, rows)))
    ids = range(1, len(sheets) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in ids)
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in zip(ids, sheets, strict=True))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>")
        for i, (_, xml) in zip(ids, sheets, strict=True):
            z.writestr(f"xl/worksheets/sheet{i}.xml", xml)


def post(url: str, body: dict, timeout: float = 15) -> bool:
    """Sends the summary; a failure is reported and changes nothing else."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout):
            return True
    except OSError as e:
        print(f"web hook: {e}", file=sys.stderr)
        return False
