"""What a customs file is: its kinds, the context of its path, and the sheets of a workbook from its XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"pdf": "pdf", "xlsx": "excel", "xlsm": "excel", "xls": "excel"}
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def path_context(path: Column, root: str) -> Column:
    """A struct (dossier, folder) from the directories below the root."""
    parts = F.split(F.regexp_replace(path, rf"^(?:file:)?{re.escape(root.rstrip('/'))}/", ""), "/")
    n = F.size(parts)
    own = re.fullmatch(r"[A-Za-z]{2,4}\d{5,}", root.rstrip("/").rpartition("/")[2])
    if own:
        return F.struct(F.lit(own.string).alias("dossier"), F.when(n > 1, parts[0]).alias("folder"))
    return F.struct(F.when(n > 1, parts[0]).alias("dossier"), F.when(n > 2, parts[1]).alias("folder"))


def _sheet_files(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet in the workbook's order, by its relationship; one whose part is missing is an error, not left out."""
    targets = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target") or ""
            targets[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    out = []
    for n, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"), 1):
        file = targets.get(s.get(_RELATION), f"xl/worksheets/sheet{n}.xml")
        if file not in z.namelist():
            raise ValueError(f"sheet {s.get('name')} has no part {file}")
        out.append((s.get("name"), file))
    return out


def sheets(content: bytes) -> Iterator[str]:
    """Each sheet of a workbook as text: rows of tab-joined cached values, without blank rows, under a header line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        for name, file in _sheet_files(z):
            rows = []
            for row in ElementTree.fromstring(z.read(file)).iter(f"{_NS}row"):
                cells: dict[int, str] = {}
                for i, c in enumerate(row.iter(f"{_NS}c")):
                    ref = re.match(r"[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(ref[0]))) - 1 if ref else i
                    v = c.find(f"{_NS}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else "" if v is None else v.text or ""
                    cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
                line = "\t".join(cells.get(k, "") for k in range(max(cells, default=-1) + 1)).rstrip()
                if line.strip():
                    rows.append(line)
            yield "\n".join([f"[SHEET:{name}]", *rows])
