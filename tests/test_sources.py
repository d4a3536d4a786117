"""Files and archives as a data source, and the table of pages by content."""

import io
import zipfile

import pytest

from docrecon.sinks import report
from docrecon.sources import customs, files

#: A reader for the tests: pages are parted by form feeds; it leaves a mark for each call in the file that the content names first.
PAPER = """
def pages(content):
    mark, _, rest = content.decode().partition("\\n")
    with open(mark, "a", encoding="utf-8") as f:
        f.write("x")
    if "broken" in rest:
        raise ValueError("broken paper")
    return rest.split("\\f")
"""
READER = "paper_reader:pages"


@pytest.fixture(scope="module", autouse=True)
def reader(spark, tmp_path_factory):
    file = tmp_path_factory.mktemp("reader") / "paper_reader.py"
    file.write_text(PAPER)
    spark.sparkContext.addPyFile(str(file))


def archive(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture()
def root(tmp_path):
    mark = f"{tmp_path}/calls\n".encode()
    inner = archive({"deep/c.pdf": mark + b"three", "bad.zip": b"no archive", "note.txt": b"no"})
    outer = archive({"D2/b.pdf": mark + b"two\ftwo again", "../up/e.pdf": mark + b"up", "__MACOSX/._b.pdf": b"", "more.zip": inner, "D2/x_HWB_1.pdf": mark, "D2/copy.pdf": mark + b"one"})
    (tmp_path / "in/D1").mkdir(parents=True)
    (tmp_path / "in/D1/a.pdf").write_bytes(mark + b"one")
    (tmp_path / "in/D1/broken.pdf").write_bytes(mark + b"broken")
    (tmp_path / "in/D1/a_AWB_1.pdf").write_bytes(mark + b"transport copy")
    (tmp_path / "in/box.zip").write_bytes(outer)
    return tmp_path


def calls(root) -> int:
    return len((root / "calls").read_text()) if (root / "calls").exists() else 0


def shown(pages, root):
    return sorted((r["path"].removeprefix(f"{root}/in/"), r["page_no"] or 0, r["text"] or r["error"].split(":")[0]) for r in pages.collect())


WANT = [
    ("D1/a.pdf", 1, "one"),
    ("D1/broken.pdf", 0, "ValueError"),
    ("box/D2/b.pdf", 1, "two"),
    ("box/D2/b.pdf", 2, "two again"),
    ("box/D2/copy.pdf", 1, "one"),
    ("box/more/bad", 0, "BadZipFile"),
    ("box/more/deep/c.pdf", 1, "three"),
    ("box/up/e.pdf", 1, "up"),
]


def test_folders_and_archives(spark, root, monkeypatch):
    assert shown(customs.read(spark, f"{root}/in", pdf_reader=READER), root) == WANT
    # partitions are cut by bytes
    reader = customs._Reader({"path": f"{root}/in"})
    assert len(reader.partitions()) == 1
    monkeypatch.setattr(customs, "PARTITION_BYTES", 1)
    assert [len(p.entries) for p in reader.partitions()] == [1, 1, 1]
    # one file, even a transport copy; one archive; a folder with nothing
    single = customs.read(spark, f"{root}/in/D1/a_AWB_1.pdf", pdf_reader=READER).collect()
    assert [r["text"] for r in single] == ["transport copy"]
    assert customs.read(spark, f"{root}/in/box.zip", pdf_reader=READER).count() == 6
    (root / "none").mkdir()
    assert customs.read(spark, f"{root}/none").count() == 0
    assert customs.read(spark, f"{root}/in", "files").filter("archive is not null").count() == 5


def test_a_second_run_parses_nothing_twice(spark, root):
    table = f"{root}/table"
    pages, parsed = customs.read_with_table(spark, f"{root}/in", table, pdf_reader=READER)
    assert shown(pages, root) == WANT and parsed == 5 and calls(root) == 5  # two files have one content
    pages, parsed = customs.read_with_table(spark, f"{root}/in", table, pdf_reader=READER)
    assert parsed == 1 and calls(root) == 6  # only the one that could not be read
    assert shown(pages, root) == WANT
    (root / "in/D1/new.pdf").write_bytes(f"{root}/calls\nnew".encode())
    (root / "in/D1/same.pdf").write_bytes(f"{root}/calls\nnew".encode())
    pages, parsed = customs.read_with_table(spark, f"{root}/in", table, pdf_reader=READER)
    assert parsed == 2 and calls(root) == 8
    assert shown(pages, root) == sorted([*WANT, ("D1/new.pdf", 1, "new"), ("D1/same.pdf", 1, "new")])
    # another version of the reader starts afresh
    assert customs.read_with_table(spark, f"{root}/in", table, "2", READER)[1] == 6


def test_sheets_by_their_relationship(spark, tmp_path):
    book = str(tmp_path / "b.xlsx")
    report.workbook({n: spark.createDataFrame([(n,)], "v string") for n in ("first", "second")}, book)
    with zipfile.ZipFile(book) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    assert [s.split("\n")[0] for s in files.sheets(open(book, "rb").read())] == ["[SHEET:first]", "[SHEET:second]"]
    rels = parts["xl/_rels/workbook.xml.rels"]
    swapped = rels.replace(b"sheet1.xml", b"sheetX.xml").replace(b"sheet2.xml", b"sheet1.xml").replace(b"sheetX.xml", b"sheet2.xml")
    texts = list(files.sheets(archive(parts | {"xl/_rels/workbook.xml.rels": swapped})))
    assert texts[0].startswith("[SHEET:first]") and "second" in texts[0] and "second" not in texts[1].split("\n")[1:]
    del parts["xl/worksheets/sheet2.xml"]
    with pytest.raises(ValueError, match="second has no part"):
        list(files.sheets(archive(parts)))


def test_dossiers_as_a_stream(spark, tmp_path):
    """Arrivals in files, late ones within the watermark too; a window goes out once the watermark has passed it."""
    from pyspark.sql import functions as F

    from docrecon.streaming import ingest

    schema = "ts timestamp, dossier string, kind string"
    batches = [
        [("2025-01-01 10:05:00", "A", "invoice"), ("2025-01-01 10:10:00", "B", "invoice")],
        [("2025-01-01 11:01:00", "A", "invoice"), ("2025-01-01 10:55:00", "A", "declaration")],  # late, but within ten minutes of the latest
        [("2025-01-01 12:30:00", "A", "declaration")],
        [("2025-01-01 10:30:00", "B", "declaration")],  # too late
    ]
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "ts string, dossier string, kind string").withColumn("ts", F.to_timestamp("ts"))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.completeness(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120), n
    got = {(str(r["start"])[11:13], r["dossier"]): (r["invoices"], r["declarations"], r["complete"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("10", "A"): (1, 1, True), ("10", "B"): (1, 0, False), ("11", "A"): (1, 0, False)}
