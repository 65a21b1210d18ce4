"""Slices of stored sequences, matrix files and sheets of workbooks."""

import random
import re
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint, scratch, shared_folder
from weft.sources import matrices, sheets, slices

X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_slices_equal_those_of_the_whole(spark, tmp_path):
    rng = random.Random(3)
    whole = {"a": "".join(rng.choice("ACGT") for _ in range(5000)), "b": "é" * 130, "c": "", "d": "".join(rng.choice("ACGTN") for _ in range(20_000))}
    path = str(tmp_path / "store")
    slices.write_store(spark.createDataFrame(list(whole.items()), "record_id string, sequence string"), path, chunk=64, parts=8)
    asked = [(rng.choice("abcde"), a := rng.randint(-5, 20_100), a + rng.randint(-3, 400)) for _ in range(200)] + [("a", 0, 5000), ("a", 0, 10**9), ("d", 64, 128), ("d", 64, 128), (None, 0, 5), ("a", None, 4)]
    got = slices.fetch(spark, path, spark.createDataFrame(asked, "record_id string, start long, end long").repartition(4))
    want = [(*q, whole.get(q[0], "")[max(q[1], 0) : max(q[2], 0)] if None not in q else "") for q in asked]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_only_touched_folders_are_read(spark, tmp_path):
    text = "".join(random.Random(1).choice("ACGT") for _ in range(4 * slices.SPAN * 16))
    path = tmp_path / "store"
    slices.write_store(spark.createDataFrame([("r", text)], "record_id string, sequence string"), str(path), chunk=4, parts=64)
    one = spark.createDataFrame([("r", 10, 30)], "record_id string, start long, end long")
    first = slices.fetch(spark, str(path), one)
    assert first.first().sequence == text[10:30]
    filters = re.findall(r"PartitionFilters: \[[^\]]*\(part#\d+ = (\d+)\)", first._jdf.queryExecution().toString())
    sizes = {int(f.parent.name.split("=")[1]): f.stat().st_size for f in path.glob("part=*/*.parquet")}
    assert len(sizes) > 8 and len(set(filters)) == 1 and sizes[int(filters[0])] < sum(sizes.values()) / 4


def workbook(path, rows, shared=("name", "note <1>", "x")):
    cells = "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {X} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Other" sheetId="1" r:id="r1"/><sheet name="Data" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {X}>" + "".join(f"<si><t>{s.replace('<', '&lt;')}</t></si>" for s in shared) + "<si><r><t>two</t></r><r><t> runs</t></r><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {X}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {X}><sheetData>{cells}</sheetData></worksheet>")


ROWS = [
    (1, ['<c r="A1" t="inlineStr"><is><t>A title</t></is></c>']),
    (3, ['<c r="A3" t="s"><v>0</v></c>', '<c r="C3" t="inlineStr"><is><t> score </t></is></c>', '<c r="AB3" t="s"><v>2</v></c>']),
    (4, ['<c r="A4" t="s"><v>1</v></c>', '<c r="C4"><v>1.5</v></c>', '<c r="AB4" t="b"><v>1</v></c>']),
    (5, ['<c r="B5"><v>9</v></c>']),
    (7, ['<c t="s"><v>3</v></c>', "<c/>", '<c t="str"><v>=sum</v></c>']),
    (8, []),
]


def test_sheets(spark, tmp_path):
    workbook(tmp_path / "one.xlsx", ROWS)
    workbook(tmp_path / "two.xlsx", ROWS[:3])
    got = sheets.sheet(spark, f"{tmp_path}/*.xlsx", "Data", ["score", "name", "x"], header_row=3)
    rows = sorted((Path(r.path).name, r.row, r.score, r.name, r.x) for r in got.collect())
    assert rows == [("one.xlsx", 4, "1.5", "note <1>", "TRUE"), ("one.xlsx", 5, None, None, None), ("one.xlsx", 7, "=sum", "two runs", None), ("two.xlsx", 4, "1.5", "note <1>", "TRUE")]
    assert sheets.sheet(spark, f"{tmp_path}/two.xlsx", "Data", ["name"], header_row=4 - 1).count() == 1


@pytest.mark.parametrize(("name", "columns", "header"), [("Data", ["absent"], 3), ("Nowhere", ["name"], 3), ("Data", ["name"], 2)])
def test_sheets_that_lack_what_is_asked(spark, tmp_path, name, columns, header):
    workbook(tmp_path / "one.xlsx", ROWS)
    with pytest.raises(Exception, match="not once in the header|no sheet|is empty"):
        sheets.sheet(spark, f"{tmp_path}/one.xlsx", name, columns, header).collect()


def test_matrix_files_are_read_by_rows(spark, tmp_path):
    m = np.arange(600, dtype="<f4").reshape(200, 3)
    path = str(tmp_path / "m.npy")
    np.save(path, m)
    whole = {r.row: r.vector for r in matrices.read_matrix(spark, path).collect()}
    assert len(whole) == 200 and all(whole[i] == m[i].tolist() for i in range(200))
    asked = spark.createDataFrame([(5,), (6,), (199,), (5,), (200,), (-1,), (None,)], "row long")
    assert sorted(map(tuple, matrices.read_matrix(spark, "file:" + path, asked).collect())) == [(i, m[i].tolist()) for i in (5, 6, 199)]
    for shape in ((0, 3), (2, 0)):
        np.save(path, np.zeros(shape, "<i8"))
        assert [r.vector for r in matrices.read_matrix(spark, path).collect()] == [[]] * shape[0]
    for bad in (np.zeros(3), np.asfortranarray(np.zeros((2, 3))), np.zeros((2, 2), "<U3")):
        np.save(path, bad)
        with pytest.raises(ValueError, match="not a matrix"):
            matrices.read_matrix(spark, path)


def test_matrix_files_are_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matrices, "FILE_ROWS", 40)
    df = spark.range(300).select(F.col("id").alias("k"), F.array(F.col("id") * 2.0, F.lit(1.0)).alias("v"))
    path = str(tmp_path / "saved")
    matrices.write_matrix(df, path, "k", "v")
    ids = {(r.file, r.row): r.k for r in spark.read.parquet(f"{path}/ids").collect()}
    assert {k: v.tolist() for f in {f for f, _ in ids} for i, v in enumerate(np.load(f"{path}/data/{f}")) for k in [ids[f, i]]} == {k: [2.0 * k, 1.0] for k in range(300)}
    files = {r.file: r.rows for r in spark.read.json(f"{path}/manifest").collect()}
    assert sum(files.values()) == 300 and max(files.values()) <= 40
    assert sorted((r.k, r.vector) for r in matrices.read_saved(spark, path, "k").collect()) == [(k, [2.0 * k, 1.0]) for k in range(300)]
    some = spark.createDataFrame([(7,), (299,), (7,), (900,)], "k long")
    assert sorted((r.k, r.vector) for r in matrices.read_saved(spark, path, "k", some).collect()) == [(7, [14.0, 1.0]), (299, [598.0, 1.0])]
    with pytest.raises(Exception, match="differ in width"):
        matrices.write_matrix(df.withColumn("v", F.when(F.col("k") == 5, F.array(F.lit(0.5))).otherwise(F.col("v"))), str(tmp_path / "bad"), "k", "v")
    matrices.write_matrix(df.limit(0), str(tmp_path / "none"), "k", "v")
    assert matrices.read_saved(spark, str(tmp_path / "none"), "k").count() == 0


def test_scratch_is_deleted(spark):
    with scratch(spark) as folder:
        assert shared_folder(spark) == folder
        kept = checkpoint(spark.range(10))
        spark.range(3).write.parquet(f"{folder}/table")
        assert kept.count() == 10 and len(list(Path(folder).iterdir())) >= 2
        with scratch(spark) as inner:
            assert inner.startswith(folder) and checkpoint(spark.range(4)).count() == 4
        assert not Path(inner).exists() and kept.count() == 10
    assert not Path(folder).exists() and shared_folder(spark) != folder
    with pytest.raises(RuntimeError), scratch(spark) as broken:
        checkpoint(spark.range(1))
        raise RuntimeError
    assert not Path(broken).exists() and checkpoint(spark.range(5)).count() == 5
