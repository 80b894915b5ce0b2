import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rejoinder.operators import reports
from rejoinder.sources import readers, xlsx


def test_cells_of_every_kind():
    sheet = (
        '<worksheet xmlns="m"><sheetData><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>3.5000000000000004</v></c><c r="AB2" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>'
        '<row><c t="b"><v>1</v></c><c/><c t="str"><v>f &amp; g</v></c><c><v>4</v></c><c t="e"><v>#N/A</v></c></row></sheetData></worksheet>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="q"><sheets><sheet name="x" r:id="r9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r9" Target="/xl/s/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/s/one.xml", sheet)
    assert list(xlsx.sheet_rows(out.getvalue())) == [(2, {0: "one", 2: "3.5", 27: "ab"}), (3, {0: "TRUE", 2: "f & g", 3: "4", 4: "#N/A"})]


def test_forms_of_both_kinds_are_one(spark, tmp_path):
    rows = [("bl_1", "GD", "3.5", None, "9", "x", "Punative", " high", "?", 'a, "b"\nc'), ("mn_2", "GD", " 4 ", "nan", "2", "None", "", "LOW", "?", "é<&>")]
    names = [c.split()[0] for c in readers.FORM.split(", ")]
    df = spark.createDataFrame(rows, readers.FORM)
    assert xlsx.write_workbooks(df.toDF(*[f" {n.upper()}" for n in names]).coalesce(1), f"file://{tmp_path}/f.xlsx") == 1
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(str(tmp_path / "f"))
    both = [sorted(map(str, readers.rating_form(spark, str(tmp_path / p), "r").collect())) for p in ("f.xlsx", "f")]
    assert both[0] == both[1] and len(both[0]) == 2
    assert xlsx.write_workbooks(df.repartition(2, "record_id"), f"file://{tmp_path}/g.xlsx", most=1) == 2
    assert readers.rating_form(spark, str(tmp_path / "g.xlsx"), "r").count() == 2
    part = xlsx.workbook_table(spark, str(tmp_path / "f.xlsx"), ["notes", "missing"]).orderBy("row").collect()
    assert [(r.notes, r.missing) for r in part] == [('a, "b"\nc', None), ("é<&>", None)]


def test_densities_are_those_of_all_values(spark):
    r = np.random.default_rng(0)
    values = {"a": np.round(r.normal(3, 1, 300), 1), "b": np.array([2.0, 2.0, 4.5]), "one": np.array([1.5, 1.5]), "single": np.array([7.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    got = {(x.g, x.k): x for x in reports.densities(df, "g", "v", 20).collect()}
    assert len(got) == 80
    for g, vs in values.items():
        for k, x in enumerate(np.linspace(vs.min(), vs.max(), 20)):
            have = got[g, k]
            assert have.x == pytest.approx(x)
            if vs.min() == vs.max():
                assert have.density == 1.0
                continue
            h = vs.std(ddof=1) * len(vs) ** -0.2
            assert have.density == pytest.approx((np.exp(-((x - vs) ** 2) / (2 * h * h)) / (h * np.sqrt(2 * np.pi))).mean())
    assert reports.densities(df.filter(F.lit(False)), "g", "v").count() == 0
