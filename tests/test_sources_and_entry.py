import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siftline.plans import audit, catalog, oracles
from siftline.sources import files

SMALL = "/root/testdata/sf0.001"


def test_csv_round_trip_with_provenance(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2.5), (2, None)], "a int, b double")
    files.write_csv(frame, str(tmp_path / "one"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "one"), "a int, b double").collect()) == [(1, 2.5), (2, None)]
    got = files.read_tables(spark, str(tmp_path / "*" / "*.csv"), "a int, b double").first()
    assert got.source_dir == "one" and got.source_file.endswith(".csv")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "one"), "a int, b double", required=("c",))


def test_spec_is_json(spark, tmp_path):
    files.write_spec(spark.createDataFrame([("HIC", 1)], "assay string, n int"), str(tmp_path / "spec"))
    assert spark.read.text(str(tmp_path / "spec")).first()[0] == '{"assay":"HIC","n":1}'


def test_pdb(spark, tmp_path):
    def atom(n, name, res, chain, num, x):
        return f"ATOM  {n:5d} {name:<4} {res} {chain}{num:4d}    {x:8.3f}{0:8.3f}{0:8.3f}  1.00  0.00"

    lines = [atom(1, "CA", "LYS", "H", 1, 1), atom(2, "CB", "LYS", "H", 1, 2), atom(3, "CA", "GLY", "H", 2, 3), atom(4, "N", "ASP", "L", 1, 4), atom(5, "C", "ASP", "L", 1, 6), atom(6, "CA", "ALA", "A", 1, 9), "HETATM"]
    (tmp_path / "Ab1.pdb").write_text("\n".join(lines) + "\nENDMDL\n" + atom(9, "CA", "TRP", "H", 9, 9))
    got = files.with_charge(files.read_pdb(spark, str(tmp_path / "*.pdb")), 7.4).orderBy("chain", "sequence_index").collect()
    assert [(r.structure_id, r.chain, r.sequence_index, r.aa, r.x, r.charge) for r in got] == [("ab1", "H", 0, "K", 2.0, 1.0), ("ab1", "H", 1, "G", 3.0, 0.0), ("ab1", "L", 0, "D", 5.0, -1.0)]


def test_xlsx(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sequences" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>antibody_id</t></si><si><t>x1</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>lc_protein_sequence</t></is></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    (tmp_path / "w.xlsx").write_bytes(content.getvalue())
    cells = files.read_xlsx(spark, str(tmp_path / "w.xlsx"))
    table = files.sheet(cells, "Sequences")
    assert table.columns == ["row", "antibody_id", "lc_protein_sequence"] and table.first()["antibody_id"] == "x1"
    named = files.normalise_sequences(table).first()
    assert named.antibody_name == "x1" and named.aligned_source == "raw"
    with pytest.raises(ValueError):
        files.sheet(cells, "absent")


def test_firewall():
    spec = audit.FrozenSpec("[]", "not its hash")
    with pytest.raises(ValueError):
        spec.rows()


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(catalog.QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
    assert set(oracles.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["missingness", "fold_summary", "metric_row", "contact_graph", "patch_summary", "text_condition_flags", "label_shuffle", "axis_report", "set_ops", "edge_turnover"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SMALL):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{t}'")
    frame = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    plain = lambda rows: sorted(str([round(v, 6) + 0.0 if isinstance(v, float) else v for v in r]) for r in rows)
    got = [tuple(r) for r in frame.select(*[F.col(f"`{c}`") for c in columns]).collect()]
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({oracles.ORACLES[name]})").fetchall()
    assert plain(got) == plain(want)
