"""Scans and sinks: CSV with declared schemas, globbed tables with provenance, Parquet, frozen JSON, PDB and xlsx.

Everything is read by Spark's own readers, so any file system Spark knows will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.conditions import residue_charge
from siftline.tables import nan_to_null, require_columns

PDB_RECORD = (("record", 1, 6), ("atom", 13, 4), ("altloc", 17, 1), ("resname", 18, 3), ("chain", 22, 1), ("number", 23, 4), ("icode", 27, 1), ("x", 31, 8), ("y", 39, 8), ("z", 47, 8))
# Three-letter to one-letter residue names.
RESIDUES = {
    "ALA": "A",
    "ARG": "R",
    "ASN": "N",
    "ASP": "D",
    "CYS": "C",
    "GLN": "Q",
    "GLU": "E",
    "GLY": "G",
    "HIS": "H",
    "ILE": "I",
    "LEU": "L",
    "LYS": "K",
    "MET": "M",
    "PHE": "F",
    "PRO": "P",
    "SER": "S",
    "THR": "T",
    "TRP": "W",
    "TYR": "Y",
    "VAL": "V",
}


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    reader = spark.read.option("header", True).option("nanValue", "NaN").option("multiLine", True).option("escape", '"')
    frame = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return nan_to_null(require_columns(frame, *required))


def read_tables(spark: SparkSession, glob: str, schema: str | None = None) -> DataFrame:
    """All CSVs of a glob in one table with source_file, source_stem and source_dir; raises where there is none."""
    frame = read_csv(spark, glob, schema)
    path = F.col("_metadata.file_path")
    parts = F.split(path, "/")
    return frame.select("*", F.col("_metadata.file_name").alias("source_file"), F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("source_stem"), F.element_at(parts, -2).alias("source_dir"))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(*paths))


def write_csv(frame: DataFrame, path: str) -> None:
    """One file, quotes doubled as ``read_csv`` takes them: for report tables, which are small."""
    frame.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(frame: DataFrame, path: str, *partitions: str) -> None:
    frame.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_spec(frame: DataFrame, path: str) -> None:
    """Freezes a specification table as JSON lines."""
    frame.select(F.to_json(F.struct(*frame.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_pdb(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """Residues of the heavy and light chain of each PDB file: structure_id, chain, sequence_index, resname, aa, x, y, z.

    Coordinates are those of CB, else CA, else the mean atom. Only the first model and standard residues count. A structure is
    called like its file, or by ``name``, an expression over ``_metadata``.
    """
    own = F.regexp_replace(F.lower("_metadata.file_name"), r"\.pdb$", "") if name is None else name
    lines = spark.read.text(path, wholetext=True).select(own.alias("structure_id"), F.split(F.element_at(F.split("value", "\nENDMDL"), 1), "\n").alias("lines"))
    atoms = lines.select("structure_id", F.explode("lines").alias("line")).filter(F.col("line").startswith("ATOM"))
    fields = atoms.select("structure_id", *[F.trim(F.substring("line", b, n)).alias(c) for c, b, n in PDB_RECORD])
    names = F.create_map(*[F.lit(v) for pair in RESIDUES.items() for v in pair])
    kept = fields.filter(F.col("chain").isin("H", "L") & F.col("altloc").isin("", "A")).withColumn("aa", names[F.col("resname")]).filter("aa is not null")
    key = ["structure_id", "chain", F.col("number").cast("int").alias("number"), "icode"]

    def place(c: str):
        v = F.col(c).cast("double")
        return F.coalesce(F.max(F.when(F.col("atom") == "CB", v)), F.max(F.when(F.col("atom") == "CA", v)), F.avg(v)).alias(c)

    residues = kept.groupBy(*key).agg(F.first("resname").alias("resname"), F.first("aa").alias("aa"), place("x"), place("y"), place("z"))
    order = Window.partitionBy("structure_id", "chain").orderBy("number", "icode")
    return residues.withColumn("sequence_index", F.row_number().over(order) - 1).drop("number", "icode")


def with_charge(residues: DataFrame, ph: float) -> DataFrame:
    return residues.withColumn("charge", residue_charge(F.col("resname"), F.lit(ph)))


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every sheet of each workbook, long: file, sheet, row, column (both from 1), value.

    Workbooks are read whole by the executors as bytes; what a workbook holds is bounded by the format.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = list(sheet_cells(bytes(content)))
                yield pd.DataFrame([(name, *r) for r in rows], columns=["file", "sheet", "row", "column", "value"])

    return files.mapInPandas(cells, "file string, sheet string, row int, column int, value string")


def sheet_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of the filled cells of an xlsx file."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns):
            target = targets[sheet.get(rel)].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for c in root.iter(f"{{{ns['m']}}}c"):
                letters, number = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                column = 0
                for letter in letters:
                    column = column * 26 + ord(letter) - 64
                value = c.find("m:v", ns)
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                elif value is None:
                    continue
                else:
                    text = shared[int(value.text)] if c.get("t") == "s" else value.text
                yield sheet.get("name"), int(number), column, text


def sheet(cells: DataFrame, name: str) -> DataFrame:
    """A sheet as a wide table: its first row names the columns. The header is what reaches the driver."""
    own = cells.filter(F.col("sheet") == name)
    header = own.filter("row = 1").orderBy("column").collect()
    if not header:
        raise ValueError(f"no sheet {name}")
    wide = own.filter("row > 1").groupBy("file", "row").agg(*[F.max(F.when(F.col("column") == h.column, F.col("value"))).alias(h.value) for h in header])
    return wide.select("row", *[F.col(f"`{h.value}`") for h in header])


def normalise_sequences(frame: DataFrame, *keep: str) -> DataFrame:
    """antibody_name, vh_, vl_protein_sequence, heavy_ and light_aligned_aho with the fallbacks of older layouts, after ``keep``.

    ``aligned_source`` says whether the alignment was there or raw sequences stand in for it.
    """
    have = set(frame.columns)

    def pick(*names: str, default=None):
        return next((F.col(n) for n in names if n in have), F.lit(default))

    vh, vl = pick("vh_protein_sequence", "protein_sequence"), pick("vl_protein_sequence", "lc_protein_sequence", default="")
    aligned = {"heavy_aligned_aho", "light_aligned_aho"} <= have
    return frame.select(
        *keep, pick("antibody_name", "antibody_id").cast("string").alias("antibody_name"), vh.alias("vh_protein_sequence"), vl.alias("vl_protein_sequence"),
        (F.col("heavy_aligned_aho") if aligned else vh).alias("heavy_aligned_aho"), (F.col("light_aligned_aho") if aligned else vl).alias("light_aligned_aho"),
        F.lit("aligned" if aligned else "raw").alias("aligned_source"),
    )
