"""Readers and writers of packages, reports and tiles."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1


def read_json_package(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document, one row (S13); unreadable ones give nulls rather than an error."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def write_package(tables: dict[str, DataFrame], path: str) -> None:
    """A package as one Parquet table for each name (K1, K4, K9); the commit protocol makes each write atomic."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def gate_version(index: DataFrame, column: str = "formatVersion") -> DataFrame:
    """The index, or an error where its format version is another."""
    wrong = F.col(column).isNull() | (F.col(column) != FORMAT_VERSION)
    return index.withColumn(column, F.when(wrong, F.raise_error(F.lit("unsupported format version"))).otherwise(F.col(column)))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Validation results of a report in its restricted layout (S10, S14): ``focus, message, source_shape, component``."""
    text = spark.read.text(path, wholetext=True)
    parts = text.select(F.explode(F.slice(F.split("value", r"sh:result \["), F.lit(2), F.lit(1 << 30))).alias("r"))

    def field(name: str, pattern: str):
        return F.nullif(F.regexp_extract("r", rf"sh:{name} {pattern}", 1), F.lit(""))

    return parts.select(
        field("focusNode", "<([^>]*)>").alias("focus"),
        F.replace(F.regexp_extract("r", r'sh:resultMessage "((?:[^"\\]|\\.)*+)"', 1), F.lit('\\"'), F.lit('"')).alias("message"),
        field("sourceShape", r"([^\s;]+)").alias("source_shape"),
        field("sourceConstraintComponent", r"([^\s;]+)").alias("component"),
    )


def split_message(message) -> tuple:
    """Rule id and text of a message ``code|text``; without a bar the rule is ``shacl_violation``."""
    barred = F.contains(message, F.lit("|"))
    code = F.when(barred, F.trim(F.substring_index(message, "|", 1))).otherwise("shacl_violation")
    text = F.when(barred, F.trim(F.regexp_replace(message, r"^[^|]*\|", ""))).otherwise(F.trim(message))
    return code, text


def report_lines(results: DataFrame) -> DataFrame:
    """A canonical report as lines ordered by ``(focus, message)``: ``k, value`` (K2, K3)."""
    from plumbline.operators.relational import number_rows

    quoted = F.concat(F.lit('"'), F.replace(F.replace("message", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    numbered = number_rows(results, ["focus", "message"], "k")
    return numbered.select("k", F.concat(F.lit("[] sh:result [ a sh:ValidationResult ; sh:focusNode <"), "focus", F.lit("> ; sh:resultMessage "), quoted, F.lit(" ] .")).alias("value"))


def encode_tiles(cut: DataFrame, tile: int) -> DataFrame:
    """Tile runs as packed bits (K5, G5): ``floor, tx, ty, bits, sha256``; a tile is ``tile x tile`` cells."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((tile, tile), bool)
        tx, ty = int(pdf.tx.iloc[0]), int(pdf.ty.iloc[0])
        for gy, a, b in zip(pdf.gy, pdf.x0, pdf.x1, strict=True):
            grid[gy - ty * tile, a - tx * tile : b - tx * tile + 1] = True
        bits = zlib.compress(np.packbits(grid.ravel(), bitorder="little").tobytes(), 9)
        return pd.DataFrame({"floor": [pdf.floor.iloc[0]], "tx": [tx], "ty": [ty], "bits": [bits]})

    packed = cut.groupBy("floor", "tx", "ty").applyInPandas(pack, "floor int, tx long, ty long, bits binary")
    return packed.withColumn("sha256", F.sha2("bits", 256))


def decode_tiles(tiles: DataFrame, tile: int) -> DataFrame:
    """Runs of packed tiles, checksums verified."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                grid = np.unpackbits(np.frombuffer(zlib.decompress(r.bits), np.uint8), bitorder="little")[: tile * tile].reshape(tile, tile)
                edges = np.diff(np.pad(grid.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                for (y, x0), (_, x1) in zip(np.argwhere(edges == 1), np.argwhere(edges == -1), strict=True):
                    out.append((r.floor, r.tx, r.ty, int(y) + r.ty * tile, int(x0) + r.tx * tile, int(x1) - 1 + r.tx * tile))
            yield pd.DataFrame(out, columns=["floor", "tx", "ty", "gy", "x0", "x1"])

    good = tiles.withColumn("bits", F.when(F.sha2("bits", 256) == F.col("sha256"), F.col("bits")).otherwise(F.raise_error(F.lit("tile checksum differs")).cast("binary")))
    return good.select("floor", "tx", "ty", "bits").mapInPandas(unpack, "floor int, tx long, ty long, gy int, x0 int, x1 int")


def audit(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by type, status and reason as ``section, name, n`` (K6, A1, A4)."""
    kinds = elements.groupBy(F.col("ifc_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("type").alias("section"), "name", "n")
    status = edges.groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n")).select(F.lit("status").alias("section"), "name", "n")
    reasons = edges.select(F.explode("reasons").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("reason").alias("section"), "name", "n")
    return kinds.unionByName(status).unionByName(reasons)
