"""Instrument and annotation formats: GeoJSON regions, image transforms, mzML and imzML spectra."""

from __future__ import annotations

import base64
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import ship_package

# Controlled-vocabulary accessions: fixed values.
MS_LEVEL, TIME, ZLIB, FLOAT64, FLOAT32 = "MS:1000511", "MS:1000016", "MS:1000574", "MS:1000523", "MS:1000521"
MZ_ARRAY, INTENSITY_ARRAY, SELECTED_ION, ISOLATION_TARGET = "MS:1000514", "MS:1000515", "MS:1000744", "MS:1000827"
ISOLATION_LOWER, ISOLATION_UPPER, COLLISION_ENERGY, BASE_PEAK = "MS:1000828", "MS:1000829", "MS:1000045", "MS:1000505"
POSITION_X, POSITION_Y, EXTERNAL_OFFSET, EXTERNAL_LENGTH = "IMS:1000050", "IMS:1000051", "IMS:1000102", "IMS:1000103"


# --- GeoJSON ----------------------------------------------------------------------------------------


def geojson_vertices(text: str, section_id: str | None = None) -> list[tuple]:
    """Vertex rows of a FeatureCollection, a Feature or a list of Features; polygons only."""
    root = json.loads(text)
    features = root if isinstance(root, list) else root.get("features", [root])
    rows, used = [], {}
    for feature in features:
        geometry, props = feature.get("geometry") or {}, feature.get("properties") or {}
        kind = geometry.get("type")
        if kind not in ("Polygon", "MultiPolygon"):
            raise ValueError(f"geometry {kind!r} isn't a polygon")
        name = props.get("name") or feature.get("id") or (props.get("classification") or {}).get("name") or "roi"
        used[name] = used.get(name, 0) + 1
        roi = name if used[name] == 1 else f"{name}_{used[name]}"
        parts = [geometry["coordinates"]] if kind == "Polygon" else geometry["coordinates"]
        for p, rings in enumerate(parts, 1):
            for r, ring in enumerate(rings, 1):
                points = [(float(x), float(y)) for x, y, *_ in ring]
                if points and points[0] != points[-1]:
                    points.append(points[0])
                if len(points) < 4 or len(set(points)) < 3:
                    raise ValueError(f"a ring of {roi!r} has too few vertices")
                rows += [(str(roi), section_id, p, r, "outer" if r == 1 else "hole", v, x, y, "full_resolution_pixel") for v, (x, y) in enumerate(points, 1)]
    return rows


VERTICES = "roi_id string, section_id string, polygon_part_id int, ring_id int, ring_role string, vertex_order int, x double, y double, coordinate_unit string"


def import_geojson(spark: SparkSession, path: str, section_id: str | None = None) -> DataFrame:
    """Vertex table of GeoJSON files, parsed where they are read (a file is one document)."""
    ship_package(spark)

    def parse(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows = [r for content in pdf.content for r in geojson_vertices(bytes(content).decode(), section_id)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in VERTICES.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, VERTICES)


def read_image_transform(spark: SparkSession, path: str) -> list[list[float]]:
    """The finite 3 x 3 matrix of a dataset's JSON."""
    root = json.loads(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
    matrix = ((root.get("data") or {}).get("rawOpticalImage") or {}).get("transform") or root.get("transform")
    if not (isinstance(matrix, list) and len(matrix) == 3 and all(len(r) == 3 and np.isfinite(r).all() for r in matrix)):
        raise ValueError("no finite 3 x 3 transform")
    return [[float(v) for v in r] for r in matrix]


# --- mzML -------------------------------------------------------------------------------------------


def decode_array(text: str, compressed: bool, double: bool) -> np.ndarray:
    raw = base64.b64decode(text or "")
    return np.frombuffer(zlib.decompress(raw) if compressed and raw else raw, "<f8" if double else "<f4").astype(float)


def _value(block: str, accession: str) -> float | None:
    m = re.search(rf'accession="{accession}"[^>]*?value="([^"]*)"', block)
    return float(m[1]) if m and m[1] else None


def parse_spectrum(block: str) -> dict:
    """Scan metadata and both arrays of one <spectrum> element."""
    arrays = {}
    for part in re.findall(r"<binaryDataArray\b.*?</binaryDataArray>", block, re.S):
        text = re.search(r"<binary>(.*?)</binary>", part, re.S)
        data = decode_array(text[1] if text else "", ZLIB in part, FLOAT64 in part)
        arrays["mz" if MZ_ARRAY in part else "intensity"] = data
    n = min(len(arrays.get("mz", ())), len(arrays.get("intensity", ())))
    scan = re.search(r"scan=(\d+)", block) or re.search(r'index="(\d+)"', block)
    names = {"ms_level": MS_LEVEL, "retention_time": TIME, "precursor_mz": SELECTED_ION, "isolation_target_mz": ISOLATION_TARGET, "isolation_lower_offset": ISOLATION_LOWER, "isolation_upper_offset": ISOLATION_UPPER, "collision_energy": COLLISION_ENERGY, "base_peak_intensity": BASE_PEAK}
    return {"scan_number": int(scan[1]) if scan else None, **{k: _value(block, a) for k, a in names.items()}, "mz": arrays.get("mz", np.empty(0))[:n].tolist(), "intensity": arrays.get("intensity", np.empty(0))[:n].tolist()}


SPECTRA = "scan_number long, ms_level double, retention_time double, precursor_mz double, isolation_target_mz double, isolation_lower_offset double, isolation_upper_offset double, collision_energy double, base_peak_intensity double, mz array<double>, intensity array<double>"


def read_mzml(spark: SparkSession, path: str, precursor: float | None = None, ppm: float = 10) -> tuple[DataFrame, DataFrame]:
    """Fragment scans and their peaks (long).  The text source splits files at </spectrum>, and level and
    precursor are tested before any array is decoded."""
    ship_package(spark)
    blocks = spark.read.option("lineSep", "</spectrum>").text(path).select(F.concat(F.regexp_extract("value", r"(?s)<spectrum\b.*", 0), F.lit("</spectrum>")).alias("block"))
    blocks = blocks.where(F.col("block").rlike(f'accession="{MS_LEVEL}"[^>]*value="2"'))
    if precursor is not None:
        found = F.regexp_extract("block", f'accession="{SELECTED_ION}"[^>]*?value="([^"]*)"', 1).try_cast("double")
        blocks = blocks.where(F.abs(found - precursor) / precursor * 1e6 <= ppm)

    def decode(batches: Iterator[pd.DataFrame]):
        names = [c.split()[0] for c in SPECTRA.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([parse_spectrum(b) for b in pdf.block], columns=names)

    spectra = blocks.mapInPandas(decode, SPECTRA)
    peaks = spectra.select("scan_number", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("scan_number", F.col("p.mz").alias("fragment_mz"), F.col("p.intensity").alias("fragment_intensity"))
    return spectra.drop("mz", "intensity"), peaks


# --- imzML ------------------------------------------------------------------------------------------


def validate_pair(imzml: bytes, ibd: bytes) -> str | None:
    """The UUID that both files state, None where the first states none; raises where they differ."""
    head = imzml[:16384].decode(errors="replace")
    m = re.search(r'accession="IMS:1000080"[^>]*?value="\{?([0-9a-fA-F-]{32,36})\}?"', head)
    if not m:
        return None
    stated = uuid.UUID(m[1])
    if ibd[:16] not in (stated.bytes, stated.bytes_le):
        raise ValueError("the files' UUIDs differ")
    return str(stated)


def imzml_index(text: bytes) -> list[tuple[int, int, int, int, int, int, bool, bool]]:
    """(x, y, mz offset, mz count, intensity offset, intensity count, mz is double, intensity is double)."""
    return list(iter_index(io.BytesIO(text)))


def iter_index(file):
    """The rows of ``imzml_index``, one spectrum at a time: what has been read is dropped."""
    groups: dict[str, set[str]] = {}
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    params = lambda e: {p.get("accession"): p.get("value") for p in e.iter() if tag(p) == "cvParam"}
    refs = lambda e: [p.get("ref") for p in e.iter() if tag(p) == "referenceableParamGroupRef"]
    for _, element in ElementTree.iterparse(file):
        if tag(element) == "referenceableParamGroup":
            groups[element.get("id")] = set(params(element))
        elif tag(element) == "spectrum":
            place = params(element)
            arrays = {}
            for a in (e for e in element.iter() if tag(e) == "binaryDataArray"):
                own = params(a)
                known = set(own).union(*(groups.get(r, set()) for r in refs(a)))
                arrays["mz" if MZ_ARRAY in known else "intensity"] = (int(own[EXTERNAL_OFFSET]), int(own[EXTERNAL_LENGTH]), FLOAT64 in known)
            (mo, mn, md), (io_, n, idbl) = arrays["mz"], arrays["intensity"]
            yield int(place[POSITION_X]), int(place[POSITION_Y]), mo, mn, io_, n, md, idbl
            element.clear()


class _Slice(InputPartition):
    def __init__(self, rows):
        self.rows = rows


class _ImzmlReader(DataSourceReader):
    """Partitions are runs of spectra; each task reads only its byte ranges of the binary file."""

    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.per_task = int(options.get("spectraPerTask", 4096))
        self.ibd = options.get("ibd", re.sub(r"\.imzml$", ".ibd", self.path, flags=re.I)).removeprefix("file://")

    def partitions(self):
        with open(self.path, "rb") as f, open(self.ibd, "rb") as g:
            validate_pair(f.read(16384), g.read(16))
            f.seek(0)
            rows = [(i + 1, *r) for i, r in enumerate(iter_index(f))]
        return [_Slice(rows[i : i + self.per_task]) for i in range(0, len(rows), self.per_task)]

    def read(self, partition):
        with open(self.ibd, "rb") as f:
            for ident, x, y, mo, mn, io, n, md, idbl in partition.rows:
                out = []
                for offset, count, double in ((mo, mn, md), (io, n, idbl)):
                    f.seek(offset)
                    out.append(np.frombuffer(f.read(count * (8 if double else 4)), "<f8" if double else "<f4").astype(float).tolist())
                yield ident, float(x), float(y), out[0], out[1]


class ImzmlSource(DataSource):
    """``spark.read.format("imzml").load(path)``: pixel_id, x, y, mz, intensity.  The files must be mounted on
    every machine, as their format needs random access to the binary part."""

    @classmethod
    def name(cls):
        return "imzml"

    def schema(self):
        return "pixel_id long, x double, y double, mz array<double>, intensity array<double>"

    def reader(self, schema):
        return _ImzmlReader(self.options)


def read_imzml(spark: SparkSession, path: str, ibd: str | None = None) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(ImzmlSource)
    reader = spark.read.format("imzml")
    return (reader.option("ibd", ibd) if ibd else reader).load(path)


def align_peaks(spectra: DataFrame, ppm: float = 10, min_detection: float = 0.0) -> DataFrame:
    """Long intensities of variable-axis spectra on a shared axis: masses sorted once, a new bin wherever the
    gap to the one before exceeds ppm; bins detected in too few pixels are dropped.

    Gaps are found within logarithmic stripes, so that no window runs over all peaks; a stripe's first mass is
    compared with the last one before the stripe, which a window over the few stripes hands on."""
    from pyspark.sql import Window

    peaks = spectra.select("pixel_id", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("pixel_id", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))
    # Distinct masses are rounded to a hundredth of the tolerance: far fewer than peaks.
    unit = ppm * 1e-8
    masses = peaks.select(F.round(F.ln("mz") / unit).cast("long").alias("k")).distinct().withColumn("s", F.floor(F.col("k") / 1_000_000))
    w, over_stripes = Window.partitionBy("s").orderBy("k"), Window.orderBy("s")
    before = masses.groupBy("s").agg(F.max("k").alias("last")).withColumn("last", F.lag("last").over(over_stripes))
    at = masses.join(F.broadcast(before), "s").withColumn("new", F.coalesce((F.col("k") - F.coalesce(F.lag("k").over(w), "last") > 100).cast("int"), F.lit(1)))  # a row per stripe
    bins = at.withColumn("b", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    offsets = at.groupBy("s").agg(F.sum("new").alias("bins")).select("s", F.coalesce(F.sum("bins").over(over_stripes.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    bins = bins.join(F.broadcast(offsets), "s").select("k", (F.col("b") + F.col("offset")).alias("b"))  # a row per stripe
    joined = peaks.withColumn("k", F.round(F.ln("mz") / unit).cast("long")).join(bins, "k")
    # A bin may hold most peaks: sums per bin and pixel come first, so no row of a peak is dealt by its bin.
    sums = joined.groupBy("b", "pixel_id").agg(F.sum("intensity").alias("value"), F.sum(F.col("mz") * F.col("intensity")).alias("moment"))
    centre = sums.groupBy("b").agg((F.sum("moment") / F.sum("value")).alias("center"), F.count("pixel_id").alias("n"))
    total = spectra.agg(F.count_distinct("pixel_id").alias("total"))
    kept = centre.crossJoin(F.broadcast(total)).where(F.col("n") / F.col("total") >= min_detection).select("b", F.concat(F.lit("mz_"), F.format_string("%.6f", "center")).alias("feature"), (F.col("n") / F.col("total")).alias("detection_fraction"))  # one row
    return sums.join(kept, "b").groupBy("pixel_id", "feature").agg(F.sum("value").alias("value"), F.first("detection_fraction").alias("detection_fraction"))
