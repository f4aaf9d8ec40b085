import base64
import json
import struct
import uuid
import zlib

import pytest

from ionfield.sources import formats, tables
from ionfield.streaming import sections


def test_csv_and_series(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("x,y,100.5,200,note-1\n1,1,5,6,u\n2,1,7,8,v\n")
    b.write_text("x,y,100.5,300\n1,1,9,1\n")
    one = tables.import_pixel_csv(spark, str(a)).orderBy("pixel_id").collect()
    assert [r["pixel_id"] for r in one] == [1, 2] and one[0]["section_id"] == "a" and one[0]["mz_100.5"] == 5 and one[0]["note_1"] == "u"
    both, secs = tables.load_series(spark, [str(a), str(b)])
    assert [c for c in both.columns if c.startswith("mz_")] == ["mz_100.5"] and sorted(r[0] for r in both.select("pixel_id").collect()) == [1, 2, 3]
    assert secs.count() == 2
    bad = tmp_path / "c.csv"
    bad.write_text("y,100\n1,2\n")
    with pytest.raises(ValueError):
        tables.import_pixel_csv(spark, str(bad))


def test_manifest_and_outputs(spark, tmp_path):
    f = tmp_path / "in.txt"
    f.write_bytes(b"abc")
    rows = {r["key"]: r for r in tables.manifest(spark, [str(f)], {"ppm": 5}, {"a": {"b": 1}}).collect()}
    assert rows["in.txt"]["md5"] == "900150983cd24fb0d6963f7d28e17f72" and rows["a.b"]["value"] == "1"
    paths = tables.write_outputs({"t": spark.range(3).toDF("i"), "qc": {"n": 1}, "none": None}, str(tmp_path / "out"))
    assert len(paths) == 2 and spark.read.csv(paths[0], header=True).count() == 3


def test_geojson(spark, tmp_path):
    ring, hole = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]
    f = tmp_path / "r.geojson"
    f.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "r"}, "geometry": {"type": "Polygon", "coordinates": [ring, hole]}}] * 2}))
    rows = formats.import_geojson(spark, str(f)).collect()
    assert {r["roi_id"] for r in rows} == {"r", "r_2"} and {r["ring_role"] for r in rows} == {"outer", "hole"}
    with pytest.raises(ValueError):
        formats.geojson_vertices(json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}}))


def test_image_transform(spark, tmp_path):
    f = tmp_path / "d.json"
    f.write_text(json.dumps({"data": {"rawOpticalImage": {"transform": [[4, 0, 100], [0, 4, 200], [0, 0, 1]]}}}))
    assert formats.read_image_transform(spark, str(f))[0] == [4.0, 0.0, 100.0]


def _array(values, accession, compress):
    raw = struct.pack(f"<{len(values)}d", *values)
    text = base64.b64encode(zlib.compress(raw) if compress else raw).decode()
    return f'<binaryDataArray><cvParam accession="MS:1000523"/>{"<cvParam accession=\'MS:1000574\'/>".replace(chr(39), chr(34)) if compress else ""}<cvParam accession="{accession}"/><binary>{text}</binary></binaryDataArray>'


def test_mzml(spark, tmp_path):
    def spectrum(n, level, mz, compress):
        return f'<spectrum index="{n}" id="scan={n}"><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000016" value="5.5"/><cvParam accession="MS:1000744" value="{mz}"/><cvParam accession="MS:1000045" value="30"/>{_array([1.0, 2.0, 3.0], "MS:1000514", compress)}{_array([10.0, 20.0, 30.0], "MS:1000515", compress)}</spectrum>'

    f = tmp_path / "x.mzML"
    f.write_text("<mzML><run>" + spectrum(1, 1, 0, False) + spectrum(2, 2, 500.0, True) + spectrum(3, 2, 600.0, False) + "</run></mzML>")
    scans, peaks = formats.read_mzml(spark, str(f), 500.001)
    s = scans.collect()
    assert len(s) == 1 and s[0]["scan_number"] == 2 and s[0]["collision_energy"] == 30 and s[0]["retention_time"] == 5.5
    assert sorted((r["fragment_mz"], r["fragment_intensity"]) for r in peaks.collect()) == [(1.0, 10.0), (2.0, 20.0), (3.0, 30.0)]


def test_imzml(spark, tmp_path):
    ident = uuid.uuid4()
    ibd = ident.bytes + struct.pack("<3d", 100.0, 200.0, 300.0) + struct.pack("<3f", 1, 2, 3) + struct.pack("<2d", 100.0005, 250.0) + struct.pack("<2f", 4, 5)
    spec = lambda x, mo, n, io: f'<spectrum><scanList><scan><cvParam accession="IMS:1000050" value="{x}"/><cvParam accession="IMS:1000051" value="1"/></scan></scanList><binaryDataArrayList><binaryDataArray><referenceableParamGroupRef ref="m"/><cvParam accession="IMS:1000102" value="{mo}"/><cvParam accession="IMS:1000103" value="{n}"/></binaryDataArray><binaryDataArray><referenceableParamGroupRef ref="i"/><cvParam accession="IMS:1000102" value="{io}"/><cvParam accession="IMS:1000103" value="{n}"/></binaryDataArray></binaryDataArrayList></spectrum>'
    xml = f'<mzML><cvParam accession="IMS:1000080" value="{{{ident}}}"/><referenceableParamGroup id="m"><cvParam accession="MS:1000514"/><cvParam accession="MS:1000523"/></referenceableParamGroup><referenceableParamGroup id="i"><cvParam accession="MS:1000515"/><cvParam accession="MS:1000521"/></referenceableParamGroup>{spec(1, 16, 3, 40)}{spec(2, 52, 2, 68)}</mzML>'
    (tmp_path / "a.imzML").write_text(xml)
    (tmp_path / "a.ibd").write_bytes(ibd)
    spectra = formats.read_imzml(spark, str(tmp_path / "a.imzML"))
    rows = {r["pixel_id"]: r for r in spectra.collect()}
    assert rows[1]["mz"] == [100.0, 200.0, 300.0] and rows[2]["intensity"] == [4.0, 5.0] and rows[2]["x"] == 2.0
    aligned = formats.align_peaks(spectra, 10).collect()
    assert len({r["feature"] for r in aligned}) == 4 and sum(r["detection_fraction"] == 1.0 for r in aligned) == 2
    with pytest.raises(ValueError):
        formats.validate_pair(xml.encode(), b"\0" * 16)


def test_stream_of_sections(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "s1.csv").write_text("x,y,mz_1\n1,1,5\n2,1,7\n")
    rows = sections.stream_sections(spark, str(src), "x double, y double, mz_1 double")
    q = sections.section_totals(rows, ["mz_1"]).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("totals").collect()] == [("s1", 2, 12.0)]
    sections.append_sections(sections.stream_sections(spark, str(src), "x double, y double, mz_1 double"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_aligned_peaks_know_no_stripe_edges(spark):
    """Masses on both sides of e^5 (a stripe's edge at 10 ppm), close ones and far ones."""
    import math

    edge = math.exp(5.0)
    masses = [edge * (1 + d * 1e-6) for d in (-40, -33, -26, -0.4, 0.3, 6, 30)] + [300.0, 300.0001, 148.4131, 148.4132]
    spectra = spark.createDataFrame([(i, [m], [1.0]) for i, m in enumerate(masses)], "pixel_id long, mz array<double>, intensity array<double>")
    groups = {}
    for r in formats.align_peaks(spectra, 10).collect():
        groups.setdefault(r["feature"], set()).add(r["pixel_id"])
    expected, ordered = [], sorted(range(len(masses)), key=masses.__getitem__)
    for a, b in zip([None, *ordered], ordered, strict=False):
        if a is None or math.log(masses[b] / masses[a]) > 10e-6:
            expected.append(set())
        expected[-1].add(b)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected))


def test_aligned_peaks_are_summed_before_bins_are_dealt(spark):
    """All peaks in one bin: what is joined to the bins' names has a row per bin and pixel."""
    spectra = spark.createDataFrame([(i, [200.0, 200.0001] * 50, [1.0, 3.0] * 50) for i in range(8)], "pixel_id long, mz array<double>, intensity array<double>")
    out = formats.align_peaks(spectra, 10)
    assert sorted(tuple(r) for r in out.collect()) == [(i, "mz_200.000075", 200.0, 1.0) for i in range(8)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan.split("Join")[1] and plan.count("sum(moment") >= 1
