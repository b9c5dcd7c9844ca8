"""Rasters and polygons end to end, guards, readers and writers."""

import json

import pytest

from linkmosaic.errors import ComputeLimitError, GeometryError, InputError, ScaleError
from linkmosaic.operators import cellsets, graph, labels, landscape, masks
from linkmosaic.plans import api
from linkmosaic.plans import raster as R
from linkmosaic.plans import vector as V
from linkmosaic.sources import readers
from linkmosaic.sources.schema import CELLS, RasterMeta
from linkmosaic.sources.writers import with_wkb


def grid(spark, nrow, ncol, value):
    rows = [((r - 1) * ncol + c, r, c, value(r, c)) for r in range(1, nrow + 1) for c in range(1, ncol + 1)]
    return spark.createDataFrame(rows, CELLS)


def square(x, y, w, h):
    return [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]


def layer(spark, rows):
    return spark.createDataFrame([(i, [[[float(a), float(b)] for a, b in r] for r in g]) for i, g in rows], f"id long, geom {V.POLY}")


def test_metrics_of_two_patches(spark):
    cells = grid(spark, 20, 20, lambda r, c: 1.0 if (r - 1) * 20 + c <= 10 or 300 <= (r - 1) * 20 + c <= 320 else 0.0)
    got = landscape.mask_metrics(cells.filter("value = 1"), RasterMeta(20, 20)).first().asDict()
    want = {
        "total_area": 31, "num_patches": 2, "total_edge": 66, "mesh": 17.451612903, "split": 1.776340111, "lps": 21, "lpi": 67.741935484, "pd": 6.451612903,
        "ed": 2.129032258, "msi": 2.069824753, "mean_para": 2.147619048, "frac": 1.527972346, "ai": 59.347823160, "cai": 0, "mean_gyrate": 3.848187242,
    }
    assert got == pytest.approx(want, abs=1e-8)
    assert set(landscape.mask_metrics(cells.filter("value = 7"), RasterMeta(20, 20)).first().asDict().values()) == {0.0}


def test_labels_across_tiles(spark):
    snake = lambda r, c: 1.0 if r % 4 == 1 or (r % 4 == 3 and c in (1, 12)) or (r % 2 == 0 and c == (12 if r % 4 == 2 else 1)) else 0.0
    cells = grid(spark, 12, 12, snake).filter("value = 1")
    for k in (4, 8):
        small = {tuple(x) for x in labels.label_patches(cells, RasterMeta(12, 12), k, tile=3).select("cell", "patch_id").collect()}
        whole = {tuple(x) for x in labels.label_patches(cells, RasterMeta(12, 12), k).select("cell", "patch_id").collect()}
        assert small == whole


def test_contiguous(spark):
    cells = grid(spark, 5, 5, lambda r, c: 0.0)
    out = cellsets.contiguous_raster(cells.filter("cell in (1, 2, 24, 25)"), cells.filter("cell = 13"), RasterMeta(5, 5))
    assert {r["cell"]: r["value"] for r in out.collect()} == {1: 2, 2: 2, 24: 2, 25: 2, 13: 1}


def test_offsets():
    assert [len(masks.disc_offsets(w)) for w in (1, 2, 3, 4, 5, 6, 7, 9)] == [1, 5, 9, 13, 21, 29, 37, 69]
    assert sum(map(sum, masks.kernel(masks.disc_offsets(3)))) == 9
    assert cellsets.line_cells(1, 1, 4, 3)[0] == (1, 1) and cellsets.line_cells(1, 1, 4, 3)[-1] == (4, 3) and len(cellsets.line_cells(5, 5, 5, 5)) == 1


def test_graph_metrics(spark):
    v, e = graph.build(spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(1, 2, 10.0), (2, 3, 20.0)], "patch1 long, patch2 long, distance_m double"))
    got = graph.total_entropy(v, e).first()
    assert got["h_mov"] == pytest.approx(0.231032394220, abs=1e-9)
    assert got["h_total"] == pytest.approx(0.897699060887, abs=1e-9)
    assert graph.two_edge_connectivity(v, e).first()[0] == 0
    assert graph.failure_probability(v, e).first()[0] == 1


def test_walls_are_not_crossed(spark):
    def value(r, c):
        if 20 <= r <= 30 and (10 <= c <= 18 or 62 <= c <= 70):
            return 1.0
        return 2.0 if c in (40, 41) and not 37 <= r <= 44 else 0.0

    cells = grid(spark, 80, 80, value)
    out = api.run("raster", cells, RasterMeta(80, 80), [1], 260, min_patch_size=5, min_corridor_width=3, max_search_distance=120, obstacle_values=[2])
    walls = {r["cell"] for r in cells.filter("value = 2").collect()}
    rows = out.tables["corridors"].collect()
    assert len(rows) >= 1 and not any(walls & set(r["buffered_cells"]) for r in rows)
    assert out.summary["budget_used"] <= 260 and "PRE" in out.describe()


def test_raster_guards(spark):
    cells, meta = grid(spark, 10, 10, lambda r, c: 1.0 if (r - 1) * 10 + c in (1, 50, 100) else 0.0), RasterMeta(10, 10)
    with pytest.raises(ScaleError):
        R.find_corridors(cells, meta, [1], units="metric", budget_pixels=5)
    with pytest.raises(ComputeLimitError):
        R.find_corridors(cells, meta, [1], 5, min_patch_size=1, max_pair_checks=1)
    with pytest.raises(InputError):
        R.find_corridors(cells, meta, [], 5)
    with pytest.raises(ComputeLimitError):
        R.preflight(RasterMeta(10_000, 10_000))


def test_metric_raster_and_writers(spark, tmp_path):
    cells = grid(spark, 10, 10, lambda r, c: 1.0 if (r - 1) * 10 + c <= 5 or (r - 1) * 10 + c >= 96 else 0.0)
    out = api.run_raster(cells, RasterMeta(10, 10, crs=3857), [1], 0.01, units="metric", min_patch_size=0.0001, max_search_distance=30, output_dir=str(tmp_path), strategy="largest_network")
    paths = out.diagnostics["paths"]
    assert spark.read.parquet(paths["labels"]).count() == 10
    assert spark.read.csv(paths["summary"], header=True).filter("item = 'patches'").first()["value"] == "2"


def test_two_squares(spark, tmp_path):
    out = api.run("vector", layer(spark, [(1, square(0, 0, 10, 10)), (2, square(30, 0, 10, 10))]), 10, crs=32618, min_patch_size=0.001, min_corridor_width=5, max_search_distance=100, output_dir=str(tmp_path))
    row = out.tables["corridors"].first()
    assert 100 <= row["corridor_area_m2"] <= 110 and row["connected_area_m2"] == pytest.approx(200)
    back = readers.polygons(with_wkb(out.tables["networks"].select("component_id", "geom")), "geom", "component_id", "wkb")
    assert back.count() >= 1


def test_repair_and_degrees(spark):
    bow = layer(spark, [(1, [[(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]]), (2, square(3, 0, 1, 1))])
    assert V.prepared(bow).agg({"area": "sum"}).first()[0] == pytest.approx(1.5)
    with pytest.raises(Exception, match="not valid"):
        V.prepared(bow, repair=False).collect()
    assert issubclass(GeometryError, Exception)
    lon = layer(spark, [(1, square(-73.0, 40.0, 0.01, 0.01)), (2, square(-72.98, 40.0, 0.01, 0.01))])
    out = V.find_corridors(lon, 100, crs=4326, min_patch_size=1, min_corridor_width=20, max_search_distance=2000)
    assert out.inputs["crs_work"] == 32618 and out.inputs["crs_output"] == 4326
    assert out.tables["patches"].first()["geom"][0][0] == pytest.approx([-73.0, 40.0], abs=1e-8)
    with pytest.raises(InputError):
        V.find_corridors(lon, 1)


def test_obstacles_are_cut_out(spark):
    patches = layer(spark, [(1, square(60, 320, 160, 160)), (2, square(780, 320, 160, 160))])
    walls = layer(spark, [(1, square(430, 0, 140, 380)), (2, square(430, 420, 140, 380))])
    out = V.find_corridors(patches, 8, crs=3857, min_patch_size=0.01, min_corridor_width=20, max_search_distance=2000, obstacles=[walls], obstacle_resolution=10)
    row = out.tables["corridors"].first()
    from linkmosaic.operators import geometry as g

    shared = g.overlay([g.rings([r]) for r in row["geom"]], both=[g.rings(x["geom"]) for x in walls.collect()])
    assert row["is_connected"] and g.slabs_area(shared) < 1e-6


def test_readers(spark, tmp_path):
    (tmp_path / "a.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9\n1 2 -9\n4 5 6\n")
    cells, meta = readers.read_raster(spark, str(tmp_path / "a.asc"))
    assert {r["cell"]: r["value"] for r in cells.collect()} == {1: 1, 2: 2, 3: None, 4: 4, 5: 5, 6: 6}
    assert (meta.nrow, meta.ncol, meta.xmin, meta.res_x) == (2, 3, 10, 5)
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square(0, 0, 1, 1)}}]}))
    assert readers.read_polygons(spark, str(tmp_path / "b.geojson")).count() == 1
    assert readers.parse_wkt("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.1 5.1, 5.2 5.1, 5.2 5.2, 5.1 5.1)))")[1][1][1] == [5.2, 5.1]
    assert readers.parse_wkb(readers.to_wkb(square(0, 0, 2, 1)))[0] == square(0, 0, 2, 1)
    assert len(api.examples("raster")) == 1
    with pytest.raises(InputError):
        readers.parse_wkt("POINT (1 2)")


def test_stream(spark, tmp_path):
    from linkmosaic.streaming.cells import mask_counts, read_cells

    grid(spark, 3, 3, lambda r, c: float(c)).write.parquet(str(tmp_path / "in"))
    q = mask_counts(read_cells(spark, str(tmp_path / "in")), [1, 2]).writeStream.outputMode("complete").format("memory").queryName("mask_counts").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(x) for x in spark.table("mask_counts").collect()} == {(1, 2, 3), (2, 2, 3), (3, 2, 3)}
