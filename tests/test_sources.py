"""Readers, sinks, image scores and the decision stream."""

import http.server
import random
import threading

import pytest
from pyspark.sql import functions as F

from plotlink.functions import geometry as G
from plotlink.functions import text as X
from plotlink.operators import raster
from plotlink.operators.scratch import cut_lineage
from plotlink.sources import gml, osm, tables, wfs
from plotlink.streaming import decisions

PAGE = """<?xml version="1.0"?><c:FeatureCollection xmlns:c="http://www.opengis.net/wfs/2.0" xmlns:g="http://www.opengis.net/gml/3.2" xmlns:b="urn:b" srsDimension="2">{}</c:FeatureCollection>"""
HOUSE = '<c:member><b:house g:id="H{0}"><b:oid>{1}</b:oid><b:use>a</b:use><b:use>b</b:use><b:geom>{2}</b:geom></b:house></c:member>'
SQUARE = '<g:Polygon><g:exterior><g:LinearRing><g:posList>0 0 10 0 10 0 10 10 0 10</g:posList></g:LinearRing></g:exterior><g:interior><g:LinearRing><g:posList>2 2 2 4 4 4 2 2</g:posList></g:LinearRing></g:interior></g:Polygon>'
SOLID = '<g:MultiSurface srsDimension="3"><g:surfaceMember><g:Polygon><g:exterior><g:LinearRing><g:posList>0 0 5 4 0 5 4 3 5 0 0 5</g:posList></g:LinearRing></g:exterior></g:Polygon></g:surfaceMember></g:MultiSurface>'
OLD = "<g:Polygon><g:outerBoundaryIs><g:LinearRing><g:coordinates>0,0 4,0 4,3 0,0 7</g:coordinates></g:LinearRing></g:outerBoundaryIs></g:Polygon>"


def test_gml(spark, tmp_path):
    (tmp_path / "p0.xml").write_text(PAGE.format(HOUSE.format(1, "o1", SQUARE) + HOUSE.format(2, "", SOLID) + HOUSE.format(3, "o3", OLD) + HOUSE.format(4, "o4", "")))
    (tmp_path / "p1.xml").write_text(PAGE.format(HOUSE.format(5, "o1", SQUARE)))
    d = gml.read_gml(spark, str(tmp_path), "oid")
    got = {(r.page[-6:], r.id): r for r in d.collect()}
    assert {k[1] for k in got} == {"o1", "H2", "o3"} and len(got) == 4
    one = got["p0.xml", "o1"]
    assert one.polygons[0].outer == [0, 0, 10, 0, 10, 10, 0, 10, 0, 0] and len(one.polygons[0].holes) == 1 and one.attrs["use"] == "a;b" and one.raw_features == 4
    assert got["p0.xml", "H2"].polygons[0].outer == [0, 0, 4, 0, 4, 3, 0, 0] and got["p0.xml", "o3"].polygons[0].outer == [0, 0, 4, 0, 4, 3, 0, 0]
    assert sorted(r.id for r in gml.first_by_id(d).collect()) == ["H2", "o1", "o3"]
    assert gml.parse_page(PAGE.format(HOUSE.format(1, "", SOLID)).encode(), None, True)[0][0]["polygons"][0]["outer"][2:4] == [0, 4]
    for bad in ("<x", '<!DOCTYPE a [<!ENTITY b "c">]><a/>', "<ows:ExceptionReport xmlns:ows='u'><ows:ExceptionText>no such type</ows:ExceptionText></ows:ExceptionReport>"):
        with pytest.raises(Exception):
            gml.parse_page(bad.encode(), None, False)
    pages = spark.createDataFrame([(0, 2, 2), (1, 2, 2), (2, 1, 1), (3, 2, 2)], "page_no int, raw_features int, new_ids int")
    assert tuple(gml.page_state(pages, 2, 100).first()) == (3, 5, False)
    assert tuple(gml.page_state(pages, 2, 4).first()) == (2, 4, True)


def test_feature_urls():
    u = wfs.feature_url("https://x.org/wfs?service=WFS", "b:house", "EPSG:25832", (1, 2, 3, 4.5), start=1000)
    assert "SERVICE" not in u and "TYPENAMES=b%3Ahouse" in u and "STARTINDEX=1000" in u and "BBOX=1.000%2C2.000%2C3.000%2C4.500%2Curn" in u
    old = wfs.feature_url("https://x.org/wfs", "t", "EPSG:25832", (1, 2, 3, 4), version="1.1.0", swap_axes=True)
    assert "?SERVICE=WFS" in old and "MAXFEATURES=1000" in old and "BBOX=2.000%2C1.000" in old and "COUNT" not in old
    assert wfs.append_query("http://x?", {"a": "1"}) == "http://x?a=1" and wfs.append_query("http://x?b=2", {"B": "3"}) == "http://x?b=2"
    assert wfs.snippet("<a>one</a>\n <b>two" + "x" * 400) == "one two" + "x" * 293


def test_wfs_pages(spark):
    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            start = 2 if "STARTINDEX=2" in self.path else 4 if "STARTINDEX=4" in self.path else 0
            body = PAGE.format("".join(HOUSE.format(k, f"o{k}", SQUARE) for k in range(start, min(start + 2, 5)))).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(wfs.WfsDataSource)
    d = spark.read.format("wfs").options(url=f"http://127.0.0.1:{server.server_port}/", typeName="b:house", crs="EPSG:25832", bbox="0,0,10,10", pageSize="2", idAttribute="oid").load()
    rows = d.collect()
    server.shutdown()
    assert [r.page_no for r in rows] == [0, 1, 2] and b"o4" in bytes(rows[2].content)


OSM = """<osm version="0.6">
<node id="1" lat="51.0" lon="7.0"/><node id="2" lat="51.0" lon="7.0002"/><node id="3" lat="51.0001" lon="7.0002"/><node id="4" lat="51.0001" lon="7.0"/>
<node id="5" lat="51.0002" lon="7.0"><tag k="addr:street" v="Elm"/><tag k="addr:housenumber" v="3"/></node>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="4"/><nd ref="1"/><tag k="building" v="yes"/><tag k="addr:street" v="Oak"/><tag k="addr:housenumber" v="1"/></way>
<way id="11"><nd ref="1"/><nd ref="2"/><nd ref="99"/><nd ref="1"/><tag k="building" v="yes"/></way><way id="12"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="building" v="no"/></way>
<way id="13"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="4"/><nd ref="1"/></way>
<relation id="20"><member type="way" ref="13" role="outer"/><tag k="building" v="house"/><tag k="type" v="multipolygon"/></relation>
<relation id="21"><member type="way" ref="77" role="outer"/><tag k="building" v="house"/><tag k="type" v="multipolygon"/></relation>
</osm>"""


def test_osm(spark, tmp_path):
    (tmp_path / "x.osm").write_text(OSM)
    nodes, ways, relations = osm.read_osm(spark, str(tmp_path / "x.osm"), zone=32)
    assert (nodes.count(), ways.count(), relations.count()) == (5, 4, 2)
    b = osm.building_ways(nodes, ways).collect()
    assert [r.osm_id for r in b] == [10] and 100 < (b[0].x1 - b[0].x0) * (b[0].y1 - b[0].y0) < 200
    assert [r.osm_id for r in osm.building_relations(nodes, ways, relations).collect()] == [20]
    assert {(r.owner, r.street, r.housenumber) for r in osm.addresses(nodes, ways).collect()} == {("n5", "Elm", "3"), ("w10", "Oak", "1")}


def test_lookup_profiles_and_log(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# comment\nA;B;house\nshed ; shed\nbroken\na;b;barn\n")
    assert {r.key: r.value for r in tables.read_lookup(spark, str(tmp_path / "t.csv")).collect()} == {"a;b": "barn", "shed": "shed"}
    p = tables.load_profiles('{"name": "n", "crs": null, "other": 1, "lookup": {"x": "y"}}')
    assert p[0].crs == "EPSG:25832" and p[0].rules[0]["kind"] == "BUILDING" and tables.load_profiles(tables.dump_profiles(p)) == p
    assert [q.name for q in tables.add_missing(p, [tables.Profile(name="n"), tables.Profile(name="m")])] == ["n", "m"]
    rules, mapping, filters = p[0].mapping()
    got = spark.range(1).select(X.mapped_tags(F.create_map(F.lit("function"), F.lit(" X ")), rules, mapping, filters).alias("m")).first().m
    assert [(t.key, t.value) for t in got.tags] == [("building", "y")] and got.excluded is None
    schema = "time timestamp, profile string, id string, function string, match_class string, iou double, hausdorff double, score double, map_score double, offset double, recommendation string, decision string, duration_ms long, hints array<string>"
    import datetime

    row = (datetime.datetime(2024, 1, 2, 3, 4, 5), 'p;"q"', "i\n1", None, "NEU", None, float("nan"), 0.123456, 1.0, 0.5, None, "applied", None, ["a", "b"])
    for _ in range(2):
        tables.append_log(spark.createDataFrame([row], schema), str(tmp_path / "log"))
    back = tables.read_log(spark, str(tmp_path / "log")).collect()
    assert len(back) == 2 and (back[0].profile, back[0].id, back[0].iou, back[0].hausdorff, back[0].score, back[0].duration_ms, back[0].hints) == ('p;"q"', "i 1", None, None, 0.1235, -1, "a | b")
    assert tables.source_tag(None, "s") == "s" and tables.source_tag("a;s", "s") == "a;s" and tables.source_tag("a", "s") == "a;s"


@pytest.fixture(scope="module")
def image(spark):
    rng = random.Random(0)
    w, h, res = 75, 75, 0.4  # a bright 12 x 8 m block on noise, 30 m wide
    gray = [float((200 if 9 <= x * res < 21 and 10 <= y * res < 18 else 60) + rng.randint(-6, 6)) for y in range(h) for x in range(w)]
    d = spark.createDataFrame([(w, h, 1000.0, 2030.0, res, gray)], "w int, h int, min_x double, max_y double, res double, gray array<double>")
    return cut_lineage(raster.with_edges(d))


@pytest.mark.parametrize(("case", "ring", "low", "high"), [("exact", (1009, 2012, 1021, 2020), 0.9, 1), ("moved", (1010, 2012.5, 1022, 2020.5), 0.9, 1), ("far", (1012.5, 2015.5, 1024.5, 2023.5), 0, 0.8), ("empty", (1001, 2001, 1006, 2006), 0, 0.3)])
def test_edge_support(spark, image, case, ring, low, high):
    from dataclasses import replace

    from plotlink.params import DEFAULTS

    params = replace(DEFAULTS, max_overhang=0.3, sample_step=0.5)
    x0, y0, x1, y1 = map(float, ring)
    r = raster.derived(raster.best_offset(image.withColumn("ring", G.rectangle(F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1))).withColumn("case", F.lit(case)), ["case"], 0.4, params)).first()
    assert low <= r.score <= high and r.valid
    if case == "moved":
        assert 0.4 <= r.offset <= 1.5  # a reach of one pixel and the bias to small offsets take some off 1.118


def test_decision_stream(spark, tmp_path):
    schema = "id long, seq long, decision string, ts timestamp"
    src = tmp_path / "in"
    write = lambda rows: spark.createDataFrame(rows, "id long, seq long, decision string").withColumn("ts", F.timestamp_seconds("seq")).write.mode("append").parquet(str(src))
    write([(1, 1, "applied"), (2, 2, "skipped")])
    stream = decisions.decision_stream(spark, str(src), schema)
    q = decisions.follow_states(stream, str(tmp_path / "states"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    write([(2, 3, "rejected"), (1, 0, "open")])
    q = decisions.follow_states(stream, str(tmp_path / "states"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r.id: r.last.decision for r in spark.read.parquet(f"{tmp_path}/states/batch=1").collect()}
    batch = {r.id: r.status for r in decisions.current_states(spark.read.parquet(str(src))).collect()}
    assert got == batch == {1: "applied", 2: "rejected"}
    assert decisions.rates_by_window(stream).isStreaming


def test_large_gml_in_many_tasks(spark, tmp_path):
    houses = [HOUSE.format(k, f"o{k}" if k % 5 else "", (SQUARE, SOLID, "")[k % 3]) for k in range(300)]
    (tmp_path / "big.xml").write_text(PAGE.format("".join(houses)))
    path = str(tmp_path / "big.xml")
    want = sorted(map(repr, gml.read_gml(spark, path, "oid").collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        got = gml.read_large_gml(spark, path, "oid").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(want) == 200 and sorted(map(repr, got)) == want
    for bad in ("<a><b/></a>", '<!DOCTYPE a [<!ENTITY b "c">]><a/>', "<ExceptionReport>no such type</ExceptionReport>", PAGE.format(HOUSE.format(1, "x", SQUARE))[:-60]):
        (tmp_path / "bad.xml").write_text(bad)
        with pytest.raises(Exception):
            gml.read_large_gml(spark, str(tmp_path / "bad.xml"), "oid").collect()
