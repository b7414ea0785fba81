"""Features of made OpenStreetMap-style documents with odd tags and places."""

import json

from orograph.sources import urban


def read(spark, *elements, text=None):
    docs = [("a", text if text is not None else json.dumps({"elements": elements}))]
    return urban.elements(spark.createDataFrame(docs, "name string, value string"))


def ring(*places):
    return [{"lat": y, "lon": x} for x, y in places]


SQUARE = [(1.0, 1.0), (1.1, 1.0), (1.1, 1.1), (1.0, 1.0)]


def building(i, places=SQUARE, **tags):
    return {"type": "way", "id": i, "tags": {"building": "yes"} | {k.replace("__", ":"): v for k, v in tags.items()}, "geometry": ring(*places)}


def test_levels_and_heights(spark):
    cases = [{}, {"building__levels": "3"}, {"building__levels": "0"}, {"building__levels": "2.9"}, {"building__levels": "many", "height": "30"}, {"height": "16 m"}, {"height": "1"}, {"height": "tall"}, {"height": "nan"}]
    got = {r["building_id"]: (round(r["height_m"], 6), r["levels"]) for r in urban.buildings(read(spark, *[building(i, **c) for i, c in enumerate(cases)])).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [(12.0, 4), (9.6, 3), (3.2, 1), (6.4, 2), (12.0, 4), (16.0, 5), (3.0, 1), (12.0, 4), (12.0, 4)]


def test_kinds_and_places(spark):
    found = read(
        spark,
        {"type": "way", "id": 1, "tags": {"highway": "path", "building": "yes"}, "nodes": [11, 12, 99, 13]}, *[{"type": "node", "id": i, "lat": i / 10, "lon": 5.0} for i in (11, 12, 13)],
        {"type": "way", "id": 2, "tags": {"highway": "path"}, "nodes": [11, 99]}, building(3, SQUARE[:2]), building(4, [*SQUARE[:3], ("x", 1.0)]),
        {"type": "relation", "id": 5, "tags": {"building": "hall", "leisure": "park"}, "geometry": ring(*SQUARE)}, {"type": "relation", "id": 6, "tags": {"leisure": "park"}, "geometry": ring(*SQUARE)},
        {"type": "way", "id": 7, "tags": {"natural": "heath", "name": "Moor"}, "geometry": ring(*SQUARE)}, {"type": "way", "id": 8, "tags": {"natural": "water"}, "geometry": ring(*SQUARE)},
        {"type": "way", "id": 9, "tags": {"leisure": "garden", "landuse": "grass"}, "geometry": ring(*SQUARE)}, {"type": "node", "id": 10}, {"type": "way", "id": 20, "tags": {"highway": "road"}},
    )
    r = urban.roads(found).orderBy("seq").collect()
    assert [(x["road_id"], x["seq"], x["lat"]) for x in r] == [("1", 0, 1.1), ("1", 1, 1.2), ("1", 3, 1.3)]
    roads, houses = urban.roads_and_buildings(found)
    assert {x["building_id"]: x["use"] for x in houses.collect()} == {"4": "yes", "5": "hall"} and roads.count() == 3
    assert {(x["park_id"], x["use"], x["park"]) for x in urban.parks(found).collect()} == {("7", "heath", "Moor"), ("9", "garden", "")}
    told = {x["kind"]: (x["features"], x["missing"], x["open"]) for x in urban.counts(found).collect()}
    assert told == {"road": (3, 2, 0), "building": (3, 1, 2), "park": (2, 0, 0)}


def test_trees(spark):
    tree = lambda i, **t: {"type": "node", "id": i, "lat": 2.0, "lon": 1.0, "tags": {"natural": "tree"} | t}
    found = read(
        spark, tree(1), tree(2, height="50 m", leaf_type="Needleleaved"), tree(3, height="1", species="Pinea"), tree(4, genus="Pine", diameter_crown="30m"), tree(5, height="nan", diameter_crown="1"), tree(6, taxon="x") | {"lat": 0.0},
        {"type": "node", "id": 7, "tags": {"natural": "tree"}}, {"type": "way", "id": 8, "tags": {"natural": "tree_row"}, "geometry": [{"lat": 1.0, "lon": 1.0}, {"lat": 1.0}, {"lat": 1.0, "lon": 1.2}]},
    )
    got = {r["tree_id"]: (r["height_m"], round(r["canopy_m"], 6), r["kind"], r["species"]) for r in urban.trees(found).collect()}
    assert got == {
        "1": (8.0, 3.04, "deciduous", "tree"), "2": (35.0, 8.0, "conifer", "tree"), "3": (3.0, 1.5, "conifer", "Pinea"), "4": (8.0, 10.0, "conifer", "Pine"), "5": (8.0, 1.5, "deciduous", "tree"),
        "8_0": (7.5, 2.6, "deciduous", "tree_row"), "8_2": (7.5, 2.6, "deciduous", "tree_row"),
    }


def test_documents_that_are_none(spark):
    for text in ("", "not json", "{}", '{"elements": []}'):
        found = read(spark, text=text)
        assert found.count() == urban.roads(found).count() == urban.buildings(found).count() == urban.trees(found).count() == urban.counts(found).count() == 0


def test_documents_are_dealt_to_tasks_and_outlines_meet_no_other_rows(spark, sf_dir):
    """All documents were made by one task, as parts are one small file; outlines were joined by document and place, so documents of one name had each other's corners."""
    from orograph.plans import corridor_queries

    assert corridor_queries._urban(spark, sf_dir).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    docs = [("a", json.dumps({"elements": [building(i)]})) for i in (1, 2)]
    got = urban.buildings(urban.elements(spark.createDataFrame(docs, "name string, value string"))).collect()
    assert sorted((r["building_id"], r["seq"]) for r in got) == [(i, k) for i in "12" for k in range(4)]
