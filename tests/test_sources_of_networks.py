"""Networks from whatever they are given as, and profiles as preset files."""

import json

import pytest

from orograph.functions import profiles
from orograph.operators.polylines import elevation_profile
from orograph.sources import networks

LINE = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[27, 38], [27.001, 38]]}, "properties": {"highway": "path"}}
OSM = {"elements": [{"type": "node", "id": 1, "lat": 38.0, "lon": 27.0}, {"type": "node", "id": 2, "lat": 38.0, "lon": 27.002}, {"type": "way", "id": 3, "nodes": [1, 2], "tags": {"highway": "steps"}}]}


def test_networks_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [LINE]}))
    (tmp_path / "b.json").write_text(json.dumps(OSM))
    kinds = lambda df: sorted((r["highway"], r["lon2"]) for r in df.collect())
    assert kinds(networks.network(spark, str(tmp_path / "a.geojson"))) == [("path", 27.001)]
    assert kinds(networks.network(spark, f"{tmp_path}/*.json")) == [("steps", 27.002)]
    table = spark.createDataFrame([(1, "LINESTRING (27 38, 27.003 38)")], "id int, geometry string")
    assert kinds(networks.network(spark, table)) == [("residential", 27.003)]
    segments = networks.network(spark, table)
    assert networks.network(spark, segments) is segments
    with pytest.raises(FileNotFoundError, match="no network at"):
        networks.network(spark, str(tmp_path / "gone.geojson"))
    with pytest.raises(ValueError, match="geojson and .json"):
        networks.network(spark, str(tmp_path / "roads.shp"))
    with pytest.raises(ValueError, match="geometry"):
        networks.network(spark, spark.range(1))


def test_presets_there_and_back():
    for key in profiles.profiles():
        assert profiles.from_json(profiles.to_json(key)) == profiles.profiles()[key]
    own = profiles.from_json('{"key": "goat", "category": "pedestrian", "max_slope_pct": 60, "stair_allowed": false, "hierarchy_weights": {"5": 0.1}, "icon_name": "x"}')
    assert profiles.resolve(own)["max_slope_pct"] == 60 and own["stairs"] == 0 and own["h5"] == 0.1 and own["h1"] == 2.5
    with pytest.raises(ValueError, match="key and category"):
        profiles.from_json("[]")


def test_profiles_of_odd_routes(spark):
    rows = [(1, 0, 27.0, 38.0, None), (1, 1, 27.0, 38.0, 5.0), (1, 2, 27.001, 38.0, 5.0), (2, 0, 27.0, 38.0, 1.0), (3, 0, None, 38.0, 1.0)]
    df = spark.createDataFrame(rows, "route_id int, seq int, lon double, lat double, z double")
    got = elevation_profile(df).orderBy("seq").collect()
    assert [(r["route_id"], r["slope_pct"], r["elevation_m"]) for r in got] == [(1, 0.0, 0.0), (1, 0.0, 5.0), (1, 0.0, 5.0)]
    assert got[0]["calories_kcal"] == got[1]["calories_kcal"] == 0 < got[2]["calories_kcal"]
    assert {r["calories_kcal"] for r in elevation_profile(df, "vehicle").collect()} == {None}
    assert elevation_profile(df, "micromobility").count() == 3 and elevation_profile(df.limit(0)).collect() == []
