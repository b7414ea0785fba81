"""Every registered query of the engine against its SQL, and the others for a stable schema and rows."""

import pytest
from compare import difference, duck

from orograph import catalog

#: Many rounds of relaxation each: they run at the smallest size only, as all of these do, and after the others.
SLOW = {"alternative_routes", "multimodal_trips", "multi_stop_routes", "network_evacuation", "od_matrix", "route_paths", "route_costs"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE, key=lambda n: (n in SLOW, n)))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    assert difference(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE) - SLOW))
def test_without_sql_gives_rows(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry_works_without_optional_parts(monkeypatch):
    import __spark_entry__ as e

    def missing(name):
        raise ImportError(name)

    monkeypatch.setattr(e, "import_module", missing)
    assert set(e.queries()) == set(catalog.QUERIES)
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_a_shared_folder_only_a_local_session_has_one(spark, monkeypatch):
    from types import SimpleNamespace

    from orograph.functions import durable

    here = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="local[2]", applicationId="a"))
    assert durable.shared_folder(here) == durable.shared_folder(here)
    here.sparkContext.master = "spark://somewhere:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable.shared_folder(here)
