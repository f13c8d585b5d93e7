"""Clean tables give the same answers as text tables, and their filters reach the scan."""

import pytest
from conftest import SMALL_DATA

from checks import oracle_catalogue, provider_tables, registry_catalogue
from checks.compare import differences, duck
from wardlens.operators import timeliness
from wardlens.plans import ingest

TABLE_OF = {"facility": "general", "timely": "timely", "survey": "survey"}


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    """The derived provider tables written as clean tables."""
    root = tmp_path_factory.mktemp("clean")
    for name, table in TABLE_OF.items():
        ingest.write_clean(provider_tables.provider(spark, SMALL_DATA, name), table, str(root / name))
    return {name: ingest.read_clean(spark, str(root / name)) for name in TABLE_OF}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL_DATA)


@pytest.mark.parametrize("key", list(registry_catalogue.catalogue()))
def test_same_answer_as_the_oracle(spark, clean, con, key, monkeypatch):
    monkeypatch.setattr(registry_catalogue, "provider", lambda s, d, name: clean[name])
    got = registry_catalogue.catalogue()[key](spark, SMALL_DATA).toPandas()
    assert differences(got, con.sql(oracle_catalogue.catalogue()[key]).df()) is None


def test_filters_and_columns_reach_the_scan(clean):
    plan = timeliness.avg_score_by_state(clean["timely"], clean["facility"])._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line and "score__double" in line)
    assert "EqualTo(condition_name__key,emergency department)" in scan
    assert "IsNotNull(score__double)" in scan
    read = scan.split("ReadSchema: ")[1]
    assert "measure_name" not in read and "score:string" not in read


def test_one_release_is_read_alone(clean):
    one = clean["timely"].filter("period = '1996-12-31'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and one.count() > 0
