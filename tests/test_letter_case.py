"""Letter case of text columns changes no group: half of the hospitals write them in lower case."""

import pandas as pd
import pytest
from conftest import SMALL_DATA
from pyspark.sql import functions as F

from checks.provider_tables import provider
from wardlens.models import triage
from wardlens.operators import experience as e
from wardlens.operators import geography as g
from wardlens.operators import grouping as k
from wardlens.operators import ownership as o
from wardlens.operators import safety as c
from wardlens.operators import timeliness as t

TEXTS = {
    "facility": ["state", "county_parish", "hospital_type", "hospital_ownership", "emergency_services"],
    "timely": ["state", "condition_name", "measure_name"],
    "survey": ["state", "hcahps_measure_id"],
}

CASES = {
    "distinct_values": ("f", lambda h: k.distinct_values(h, "state")),
    "count_by": ("f", lambda h: k.count_by(h, "state")),
    "avg_rating_by": ("f", lambda h: k.avg_rating_by(h, "state")),
    "rank_groups": ("f", lambda h: k.rank_groups(h, "hospital_ownership", "r")),
    "below_national": ("f", lambda h: k.below_national(h, ["hospital_ownership"], "average_rating", show=True)),
    "low_rated_counties": ("f", lambda h: g.low_rated_counties(h, 1)),
    "emergency_split": ("f", g.emergency_split),
    "count_worse_by": ("f", lambda h: g.count_worse_by(h, "mort", "state", more_than=1)),
    "bottom_1_per": ("f", lambda h: g.bottom_n_per(h, "state", 1)),
    "bottom_3_per": ("f", lambda h: g.bottom_n_per(h, "hospital_type", 3)),
    "counties_below_national": ("f", g.counties_below_national),
    "v_state_summary": ("f", g.v_state_summary),
    "avg_rating_having": ("f", lambda h: o.avg_rating_having(h, "hospital_ownership", 2.0)),
    "birthing_by_ownership": ("f", o.birthing_by_ownership),
    "pct_zero_safety": ("f", o.pct_zero_safety),
    "v_type_ownership": ("f", o.v_type_ownership),
    "best_group_per": ("f", o.best_group_per),
    "avg_worse_by": ("f", lambda h: c.avg_worse_by(h, "mort", "state", "m")),
    "high_risk_by_state": ("f", c.high_risk_by_state),
    "worst_per_state": ("f", c.worst_per_state),
    "avg_score_by": ("t", lambda x: t.avg_score_by(x, "condition_name")),
    "score_change": ("t", t.score_change),
    "avg_score_by_state": ("tf", t.avg_score_by_state),
    "states_below_national": ("tf", t.states_below_national),
    "rank_in_state": ("tf", t.rank_in_state),
    "avg_star_by": ("sf", e.avg_star_by),
    "avg_answer_by_measure": ("s", e.avg_answer_by_measure),
    "low_response_by_ownership": ("sf", lambda s, h: e.low_response_by_ownership(s, h, 60)),
    "states_many_low": ("sf", lambda s, h: e.states_many_low(s, h, 4.0, 1)),
    "top_star_per_state": ("sf", e.top_star_per_state),
}


@pytest.fixture(scope="module")
def tables(spark):
    plain, mixed = {}, {}
    for name, texts in TEXTS.items():
        df = provider(spark, SMALL_DATA, name)
        low = F.crc32(F.concat_ws("/", *[c for c in ("facility_id", "start_date") if c in df.columns])) % 2 == 0
        plain[name[0]] = df.cache()
        mixed[name[0]] = df.withColumns({c: F.when(low, F.lower(c)).otherwise(F.col(c)) for c in texts}).cache()
    return plain, mixed


def _folded(df):
    rows = df.toPandas()
    for c in rows.columns[[pd.api.types.is_object_dtype(x) or pd.api.types.is_string_dtype(x) for x in rows.dtypes]]:
        rows[c] = rows[c].map(lambda v: v.lower() if isinstance(v, str) else v)
    return rows.sort_values(list(rows.columns), ignore_index=True)


@pytest.mark.parametrize("name", CASES)
def test_groups(tables, name):
    wanted, fn = CASES[name]
    want, got = (_folded(fn(*[side[w] for w in wanted])) for side in tables)
    assert len(want) > 0
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_labels(tables):
    """The same spelling of a type stands in all its rows."""
    types = [r.hospital_type for r in o.v_type_ownership(tables[1]["f"]).collect()]
    assert len(set(types)) == len({x.lower() for x in types})
    names = [r.condition_name for r in t.score_change(tables[1]["t"]).collect()]
    assert len(set(names)) == len({x.lower() for x in names})


def test_triage_state(spark):
    scored = spark.createDataFrame(
        [(1, "a", "CA", "x", 0.5, 3.0, 2.0, "1"), (2, "b", "ca ", "x", 0.4, 3.0, 2.0, "2"), (3, "c", "TX", "x", 0.9, 3.0, 2.0, "3")],
        "risk_rank int, facility_name string, state string, hospital_type string, predicted_risk double, "
        "overall_rating double, patient_star_avg double, facility_id string",
    )
    assert [r.facility_name for r in triage.triage(scored, "Ca").collect()] == ["a", "b"]
    assert triage.state_list(scored).count() == 2
