"""Answers do not depend on the number of shuffle partitions, and small forms agree with large ones."""

import random
import re

import pytest
from conftest import SMALL_DATA

import __spark_entry__ as entry_point
from checks.compare import canonical
from checks.provider_tables import provider
from wardlens.functions import clean
from wardlens.operators import grouping
from wardlens.models import validate
from test_models import TINY


@pytest.mark.parametrize("key", ["q11", "q42", "q56", "q58", "q75", "t_warn", "e_auc", "m_split", "m_folds_stratified"])
def test_partition_count_does_not_matter(spark, key):
    before, answers = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        answers.append(canonical(entry_point.queries()[key](spark, SMALL_DATA).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert answers[0] == answers[1] and answers[0]


def test_group_rank_equals_window(spark):
    h = provider(spark, SMALL_DATA, "facility")
    got = {r[0]: r.k for r in grouping.rank_groups(h, "county_parish", "k").collect()}
    means = [(r[0], r._mean) for r in grouping.group_means(h, "county_parish").collect()]
    assert got == {c: 1 + sum(m > mean for _, m in means) for c, mean in means}


def test_number_parse_on_random_text(spark):
    """Against the rule itself: a plain decimal or scientific number that a double can hold, or missing."""
    r = random.Random(3)
    texts = ["".join(r.choice("0123456789.+-eE dfNaxX*,") for _ in range(r.randint(0, 6))) for _ in range(5000)]
    texts += [f"{r.uniform(-1e6, 1e6):.{r.randint(0, 5)}f}" for _ in range(500)] + list(clean.MISSING_TOKENS)
    pattern = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    got = spark.createDataFrame(list(enumerate(texts)), "i int, c string").orderBy("i").select(clean.to_num("c")).collect()
    for text, (value,) in zip(texts, got):
        bare = text.strip()
        want = float(bare) if pattern.match(bare) else None
        assert value == (None if want in (float("inf"), float("-inf")) else want), text


def test_every_candidate_is_scored(features):
    scores = validate.fold_scores(features, "classification", TINY, k=2)
    assert len(scores) == 5 and all(len(v) == 2 and all(0 <= x <= 1 for x in v) for v in scores.values())
    regression = validate.fold_scores(features, "regression", TINY, k=2)
    assert len(regression) == 5 and all(x <= 1 for v in regression.values() for x in v)
