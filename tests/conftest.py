import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wardlens.session import build_session  # noqa: E402
from wardlens.sources.schemas import FEATURES  # noqa: E402

SMALL_DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.maxMetadataStringLength": "2000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


N_PROVIDERS = 110


def feature_rows(count=N_PROVIDERS, shift=3):
    """Made-up providers as rows of the feature table.

    Values follow from the provider's number by modular steps; worse counts are mostly 0, and total
    and label are worked out from them by the package's own rules.
    """
    regions, forms = ("R1", "R2", "R3", "R4", "R5"), ("general", "rural", "children")
    holders = ("trust", "state body", "company", "church")
    rows = []
    for k in range(count):
        step = (k * 37 + shift * 11) % 101
        counts = tuple(float(v) for v in (max(0, step % 5 - 3), max(0, step % 7 - 5), max(0, step % 4 - 2) if k % 2 else 0))
        stars = 1.0 + (step * 3 + k) % 9 / 2
        grade = float(1 + (k * 7 + step) % 5)
        label = int(grade <= 2 or sum(counts) > 0)
        rows.append(
            (
                f"P-{k:05d}", f"Provider no. {k}", regions[step % 5], f"district {k % 13}", forms[k % 3], holders[step % 4],
                k % 2, grade, *counts, round(min(5.0, stars + 0.1 * (k % 3)), 1),
                12.5 + (step * 13 % 80) / 2, float(60 + step * 29), 35.0 + (step * 17 + k) % 66, sum(counts), label,
            )
        )
    return rows


@pytest.fixture(scope="session")
def features(spark):
    return spark.createDataFrame(feature_rows(), FEATURES).cache()
