import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from armspark.session import build_session
from armspark.spec import ExperimentSpec

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def spec():
    return ExperimentSpec()


@pytest.fixture(scope="session")
def units(spark):
    """A contract table with every category and a planted visit effect."""
    rng = np.random.default_rng(3)
    n = 1200
    arm = rng.choice(["Mens E-Mail", "Womens E-Mail", "No E-Mail"], n)
    treated = arm != "No E-Mail"
    visit = rng.random(n) < 0.15 + 0.15 * treated
    conversion = visit & (rng.random(n) < 0.4)
    pdf = pd.DataFrame(
        {
            "unit_id": np.arange(n) * 3 + 7,
            "recency": rng.integers(1, 13, n),
            "history_segment": rng.choice(["1) $0 - $100", "7) $1,000 +"], n),
            "history": np.round(rng.gamma(2, 100, n), 2),
            "mens": rng.integers(0, 2, n),
            "womens": rng.integers(0, 2, n),
            "zip_code": rng.choice(["Urban", "Suburban", "Rural"], n),
            "newbie": rng.integers(0, 2, n),
            "channel": rng.choice(["Phone", "Web", "Multichannel"], n),
            "segment": arm,
            "visit": visit.astype(int),
            "conversion": conversion.astype(int),
            "spend": np.where(conversion, np.round(rng.gamma(2, 30, n), 2), 0.0),
            "treatment": treated.astype(int),
        }
    )
    return spark.createDataFrame(pdf)


def scored_frame(n=600, seed=11, hot=0.35):
    """Units with a tied, a continuous, a hot-tie and a partly missing score."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "unit_id": rng.permutation(n * 4)[:n].astype("int64"),
            "treatment": (rng.random(n) < 0.66).astype(int),
            "visit": (rng.random(n) < 0.3).astype(int),
            "conversion": (rng.random(n) < 0.1).astype(int),
            "tied": rng.integers(0, 12, n) / 10.0,
            "smooth": rng.normal(size=n),
        }
    )
    pdf["hot"] = np.where(rng.random(n) < hot, 0.5, rng.random(n))
    pdf["gaps"] = np.where(rng.random(n) < 0.3, np.nan, rng.random(n))
    return pdf


SCORE_COLUMNS = {"Tied": "tied", "Smooth": "smooth", "Hot": "hot", "Gaps": "gaps"}


def ordered(pdf, column):
    """The reference order: score descending (missing last), key ascending."""
    score = pdf[column].fillna(-np.inf)
    return pdf.assign(score=score).sort_values(["score", "unit_id"], ascending=[False, True])
