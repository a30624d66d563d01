from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clicksieve.schemas import BID_LOGS  # noqa: E402
from clicksieve.session import local_session  # noqa: E402

START = datetime(2024, 1, 30)
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_logs(spark):
    """Logs from (address, milliseconds since midnight[, overrides]) tuples."""

    def build(events):
        rows = []
        for number, (ip, at, *rest) in enumerate(events):
            row = dict.fromkeys(BID_LOGS.fieldNames())
            row.update(
                bid_request_id=f"r{number}", timestamp=START + timedelta(milliseconds=at), ip_address=ip,
                user_agent="ua", campaign_id="c", publisher_id="p", country_code="US", device_type="mobile",
                event_type="click",
            )
            row.update(*rest)
            rows.append(tuple(row[name] for name in BID_LOGS.fieldNames()))
        return spark.createDataFrame(rows, BID_LOGS)

    return build


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
