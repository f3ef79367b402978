from __future__ import annotations

import datetime as dt
import itertools
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelflight import schemas  # noqa: E402
from shelflight.operators import normalize  # noqa: E402
from shelflight.session import local_session  # noqa: E402

DAY = dt.date(2022, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("spark")
    session = local_session(
        8,
        **{
            "spark.checkpoint.dir": str(work / "shared"),
            "spark.sql.warehouse.dir": str(work / "warehouse"),
            "spark.sql.shuffle.partitions": "4",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def staging_of(spark):
    """Build staging rows from dicts; unnamed columns get a plain value."""
    plain = {
        "record_date": DAY,
        "store_id": "S1",
        "product_id": "P1",
        "category": "Toys",
        "region": "North",
        "inventory_level": 10,
        "units_sold": 5,
        "units_ordered": 1,
        "demand_forecast": "5",
        "price": "10",
        "discount": "0",
        "weather_condition": "Sunny",
        "holiday_promotion": False,
        "competitor_pricing": "10",
        "seasonality": "Winter",
    }
    text = {"demand_forecast", "price", "discount", "competitor_pricing"}

    def build(rows):
        names = list(plain)
        kinds = {f.name: f.dataType.simpleString() for f in schemas.STAGING}
        ddl = ", ".join(f"{n} {'string' if n in text else kinds[n]}" for n in names)
        data = [tuple({**plain, **row}[n] for n in names) for row in rows]
        frame = spark.createDataFrame(data, ddl)
        return frame.selectExpr("*", "concat(store_id, '_', region) as store_region_id").select(
            *[frame_col(f) for f in schemas.STAGING]
        )

    def frame_col(field):
        from pyspark.sql import functions as F

        return F.col(field.name).cast(field.dataType).alias(field.name)

    return build


@pytest.fixture(scope="session")
def star_of(staging_of):
    return lambda rows: normalize.star(staging_of(rows))


def days(pairs, **common):
    """One record per (inventory, sold) pair on consecutive days."""
    return [
        {
            "record_date": DAY + dt.timedelta(days=i),
            "inventory_level": stock,
            "units_sold": sold,
            **common,
        }
        for i, (stock, sold) in enumerate(pairs)
    ]


def flat(*lists):
    return list(itertools.chain(*lists))
