"""Loads appended to a star: what is ignored, what is refused, what readers see meanwhile."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from shelflight import snapshots
from shelflight.operators import profile
from shelflight.operators.quality import KeyViolation
from shelflight.plans.load import append_records
from shelflight.plans.stock_health import movement, movement_from_counts
from shelflight.schemas import TABLES
from shelflight.sources.csv_records import write_records
from tests.conftest import DAY, days


def rows_of(star):
    return {name: sorted(map(str, star.table(name).collect())) for name in TABLES}


def later(day, *pairs, **common):
    shifted = days(pairs, **common)
    return [{**row, "record_date": row["record_date"] + dt.timedelta(days=day)} for row in shifted]


def test_loads_equal_a_single_load(spark, staging_of, tmp_path):
    first = later(0, (10, 5), (11, 5)) + later(0, (9, 1), product_id="P2", category="Food")
    second = later(2, (12, 5)) + later(2, (7, 7), product_id="P3", region="South", seasonality="Summer")
    third = later(4, (3, 1), (4, 1))
    folder = str(tmp_path / "star")
    for at, load in enumerate((first, second, third), 1):
        snapshot, _ = snapshots.append(spark, staging_of(load), folder)
        assert snapshot.number == at
    whole, _ = snapshots.append(spark, staging_of(first + second + third), str(tmp_path / "whole"))
    assert rows_of(snapshots.latest(spark, folder).star(spark)) == rows_of(whole.star(spark))
    # Older snapshots stay as they were.
    assert snapshots.latest(spark, folder, 1).star(spark).inventory.count() == 3


def test_stored_keys_win(spark, staging_of, tmp_path):
    folder = str(tmp_path / "star")
    first, _ = snapshots.append(spark, staging_of(later(0, (10, 5), category="Toys")), folder)
    again = later(0, (99, 9), (98, 9), category="Food", price="1", weather_condition="Rainy")
    found, conflicts = snapshots.append(spark, staging_of(again), folder, ignore_inventory=True)
    star = found.star(spark)
    assert [r.category for r in star.products.collect()] == ["Toys"]
    assert sorted(r.inventory_level for r in star.inventory.collect()) == [10, 98]
    assert sorted(float(r.price) for r in star.pricing.collect()) == [1, 10]
    assert sorted(r.weather_condition for r in star.store_events.collect()) == ["Rainy", "Sunny"]
    counts = {r.table_name: tuple(r)[1:] for r in conflicts.collect()}
    assert counts["inventory"] == counts["pricing"] == (2, 0, 0, 1, 1)
    assert counts["products"] == (1, 0, 0, 1, 0)


def test_repeats_and_missing_keys_of_a_load(spark, staging_of, tmp_path):
    rows = later(0, (10, 5)) + later(0, (8, 5)) + later(0, (1, 1), product_id=None)
    folder = str(tmp_path / "star")
    with pytest.raises(KeyViolation):
        snapshots.append(spark, staging_of(rows), folder)
    found, conflicts = snapshots.append(spark, staging_of(rows), folder, ignore_inventory=True)
    assert found.number == 1
    assert [r.inventory_level for r in found.star(spark).inventory.collect()] == [8]
    counts = {r.table_name: tuple(r)[1:] for r in conflicts.collect()}
    assert counts["inventory"] == (3, 1, 1, 0, 1)


def test_a_stored_inventory_key_fails_the_load(spark, staging_of, tmp_path):
    folder = str(tmp_path / "star")
    snapshots.append(spark, staging_of(later(0, (10, 5))), folder)
    with pytest.raises(KeyViolation, match="stored"):
        snapshots.append(spark, staging_of(later(0, (10, 5), (11, 5))), folder)
    assert snapshots.latest(spark, folder).number == 1
    assert snapshots.latest(spark, folder).star(spark).pricing.count() == 1


def test_a_broken_load_leaves_the_old_snapshot(spark, staging_of, tmp_path, monkeypatch):
    folder = str(tmp_path / "star")
    snapshots.append(spark, staging_of(later(0, (10, 5))), folder)
    before = rows_of(snapshots.latest(spark, folder).star(spark))
    for broken in ("_publish", "_write_part"):
        usual = getattr(snapshots, broken)
        calls = []

        def fail(*given, usual=usual, calls=calls, broken=broken):
            calls.append(given)
            if broken == "_publish" or len(calls) == 4:
                raise OSError("lost")
            return usual(*given)

        monkeypatch.setattr(snapshots, broken, fail)
        with pytest.raises(OSError):
            snapshots.append(spark, staging_of(later(1, (1, 1))), folder)
        monkeypatch.setattr(snapshots, broken, usual)
        assert rows_of(snapshots.latest(spark, folder).star(spark)) == before
    found, _ = snapshots.append(spark, staging_of(later(1, (1, 1))), folder)
    assert found.number == 2 and found.star(spark).inventory.count() == 2


def test_one_load_at_a_time(spark, staging_of, tmp_path):
    folder = str(tmp_path / "star")
    with snapshots._claimed(spark, folder), pytest.raises(snapshots.LoadClaimed):
        snapshots.append(spark, staging_of(later(0, (10, 5))), folder)
    with snapshots._claimed(spark, folder):
        snapshots.release(spark, folder)
        assert snapshots.append(spark, staging_of(later(0, (10, 5))), folder)[0].number == 1


def test_stored_parts_of_other_dates_are_not_read(spark, staging_of, tmp_path):
    folder = str(tmp_path / "star")
    for day in (0, 10, 20):
        snapshots.append(spark, staging_of(later(day, (10, 5), (11, 5))), folder)
    snapshot = snapshots.latest(spark, folder)

    def files(first, last):
        rows = snapshot.table(spark, "inventory", *[DAY + dt.timedelta(days=d) for d in (first, last)])
        return len(rows.inputFiles()), rows.count()

    assert files(10, 11) == (1, 2)
    assert files(1, 10) == (2, 2)
    assert files(30, 40)[1] == 0
    assert sum("/parts/inventory/" in f for f in snapshot.star(spark).inventory.inputFiles()) == 3
    added = snapshots._added(spark, snapshot.table(spark, "inventory"), snapshot, "inventory",
                             (DAY + dt.timedelta(days=30), DAY + dt.timedelta(days=31)))
    assert "Join" not in added._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_appended_from_raw_files(spark, staging_of, tmp_path):
    folder = str(tmp_path / "star")
    for at, day in enumerate((0, 5)):
        path = str(tmp_path / f"raw{at}")
        write_records(staging_of(later(day, (10, 5), (11, 5))), path)
        star, conflicts = append_records(spark, path, folder, tolerant=bool(at))
    assert star.inventory.count() == 4
    assert {r.table_name: r.added for r in conflicts.collect()}["products"] == 0


def movements(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("merged", [16, 2])
def test_counts_of_loads_give_the_movement(spark, staging_of, tmp_path, monkeypatch, merged):
    monkeypatch.setattr(snapshots, "MERGED_PARTS", merged)
    folder = str(tmp_path / "star")
    draw = random.Random(merged)
    for day in (0, 30, 60, 90):
        rows = []
        for product in ("P1", "P2", "P3"):
            pairs = [(draw.choice([None, *range(30)]), draw.choice([None, *range(9)])) for _ in range(30)]
            rows += later(day, *(pairs if product != "P3" else [(None, 1)] * 30), product_id=product)
        snapshot, _ = snapshots.append(spark, staging_of(rows), folder)
    parts = [p for p in snapshot.parts if p.table_name == "net_counts"]
    assert len(parts) == (4 if merged == 16 else 1)
    counts = snapshot.net_counts(spark)
    found = movement_from_counts(counts, sigma=0.5, percent=20)
    assert movements(found) == movements(movement(snapshot.star(spark), sigma=0.5, percent=20))
    # No record is read, and a load counts its own records only.
    assert all("/parts/net_counts/" in file for file in found.inputFiles() if "/parts/" in file)


def test_a_load_counts_its_own_records_only(spark, staging_of, tmp_path, monkeypatch):
    folder, read = str(tmp_path / "star"), []
    usual = profile.net_counts
    monkeypatch.setattr(
        profile, "net_counts", lambda rows: read.append((len(rows.inputFiles()), rows.count())) or usual(rows)
    )
    for day in (0, 10, 20):
        snapshots.append(spark, staging_of(later(day, (10, 5), (11, 5))), folder)
    assert read == [(1, 2)] * 3
