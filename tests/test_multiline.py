"""Records with line breaks inside quotes, over byte ranges of every size."""

from __future__ import annotations

import csv
import io
import random
import uuid

import pytest

from shelflight import load_star
from shelflight.sources import multiline
from shelflight.sources.csv_records import read_strict, read_tolerant
from shelflight.sources.multiline import records
from tests.test_load import GOOD, HEADER


def write(tmp_path, text, name="records.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


@pytest.fixture
def ranges(spark):
    """Cut files into ranges of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def cut(size):
        for name in names:
            spark.conf.set(name, str(size))

    yield cut
    for name in names:
        spark.conf.unset(name)


def made(seed, count):
    """Records and their text, with quotes, breaks and breaks beside quotes in the fields."""
    draw = random.Random(seed)
    fields = ["a", "", "x y", 'q"', '"', "one\ntwo", "\n", "\n\n\n", 'a"\n"b', "r\r\nn", "é,\n", "\n" * 9]
    rows = [[draw.choice(fields) for _ in range(4)] + [str(i)] for i in range(count)]
    text = io.StringIO()
    csv.writer(text, lineterminator=draw.choice(["\n", "\r\n"])).writerows(rows)
    return rows, "a,b,c,d,e\n" + text.getvalue()


@pytest.mark.parametrize("size", [1 << 20, 700, 97, 31])
@pytest.mark.parametrize("seed", [1, 2])
def test_every_range_finds_its_records(spark, tmp_path, ranges, size, seed):
    """Breaks and quotes fall on range edges everywhere; some ranges hold no record start."""
    rows, text = made(seed, 60)
    path = write(tmp_path, text)
    ranges(size)
    found = [r.record for r in records(spark, path).collect()]
    parsed = sorted((next(csv.reader(io.StringIO(r, newline=""))) for r in found), key=lambda r: int(r[-1]))
    assert parsed == rows
    if size < 1000:
        assert multiline._lines(spark, path).rdd.getNumPartitions() > 2


def test_files_do_not_meet(spark, tmp_path, ranges):
    ranges(50)
    expected = []
    for at in range(3):
        rows, text = made(at, 12)
        write(tmp_path, text, f"part{at}.csv")
        expected += [",".join(r) for r in rows]
    found = records(spark, str(tmp_path)).collect()
    parsed = [",".join(next(csv.reader(io.StringIO(r.record, newline="")))) for r in found]
    assert sorted(parsed) == sorted(expected)


def test_breaks_stay_in_their_fields(spark, tmp_path):
    line = GOOD.replace("Toys", '"Toys,\n""big""\r\n"').replace("Rainy", '"\n"')
    path = write(tmp_path, "\r\n".join([HEADER, line, "", GOOD.replace("P0001", "P0002"), ""]))
    rows = {r.product_id: r for r in read_strict(spark, path, multiline=True).collect()}
    assert rows["P0001"].category == 'Toys,\n"big"\r\n' and rows["P0001"].weather_condition == "\n"
    assert rows["P0002"].category == "Toys" and rows["P0002"].seasonality == "Autumn"
    star = load_star(spark, path, str(tmp_path / "star"), multiline=True)
    assert star.inventory.count() == 2


def test_wrong_records_are_set_aside_whole(spark, tmp_path):
    wrong = GOOD.replace("2022-01-01", "soon").replace("Toys", '"Toys\nand"')
    path = write(tmp_path, "\n".join([HEADER, wrong, GOOD]) + "\n")
    accepted, rejected = read_tolerant(spark, path, multiline=True)
    assert accepted.count() == 1
    assert [r.rejected_line.count("\n") for r in rejected.collect()] == [1]


def test_an_open_quote_fails(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(multiline, "MAX_LINES", 20)
    path = write(tmp_path, "\n".join([HEADER, GOOD.replace("Toys", '"Toys'), *[GOOD] * 30]))
    with pytest.raises(ValueError, match="not closed"):
        read_tolerant(spark, path, multiline=True)


def test_empty_files(spark, tmp_path):
    for name, text in (("a.csv", ""), ("b.csv", HEADER), ("c.csv", HEADER + "\n")):
        assert read_strict(spark, write(tmp_path, text, name), multiline=True).collect() == []


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_lines_are_read_twice_and_not_shuffled(spark, tmp_path, ranges, size):
    """Once to sum up the ranges, once for the records; only pieces at the edges of ranges move."""
    rows, text = made(5, 80)
    path = write(tmp_path, text)
    ranges(size)
    counts = tmp_path / "counts"
    counts.mkdir()
    first = multiline._lines

    def counted(*given):
        def note(batches):
            for batch in batches:
                with open(counts / uuid.uuid4().hex, "w") as file:
                    file.write(str(batch.num_rows))
                yield batch

        found = first(*given)
        return found.mapInArrow(note, found.schema)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(multiline, "_lines", counted)
        found = records(spark, path)
        assert len(found.collect()) == len(rows)
    lines = text.count("\n")
    assert sum(int(file.read_text()) for file in counts.iterdir()) == 2 * lines


def test_long_records_at_and_over_the_limit(spark, tmp_path, ranges, monkeypatch):
    """Counted across ranges as within them; the header does not count."""
    monkeypatch.setattr(multiline, "MAX_LINES", 12)
    for size in (1 << 20, 40, 9):
        ranges(size)
        for lines, fits in ((12, True), (13, False)):
            body = '"' + "x\n" * (lines - 1) + '",b'
            path = write(tmp_path, '"h' + "\n" * 30 + f'",c\na,b\n{body}\nc,d\n', f"r{size}-{lines}.csv")
            if fits:
                assert sorted(r.record for r in records(spark, path).collect()) == sorted(["a,b", body, "c,d"])
            else:
                with pytest.raises(ValueError, match="13 lines"):
                    records(spark, path)
