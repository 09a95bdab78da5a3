"""The versioned bar table and the snapshot catalogue: repeats, late rows, failed writes, and what a batch reads."""

import datetime as dt

import pytest

from orrery.sources import catalogue
from orrery.streaming import ingest

BAR = "symbol string, date date, close double"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def bars(spark, *rows):
    return spark.createDataFrame([(s, day(n), float(n)) for s, n in rows], BAR)


def dates(frame):
    return sorted((r.symbol, (r.date - day(0)).days) for r in frame.collect())


def test_three_batches_with_a_repeat_and_late_rows(spark):
    first = bars(spark, ("A", 3), ("A", 4), ("B", 40), ("NEW", 4))
    last = bars(spark, ("A", 41), ("C", 20), ("C", 35), ("C", 42), ("A", 4))
    got = ingest.replay(bars(spark, ("A", 3), ("B", 1), ("C", 2)), [first, first, last])
    # C's day 20 is behind the watermark (day 40 less ten), its day 35 is not
    assert dates(got) == [("A", 3), ("A", 4), ("A", 41), ("B", 1), ("B", 40), ("C", 2), ("C", 35), ("C", 42)]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "bars")
    ingest.create(bars(spark, ("A", 1), ("BRK.B", 1)), table)
    batch = bars(spark, ("A", 2), ("BRK-B", 2), ("A", 1))
    for number in (0, 0, 1):
        ingest.append_new(batch, table, "s", number)
    assert dates(ingest.stored_bars(spark, table)) == [("A", 1), ("A", 2), ("BRK.B", 1), ("BRK.B", 2)]
    assert [v[0] for v in ingest.versions(spark, table)] == [0, 1, 2]
    ingest.append_new(bars(spark, ("A", 3)), table, "other", 0)  # another stream's batch 0 is another batch
    assert dates(ingest.last_dates(spark, table).withColumnRenamed("last", "date")) == [("A", 3), ("BRK.B", 2)]


def test_a_failed_batch_is_written_again(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "bars")
    ingest.create(bars(spark, ("A", 1)), table)

    def fail(*a):
        raise OSError("lost before it was published")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(catalogue, "publish", fail)
        ingest.append_new(bars(spark, ("A", 2), ("A", 3)), table, "s", 0)
    assert dates(ingest.stored_bars(spark, table)) == [("A", 1)]
    ingest.append_new(bars(spark, ("A", 2)), table, "s", 0)
    assert dates(ingest.stored_bars(spark, table)) == [("A", 1), ("A", 2)]


def test_a_batch_reads_last_dates_only(spark, tmp_path):
    table = str(tmp_path / "bars")
    ingest.create(bars(spark, ("A", 1)), table)
    batch = spark.read.schema(BAR).parquet(_written(bars(spark, ("A", 2)), tmp_path / "incoming"))
    files = ingest.new_rows(ingest.last_dates(spark, table), batch).inputFiles()
    assert any("/ends/" in f for f in files) and not any("/bars/version" in f for f in files)


def _written(frame, path):
    frame.write.parquet(str(path))
    return str(path)


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "scores")
    assert catalogue.snapshot(spark, path) is None
    write = lambda x, as_of: catalogue.publish_snapshot(spark.createDataFrame([(x, "g")], "x int, g string"), path, as_of, "g")
    for x, as_of in ((1, "2024-05-01"), (2, "2024-05-03"), (3, "2024-05-05"), (4, "2024-05-03")):
        write(x, as_of)
    # a write that did not end: files, but no label
    spark.createDataFrame([(9, "g")], "x int, g string").write.parquet(f"{path}/as_of=2024-05-09/run=broken")

    def pick(**k):
        found = catalogue.snapshot(spark, path, **k)
        return [] if found is None else [(r.x, str(r.as_of)) for r in found.collect()]

    assert pick() == [(3, "2024-05-05")]
    assert pick(upto="2024-05-04") == pick(before="2024-05-05") == pick(upto="2024-05-03", exact=True) == [(4, "2024-05-03")]
    assert pick(upto="2024-05-04", exact=True) == pick(before="2024-05-01") == pick(upto="2024-05-09", exact=True) == []
    files = catalogue.snapshot(spark, path).inputFiles()
    assert files and all("as_of=2024-05-05" in f for f in files)
    with pytest.raises(Exception, match="exist"):
        catalogue.publish(spark, path, catalogue.published(spark, path)[0])
