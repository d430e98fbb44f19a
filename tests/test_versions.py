"""The versioned store: readers always see a whole version, wherever a writer is stopped; streams that resume."""

import datetime
from collections import Counter

import pytest

from barline.sources.versions import Conflict, VersionedStore
from barline.streaming import bars as stream

SCHEMA = "symbol string, grp string, date date, close double"
DAY = datetime.date(2020, 12, 28)


def day(k):
    return DAY + datetime.timedelta(days=k)


def rows(spark, *held):
    return spark.createDataFrame([(s, g, day(k), float(v)) for s, g, k, v in held], SCHEMA)


def seen(df):
    return Counter((r.symbol, r.grp, (r.date - DAY).days, r.close) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return VersionedStore(spark, f"file://{tmp_path}/bars", SCHEMA)


def test_a_table_that_was_never_written_is_empty(store):
    assert store.read().collect() == [] and store.versions() == [] and store.vacuum() == []


def test_merge_rewrites_only_what_it_touches(spark, store):
    assert store.merge(rows(spark, ("A", "x", 0, 1), ("A", "x", 10, 1), ("B", "y y/z", 0, 1), ("C", None, 0, 1))) == 1
    before = set(store.entry()["folders"])
    assert len(before) == 4  # A in two years
    store.merge(rows(spark, ("A", "x", 10, 2), ("A", "x", 11, 3)))
    after = set(store.entry()["folders"])
    assert len(before & after) == 3 and seen(store.read()) == Counter([("A", "x", 0, 1.0), ("A", "x", 10, 2.0), ("A", "x", 11, 3.0), ("B", "y y/z", 0, 1.0), ("C", None, 0, 1.0)])
    assert seen(store.read(1)) == Counter([("A", "x", 0, 1.0), ("A", "x", 10, 1.0), ("B", "y y/z", 0, 1.0), ("C", None, 0, 1.0)])
    store.merge(rows(spark, ("C", None, 0, 9), ("B", "y y/z", 0, 8), ("B", "y y/z", 0, 8)))
    assert seen(store.read())[("C", None, 0, 9.0)] == 1 and sum(seen(store.read()).values()) == 5


def test_a_symbol_that_changes_its_group_takes_its_rows_along(spark, store):
    store.merge(rows(spark, ("A", "x", 0, 1), ("A", "x", 10, 1), ("B", "x", 0, 1)))
    store.merge(rows(spark, ("A", "y", 11, 2)))
    assert seen(store.read()) == Counter([("A", "y", 0, 1.0), ("A", "y", 10, 1.0), ("A", "y", 11, 2.0), ("B", "x", 0, 1.0)])
    assert store.read().where("grp = 'y' and symbol = 'A'").count() == 3


class Stopped(Exception):
    pass


@pytest.mark.parametrize("step", ["write_folders", "commit", "after"])
def test_readers_see_a_whole_version_wherever_a_writer_stops(spark, store, monkeypatch, step):
    store.merge(rows(spark, ("A", "x", 0, 1), ("B", "x", 0, 1)))
    real = {n: getattr(VersionedStore, n) for n in ("write_folders", "commit")}

    def stopping(name):
        def run(self, *a):
            if name == step:
                raise Stopped
            out = real[name](self, *a)
            if step == "after" and name == "write_folders":
                raise Stopped
            return out

        return run

    for name in real:
        monkeypatch.setattr(VersionedStore, name, stopping(name))
    with pytest.raises(Stopped):
        store.merge(rows(spark, ("A", "x", 0, 5), ("A", "x", 1, 5)))
    monkeypatch.undo()
    assert seen(store.read()) == Counter([("A", "x", 0, 1.0), ("B", "x", 0, 1.0)])
    left = {s.getPath().getName() for s in store.files.listStatus(store.path(f"{store.root}/data"))}
    assert set(store.vacuum()) == left - {f.split("/")[0] for f in store.entry()["folders"]}
    store.merge(rows(spark, ("A", "x", 0, 5), ("A", "x", 1, 5)))
    assert seen(store.read()) == Counter([("A", "x", 0, 5.0), ("A", "x", 1, 5.0), ("B", "x", 0, 1.0)])


def test_two_writers_of_one_version(spark, store):
    store.replace(rows(spark, ("A", "x", 0, 1)))
    with pytest.raises(Conflict):
        store.commit(1, [], {})
    assert len(seen(store.read())) == 1


def test_old_versions_go_and_readers_of_kept_ones_stay_right(spark, store):
    for k in range(4):
        store.replace(rows(spark, ("A", "x", 0, k)))
    assert len(store.vacuum(keep=2)) == 2 and store.versions() == [3, 4]
    assert [next(iter(seen(store.read(v))))[3] for v in (3, 4)] == [2.0, 3.0]


def ticks(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_a_stream_resumes_and_drops_what_is_too_late(spark, store, tmp_path, monkeypatch):
    folder, state = tmp_path / "in", f"file://{tmp_path}/state"
    put = lambda n, *held: rows(spark, *held).coalesce(1).write.mode("append").parquet(str(folder))
    put(1, ("A", "x", 20, 1), ("A", "x", 1, 1))
    stream.merge_stream(ticks(spark, folder), store, state)
    assert store.entry()["version"] == 1
    put(2, ("A", "x", 21, 2), ("A", "x", 14, 2), ("A", "x", 12, 9))  # 12 is over seven days before 20
    real = VersionedStore.merge
    read = []
    monkeypatch.setattr(VersionedStore, "merge", lambda self, batch, *a, **k: read.append(batch.count()) or real(self, batch, *a, **k))
    stream.merge_stream(ticks(spark, folder), store, state)
    assert read == [2]  # the first file was not read again
    assert {(k, v) for _, _, k, v in seen(store.read())} == {(1, 1.0), (20, 1.0), (21, 2.0), (14, 2.0)}
    assert store.notes()["late"] == 1
    stream.merge_stream(ticks(spark, folder), store, state)
    assert store.entry()["version"] == 2


def test_a_batch_that_comes_again_is_not_merged_twice(spark, store, tmp_path, monkeypatch):
    folder, state = tmp_path / "in", f"file://{tmp_path}/state"
    rows(spark, ("A", "x", 0, 1)).coalesce(1).write.parquet(str(folder))
    real = VersionedStore.merge

    def merge(self, *a, **k):
        real(self, *a, **k)
        raise Stopped  # the store has the batch, the stream does not know

    monkeypatch.setattr(VersionedStore, "merge", merge)
    with pytest.raises(Exception):  # noqa: B017 - Spark wraps it
        stream.merge_stream(ticks(spark, folder), store, state)
    monkeypatch.undo()
    stream.merge_stream(ticks(spark, folder), store, state)
    assert store.entry()["version"] == 1 and len(seen(store.read())) == 1
