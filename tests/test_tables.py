"""Tables in versions: concurrent writers, replacement, old versions."""

import threading

import pytest

from graphloom.operators import sync


def rows(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, values):
    return spark.createDataFrame(values, "k long, v string")


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both read the same version; the second to commit makes its change again on top of the first's."""
    table = sync.Table(spark, str(tmp_path / "t"), ["k"])
    table.write(frame(spark, [(0, "start")]))
    ready, seen = threading.Barrier(2, timeout=60), []

    def writer(name: int) -> None:
        first = True

        def change(base):
            nonlocal first
            seen.append(name)
            if first:
                first = False
                ready.wait()
            return base.unionByName(frame(spark, [(name, "new")]))

        table.commit(change)

    both = [threading.Thread(target=writer, args=(n,)) for n in (1, 2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert rows(table.read()) == [(0, "start"), (1, "new"), (2, "new")] and len(seen) == 3
    assert table._numbers() == [1, 2, 3] and rows(table.read(1)) == [(0, "start")]


def test_conflicts_end(spark, tmp_path, monkeypatch):
    table = sync.Table(spark, str(tmp_path / "t"), ["k"])
    monkeypatch.setattr(table, "TRIES", 2)
    monkeypatch.setattr(table, "_put", lambda n, entry: False)
    with pytest.raises(sync.Conflict):
        table.write(frame(spark, [(1, "a")]))
    assert table.read() is None


def test_replace_merge_delete_and_vacuum(spark, tmp_path):
    table = sync.Table(spark, str(tmp_path / "t"), ["k", "v"])
    table.replace("k", frame(spark, [(1, "a"), (1, "b"), (2, "c")]))
    table.replace("k", frame(spark, [(1, "z")]))
    assert rows(table.read()) == [(1, "z"), (2, "c")]
    table.merge(frame(spark, [(3, "d"), (2, "c")]))
    assert table.delete(frame(spark, [(1, "z")])) == 1 and table.delete(frame(spark, [(9, "z")])) == 0
    assert rows(table.read()) == [(2, "c"), (3, "d")]
    assert table.vacuum(keep=1) == 3 and table.vacuum(keep=1) == 0 and rows(table.read()) == [(2, "c"), (3, "d")]
