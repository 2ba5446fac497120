"""Several tables by one commit: readers of a snapshot, failures between writes, conflicts, folders that pile up."""

import pytest

from threadwell.operators import snapshots, storage
from threadwell.operators.snapshots import Snapshot, Tables


@pytest.fixture
def tables(spark, tmp_path):
    schema = spark.createDataFrame([], "session_id string, n int").schema
    return Tables(spark, str(tmp_path / "t"), {"a": schema, "b": schema}, buckets=3)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "session_id string, n int")


def seen(tables, at=None):
    at = tables.latest() if at is None else at
    return tuple(sorted(map(tuple, tables.read(n, at).collect()), key=str) for n in ("a", "b"))


def test_readers_see_all_of_a_change_or_none(spark, tables, monkeypatch):
    assert seen(tables) == ([], []) and tables.latest() == Snapshot()
    first = tables.change()
    first.append("a", frame(spark, ("x", 1), ("y", 2), (None, 3)))
    first.append("b", frame(spark, ("x", 10)))
    assert seen(tables) == ([], [])
    old = first.commit()
    was = ([("x", 1), ("y", 2), (None, 3)], [("x", 10)])
    assert seen(tables) == (sorted(was[0], key=str), was[1])

    def change():
        c = tables.change()
        c.replace("a", frame(spark, ("x", 7)), frame(spark, ("x", 0), (None, 0)))
        c.replace("b", None, frame(spark, ("x", 0)))
        c.mark("index", 5)
        return c.commit()

    write, put = snapshots.Change._write, storage.put_text
    for failing in ("a", "b", "commit"):
        with monkeypatch.context() as m:

            def broken(self, name, *rest, failing=failing):
                out = write(self, name, *rest)
                if name == failing:
                    raise OSError("lost")
                return out

            m.setattr(snapshots.Change, "_write", broken)
            if failing == "commit":
                m.setattr(storage, "put_text", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError, match="lost"):
                change()
        assert seen(tables) == (sorted(was[0], key=str), was[1])
    assert storage.put_text is put
    new = change()
    assert seen(tables) == ([("x", 7), ("y", 2)], []) and new.marks == {"index": 5}
    assert seen(tables, old) == (sorted(was[0], key=str), was[1])  # who holds the old one still reads it
    assert len(storage.names(spark, f"{tables.root}/a")) > 2
    assert [s.version for s in tables.sweep(keep=2)] == [1, 2]
    assert len(storage.names(spark, f"{tables.root}/a")) == 2  # what failed has gone
    assert seen(tables, old) == (sorted(was[0], key=str), was[1])
    tables.sweep(keep=1)
    assert seen(tables) == ([("x", 7), ("y", 2)], [])


def test_the_second_of_two_changes_fails(spark, tables):
    one, two = tables.change(), tables.change()
    one.append("a", frame(spark, ("x", 1)))
    two.append("a", frame(spark, ("y", 2)))
    one.commit()
    with pytest.raises(FileExistsError):
        two.commit()
    assert seen(tables) == ([("x", 1)], [])
    again = tables.change()
    again.clear("a")
    again.commit()
    assert seen(tables) == ([], [])


def test_folders_do_not_pile_up(spark, tables, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_FOLDERS", 3)
    for i in range(8):
        c = tables.change()
        c.append("a", frame(spark, ("x", i), ("y", -i)))
        c.commit()
        assert all(len(f) <= 3 for f in tables.latest().tables["a"].values())
    tables.sweep(keep=1)
    assert sorted(seen(tables)[0]) == sorted([("x", i) for i in range(8)] + [("y", -i) for i in range(8)])
    assert len(storage.names(spark, f"{tables.root}/a")) <= 6
