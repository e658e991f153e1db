"""Both file stores behave alike, and an engine works over Hadoop's client as over local files."""

import pytest
from pyspark.sql import functions as F

from strata.engine import Engine
from strata.errors import CommitConflict, Internal, NotFound
from strata.plans import store as stores
from strata.plans.store import HadoopStore, LocalStore


@pytest.mark.parametrize("kind", ["local", "hadoop"])
def test_files(spark, tmp_path, kind):
    s = LocalStore(str(tmp_path)) if kind == "local" else HadoopStore(spark, f"file://{tmp_path}")
    assert s.list("none") == [] and s.walk("none") == [] and not s.exists("a/b")
    s.create("a/b", b"\x00\xffx")
    with pytest.raises(CommitConflict):
        s.create("a/b", b"y")
    with pytest.raises(NotFound):
        s.read("a/c")
    assert s.read("a/b") == b"\x00\xffx"
    s.rename("a/b", "d/p=1%2A/e")
    assert s.list("") == ["a", "d"] and [p for p, _ in s.walk("d") if "/." not in p] == ["d/p=1%2A/e"]
    s.delete("d")
    s.delete("d")
    assert not s.exists("d/p=1%2A/e")


def test_engine_over_hadoop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("strata.engine.open_store", lambda s, root: HadoopStore(s, root))
    e = Engine(spark, f"file://{tmp_path}/w")
    e.create_table("t", {"columns": {"a": "int64"}, "partitioning": {"p": "string"}})
    for low in (0, 10):
        e.write("t", spark.range(low, low + 10).select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, "x*").otherwise("y").alias("p")))
    e.delete_where("t", "a % 5 = 0")
    e.compact("t", force=True)
    e.vacuum("t", 0)
    assert sorted(r.a for r in e.table("t").collect()) == [a for a in range(20) if a % 5]
    assert e.list_tables() == {"tables": [{"tableName": "t"}]}
    e.drop_table("t")
    assert e.list_tables() == {"tables": []}


def test_roots(spark, tmp_path):
    assert stores.open_store(spark, f"file://{tmp_path}/a%20b").root == f"{tmp_path}/a b"
    assert isinstance(stores.open_store(spark, str(tmp_path)), LocalStore)


def test_hadoop_renames_are_checked_and_files_appear_whole(spark, tmp_path, monkeypatch):
    s = HadoopStore(spark, f"file://{tmp_path}")
    s.create("a", b"1")

    class Files:  # Hadoop's clients mostly answer so, and raise nothing
        def mkdirs(self, _):
            return True

        def rename(self, *_):
            return False

    with monkeypatch.context() as m, pytest.raises(Internal):
        m.setattr(s, "fs", Files())
        s.rename("a", "there")

    class Context:
        def rename(self, *_):
            raise KeyboardInterrupt

    monkeypatch.setattr(s, "context", Context())
    with pytest.raises(KeyboardInterrupt):
        s.create("b", b"2")
    assert [n for n in s.list("") if not n.startswith(".")] == ["a"]
