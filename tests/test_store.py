"""The versioned store end to end."""

import pytest

from grovelake.model import MergeConflict, NotFound, StoreError
from grovelake.operators import merge
from grovelake.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def content(df):
    return {bytes(r.key).decode(): bytes(r.value).decode() for r in df.collect()}


def test_commits_history_and_time_travel(store):
    store.insert({"a": "1", "b": "1"})
    assert store.get("a") == b"1" and {r.status for r in store.status().collect()} == {"added"}
    one = store.commit("one")
    store.insert({"a": "2"})
    store.delete(["b", "absent"])
    two = store.commit("two")
    assert content(store.at(one)) == {"a": "1", "b": "1"} and content(store.at(two[:8])) == {"a": "2"}
    assert [(r.op, bytes(r.key)) for r in store.diff(one, two).collect()] == [("modified", b"a"), ("removed", b"b")]
    assert [r.value and bytes(r.value) for r in store.key_history("a").collect()] == [b"2", b"1"]
    assert [c["message"] for c in store.log()] == ["two", "one", "Initial commit"]
    store.revert(two)
    assert content(store.at()) == {"a": "1", "b": "1"}
    assert store.log()[0]["message"] == 'Revert "two"'
    assert store.root_hash(one) == store.root_hash() != store.root_hash(two)
    with pytest.raises(NotFound):
        store.at("nowhere")
    assert store.update({"a": "3", "zz": "3"}) == [b"a"]


def test_branches_merge(store):
    store.insert({"shared": "base"})
    store.commit("base")
    store.create_branch("feature")
    store.insert({"shared": "feature", "feature_only": "f"})
    feature = store.commit("on feature")
    store.checkout("main")
    store.insert({"main_only": "m"})
    store.commit("on main")
    merged = store.merge("feature")
    assert content(store.at()) == {"shared": "feature", "feature_only": "f", "main_only": "m"}
    assert len(store.log()[0]["parents"]) == 2 and store.is_ancestor(feature, merged)
    store.insert({"shared": "x"})
    store.commit("x")
    store.checkout("feature")
    store.insert({"shared": "y"})
    store.commit("y")
    assert store.try_merge("main").count() == 1
    with pytest.raises(MergeConflict):
        store.merge("main")
    store.merge("main", merge.take_source)
    assert content(store.at())["shared"] == "x"
    store.checkout("main")
    assert store.merge("feature") == store.resolve("feature")


def test_namespaces_and_blobs(store):
    store.threshold = 100
    store.insert({"k": "x" * 100})
    store.insert({"k": "y" * 101, "l": "y" * 101}, "big")
    first = store.commit("two namespaces")
    assert store.namespaces() == ["big", "default"] and store.blobs().count() == 1
    assert content(store.at("HEAD", "big"))["l"] == "y" * 101
    store.delete(["k", "l"], "big")
    store.commit("gone")
    assert store.namespace_changed(first, "HEAD", "big") and not store.namespace_changed(first, "HEAD")
    assert store.gc_blobs()["removed"] == 0 and store.gc_blobs("head")["removed"] == 1
    with pytest.raises(StoreError):
        store.delete_namespace("default")
    store.delete_namespace("big")
    assert store.namespaces() == ["default"]


def test_tables_and_sql(store, spark):
    store.create_table("users", "id INT, name STRING")
    store.insert_rows("users", spark.createDataFrame([(1, "a"), (2, "b")], "id INT, name STRING"), "id")
    before = store.resolve()
    store.insert_rows("users", spark.createDataFrame([(2, "c")], "id INT, name STRING"), "id")
    store.update_rows("users", "id = 1", name="upper(name)")
    rows = lambda ref="HEAD": [tuple(r) for r in store.sql("SELECT id, name FROM users ORDER BY id", ref).collect()]
    assert rows() == [(1, "A"), (2, "c")] and rows(before) == [(1, "a"), (2, "b")]
    store.delete_rows("users", "id = 1")
    assert rows() == [(2, "c")]
    with pytest.raises(StoreError):
        store.sql("DROP TABLE users")
    store.drop_table("users")
    assert store.tables() == {} and "users" in store.tables(before)


def test_sessions(store):
    store.add_session("agent", "work")
    store.checkout("work")
    store.insert({"a": "1"})
    store.commit("work")
    store.lock_session("agent", "busy")
    with pytest.raises(StoreError):
        store.lock_session("agent")
    store.unlock_session("agent")
    store.merge_session("agent")
    assert content(store.at("main")) == {"a": "1"}
    store.remove_session("agent")
    assert store.sessions() == {}


def test_limits_reach_the_staging(store):
    with pytest.raises(Exception, match="65536"):
        store.insert({"": "v"})


def test_stream_of_changes(store, spark, tmp_path):
    from grovelake.streaming.ingest import commit_stream

    kind = "key BINARY, value BINARY, is_delete BOOLEAN, seq BIGINT"
    rows = [(bytearray(b"a"), bytearray(b"1"), False, 1), (bytearray(b"a"), bytearray(b"2"), False, 2), (bytearray(b"b"), None, True, 1)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    commit_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/checkpoint").awaitTermination(60)
    assert content(store.at()) == {"a": "2"}


def test_merge_of_tables_by_key(store, spark):
    rows = lambda *xs: spark.createDataFrame(list(xs), "id INT, name STRING")
    store.create_table("t", "id INT, name STRING", "id")
    store.insert_rows("t", rows((1, "a")), "id")
    store.create_branch("work")
    store.insert_rows("t", rows((3, "c")), "id")
    store.checkout("main")
    store.insert_rows("t", rows((2, "b")), "id")
    store.merge("work")
    assert sorted(tuple(r) for r in store.table("t").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    store.update_rows("t", "id = 1", name="'main'")
    store.checkout("work")
    store.update_rows("t", "id = 1", name="'work'")
    store.checkout("main")
    with pytest.raises(MergeConflict):
        store.merge("work")
    store.merge("work", merge.take_source)
    assert ("work",) in [tuple(r) for r in store.sql("SELECT name FROM t WHERE id = 1").collect()]


def test_values_are_put_apart_once(store):
    store.threshold = 50
    store.insert({"a": "x" * 200, "b": "1"})
    store.commit("one")
    store.threshold = 10
    store.insert({"b": "2"})
    store.commit("two")
    assert store.get("a") == b"x" * 200 and store.get("b") == b"2"
    store.create_branch("work")
    store.insert({"c": "y" * 200})
    store.commit("on work")
    store.checkout("main")
    store.insert({"d": "z" * 200})
    store.commit("on main")
    store.merge("work")
    assert {len(r.value) for r in store.at(raw=True).where("key <> 'b'").collect()} == {44}
    assert content(store.at())["c"] == "y" * 200


def test_writers_dont_lose_commits(store, spark):
    other = Store(spark, store.path)
    store.insert({"a": "1"})
    seen = other._refs()["main"]
    store.commit("first")
    with pytest.raises(StoreError):
        other._move("main", "0" * 40, seen)
    assert store.log()[0]["message"] == "first"
    store.files.delete(f"refs.{store.files.versions('refs')[-1]:012d}")  # the newest state is lost: the one before is there
    assert Store(spark, store.path).log()[0]["message"] == "Initial commit"
    for n in store.files.versions("refs"):
        store.files.delete(f"refs.{n:012d}")
    with pytest.raises(StoreError):
        Store(spark, store.path)


def test_only_queries_run_on_a_version(store, spark):
    store.put_table("t", spark.createDataFrame([(1,)], "id INT"))
    spark.sql("SELECT 9 AS id").createOrReplaceTempView("t")
    for query in ("FROM (SELECT 1 AS id) INSERT INTO t SELECT id", "WITH x AS (SELECT 1 AS id) INSERT INTO t SELECT id FROM x", "CREATE TABLE z AS SELECT 1", "DROP VIEW t", "SET a=b"):
        with pytest.raises(StoreError):
            store.sql(query)
    assert store.sql("WITH x AS (SELECT id FROM t) SELECT * FROM x UNION ALL (SELECT id + 1 FROM t)").count() == 2
    assert spark.table("t").first().id == 9
    spark.catalog.dropTempView("t")


def test_a_stream_leaves_what_is_staged_and_knows_its_batches(store, spark, tmp_path):
    from grovelake.streaming.ingest import commit_stream

    kind = "key BINARY, value BINARY, is_delete BOOLEAN, seq BIGINT"
    spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"), False, 1)], kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    store.insert({"mine": "staged"})
    commit_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/c").awaitTermination(60)
    assert content(store.at()) == {"a": "1"} and store.get("mine") == b"staged" and store.last_batch(f"{tmp_path}/c") == 0
    store.commit("mine")
    assert store.last_batch(f"{tmp_path}/c") == 0 and content(store.at()) == {"a": "1", "mine": "staged"}
