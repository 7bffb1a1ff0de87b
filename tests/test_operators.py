"""Operators on small tables: whole decision tables, round trips, properties."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovelake.functions import distance
from grovelake.model import TreeConfig, validated
from grovelake.operators import blobs, diff, kv, merge, merkle, nearest, text, vector
from grovelake.sources import encoding

TINY = TreeConfig(min_chunk=2, max_chunk=16, pattern=0b11)


def frame(spark, items, kind="key STRING, value STRING"):
    return spark.createDataFrame(items, kind)


def as_dict(df):
    return {r.key: r.value for r in df.collect()}


def plan(b, s, d, policy):
    """The decision table, by hand: (op, value) or None."""
    if s == d:
        return None
    if b is not None and s is not None and d is not None:
        return ("modified", s) if b == d else None if b == s else ("conflict", None)
    if b is None:
        return ("added", s) if d is None else None if s is None else ("conflict", None)
    if s is None:
        return ("removed", None) if b == d or policy == "store" else ("conflict", None)
    return None if b == s or policy == "store" else ("conflict", None)


@pytest.mark.parametrize("policy", ["store", "strict"])
def test_merge_matches_the_decision_table(spark, policy):
    cases = list(itertools.product([None, "x", "y", "z"], repeat=3))
    sides = [[(str(i), c[k]) for i, c in enumerate(cases) if c[k] is not None] for k in range(3)]
    got = {r.key: (r.op, r.value) for r in merge.merge3(*(frame(spark, x) for x in sides), policy=policy).collect()}
    want = {str(i): w for i, c in enumerate(cases) if (w := plan(*c, policy))}
    assert got == want


def test_merge_of_empty_tables_and_null_values(spark):
    none = frame(spark, [])
    assert merge.merge3(none, none, none).count() == 0
    got = merge.merge3(frame(spark, [("a", None)]), frame(spark, [("a", "1")]), frame(spark, [("a", None)])).collect()
    assert [(r.op, r.value) for r in got] == [("modified", "1")]


def test_resolvers(spark):
    b = frame(spark, [("both", "{}"), ("gone_here", "0"), ("gone_there", "0")])
    s = frame(spark, [("both", '{"a":1,"n":{"x":1},"l":[1,2]}'), ("gone_here", "1")])
    d = frame(spark, [("both", '{"a":2,"n":{"y":2},"l":[2,3]}'), ("gone_there", "1")])
    run = lambda r: as_dict(merge.apply_merge(d, merge.merge3(b, s, d, "strict", r)))
    assert run(merge.take_source).keys() == {"both", "gone_here"}
    assert run(merge.take_destination) == as_dict(d)
    assert run(merge.ignore_conflicts) == as_dict(d)
    assert run(merge.agent_priority)["gone_there"] == "1" and run(merge.agent_priority)["gone_here"] == "1"
    assert json.loads(run(merge.semantic)["both"]) == {"a": 1, "n": {"x": 1, "y": 2}, "l": [2, 3, 1]}
    none = lambda: F.struct(F.lit(False).alias("resolved"), F.lit(True).alias("present"), F.lit(None).cast("string").alias("value"))
    assert merge.conflicts(merge.merge3(b, s, d, "strict", none)).count() == 3


def test_json_arrays_tell_types_apart():
    assert merge.merged_json([True, 1.0, 1], [1]) == [1, True, 1.0]
    deep = "[" * 100_000 + "]" * 100_000
    import pyarrow as pa

    assert merge._merge_texts(pa.array([deep]), pa.array(["[1]"])).to_pylist() == [deep]


def test_timestamp_resolver(spark):
    side = lambda v: frame(spark, [("a timestamp:5", v), ("b", v)])
    got = merge.merge3(side("0"), side("1"), side("2"), "strict", merge.timestamp())
    assert {r.key: r.value for r in got.collect()} == {"a timestamp:5": "1", "b": "1"}
    later = merge.merge3(side("0"), side("1"), side("2"), "strict", merge.timestamp(lambda k, v: v.cast("int")))
    assert later.count() == 0


def test_mean_vector(spark):
    kind = "key STRING, value ARRAY<FLOAT>"
    b, s, d = (frame(spark, [("a", v), ("b", w)], kind) for v, w in (([0.0, 0.0], [0.0]), ([1.0, 3.0], [1.0]), ([3.0, 5.0], [1.0, 2.0])))
    got = {r.key: (r.op, r.value) for r in merge.merge3(b, s, d, "strict", merge.mean_vector()).collect()}
    assert got == {"a": ("modified", [2.0, 4.0]), "b": ("conflict", None)}
    with pytest.raises(ValueError):
        merge.mean_vector("inner_product")


def test_diff_round_trips(spark):
    rng = random.Random(3)
    a, b = ([(str(k), rng.choice([None, "x", "y"])) for k in range(60) if rng.random() < 0.6] for _ in range(2))
    x, y = frame(spark, a), frame(spark, b)
    changes = diff.diff(x, y)
    assert as_dict(diff.patch(x, changes)) == dict(b)
    assert as_dict(diff.patch(y, diff.inverse(changes))) == dict(a)
    assert diff.diff(x, x).count() == 0


def test_key_history_sees_deletions(spark):
    rows = [("k", "a", False, 0), ("k", "a", False, 1), ("k", None, True, 2), ("k", "a", False, 3), ("k", "b", False, 4)]
    df = spark.createDataFrame(rows, "key STRING, value STRING, is_delete BOOLEAN, seq INT")
    assert [r.seq for r in diff.key_history(df, ["seq"]).orderBy("seq").collect()] == [0, 2, 3, 4]


def test_changes_are_last_wins(spark):
    rng = random.Random(1)
    base = {str(k): str(k) for k in range(20)}
    ops, want, missed = [], dict(base), set()
    for seq in range(100):
        k, gone = str(rng.randrange(40)), rng.random() < 0.4
        ops.append((k, None if gone else f"v{seq}", gone, seq))
    last = {o[0]: o for o in ops}
    for k, v, gone, _ in last.values():
        if gone:
            missed |= {k} - base.keys()
            want.pop(k, None)
        else:
            want[k] = v
    out, absent = kv.apply_changes(frame(spark, list(base.items())), spark.createDataFrame(ops, "key STRING, value STRING, is_delete BOOLEAN, seq BIGINT"))
    assert as_dict(out) == want and {r.key for r in absent.collect()} == missed


def test_free_ids(spark):
    used = spark.createDataFrame([(k,) for k in [0, 1, 3, 4, 9, 100]], "id BIGINT")
    assert [r.id for r in kv.free_ids(used, 6).collect()] == [2, 5, 6, 7, 8, 10]
    assert [r.id for r in kv.free_ids(used.limit(0), 2).collect()] == [0, 1]
    dense = spark.range(5000).where("id <> 1500 AND id <> 4097")
    assert [r.id for r in kv.free_ids(dense, 4).collect()] == [1500, 4097, 5000, 5001]


def test_limits(spark):
    ok = spark.createDataFrame([(bytearray(b"k"), bytearray())], "key BINARY, value BINARY")
    assert validated(ok).count() == 1
    for key in (b"", b"x" * 65537, None):
        with pytest.raises(Exception, match="65536"):
            validated(spark.createDataFrame([(key and bytearray(key) if key != b"" else bytearray(), bytearray(b"v"))], "key BINARY, value BINARY")).collect()


def entries(spark, keys, order=None):
    rows = [(f"k{k:08d}", f"v{k}") for k in keys]
    random.Random(order).shuffle(rows)
    return frame(spark, rows)


@pytest.mark.parametrize("n", [0, 1, 8, 300])
def test_root_depends_on_the_set_only(spark, n):
    roots = {merkle.root_hash(merkle.node_table(entries(spark, range(n), o).repartition(p), TINY)) for o, p in ((0, 1), (1, 3))}
    assert len(roots) == 1
    assert merkle.root_hash(merkle.node_table(entries(spark, range(n + 1)), TINY)) not in roots


def test_root_does_not_depend_on_ranges(spark):
    rows = entries(spark, range(400))
    whole, split = merkle.node_table(rows, TINY), merkle.node_table(rows, TINY, rows_a_range=90)
    assert merkle.root_hash(whole) == merkle.root_hash(split)
    assert whole.where("level = 0").agg(F.sum("n")).first()[0] == 400
    assert whole.agg(F.max("n")).first()[0] <= 16


@pytest.mark.parametrize("config", [TreeConfig(min_chunk=3, max_chunk=5, pattern=1), TreeConfig(min_chunk=4, max_chunk=7, pattern=0, base=999_999_937), TreeConfig(min_chunk=2, max_chunk=300, pattern=1 << 40)])
def test_one_task_makes_the_nodes_that_ranges_make(spark, monkeypatch, config):
    rows = entries(spark, range(0, 3000, 3))
    made = lambda df: sorted((r.level, bytes(r.first_key), r.n, bytes(r.hash), [bytes(m) for m in r.members]) for r in df.collect())
    want = made(merkle.node_table(rows, config, rows_a_range=300))
    wrote = []
    monkeypatch.setattr(merkle, "written", lambda df, name, w=merkle.written: wrote.append(name) or w(df, name))
    assert made(merkle.node_table(rows, config)) == want
    assert wrote == ["nodes"]  # not two tables a level


def test_statistics_of_many_small_chunks(spark, monkeypatch):
    """Levels are many where chunks are small: they are made in one go, whatever their number."""
    wrote = []
    monkeypatch.setattr(merkle, "written", lambda df, name, w=merkle.written: wrote.append(name) or w(df, name))
    r = merkle.stats(merkle.node_table(entries(spark, range(20_000)), TINY)).first()
    assert r.pairs == 20_000 and r.depth > 4 and r.nodes == r.leaves + r.inner and len(wrote) == 1


def test_proofs(spark):
    rows = entries(spark, range(100))
    nodes = merkle.node_table(rows, TINY)
    root = merkle.root_hash(nodes)
    path = merkle.proof(nodes, rows, b"k00000042")
    assert merkle.verify(path, root, b"k00000042", b"v42")
    assert not merkle.verify(path, root, b"k00000042", b"v43")
    assert not merkle.verify(path, root, b"k00000041", b"v41")
    assert not merkle.verify(merkle.proof(nodes, rows, b"absent"), root, b"absent", b"v")


@pytest.mark.parametrize("size", [0, 99, 100, 101, 2048])
def test_blobs_round_trip(spark, size):
    rows = spark.createDataFrame([(1, bytearray(b"x" * size)), (2, bytearray(b"x" * size)), (3, None)], "key INT, value BINARY")
    out, found = blobs.externalise(rows, 100)
    assert found.count() == (size > 100)
    assert blobs.unwrap(out, found).orderBy("key").collect() == rows.collect()
    if size > 100:
        assert out.select(blobs.blob_size(F.col("value"))).first()[0] == size
        assert blobs.garbage(found, [out.limit(0)]).count() == 1 and blobs.garbage(found, [out]).count() == 0


def vectors(spark, n, dim, seed=0):
    x = np.random.default_rng(seed).uniform(-1, 1, (n, dim)).astype(np.float32)
    return x, spark.createDataFrame([(f"id-{i:08d}", v.tolist()) for i, v in enumerate(x)], "id STRING, vector ARRAY<FLOAT>")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_tree_search_recall(spark, metric):
    _, v = vectors(spark, 1000, 16)
    asked = v.limit(20).select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    exact = {(r.qid, r.id) for r in vector.exact_knn(asked, v, 10, metric).collect()}
    found = {(r.qid, r.id) for r in vector.ann_knn(asked, vector.build_tree(v, metric), 10, 64, metric).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_distances(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, -3.0])], "a ARRAY<FLOAT>, z ARRAY<FLOAT>, b ARRAY<FLOAT>")
    a, z, b = F.col("a"), F.col("z"), F.col("b")
    r = df.select(distance.l2(a, z), distance.cosine(a, z), distance.cosine(a, b), distance.inner_product(a, a), distance.l2(a, F.array(F.lit(1.0)))).first()
    assert tuple(r) == (5.0, 1.0, 1.0, -25.0, None)
    with pytest.raises(Exception, match="elements"):
        vector.checked(df.select(F.lit(1).alias("id"), a.alias("vector")), 3).collect()


def test_text_index(spark):
    docs = spark.createDataFrame([("hit", "one line\n\nanother"), ("other", "something else"), ("none", None), ("empty", "")], "doc_id STRING, text STRING")
    e = text.hash_embedder(16)
    index = text.embedded(docs, e)
    assert index.count() == 3
    asked = spark.createDataFrame([(1, "another")], "qid INT, text STRING")
    assert text.search(index, asked, 1, e).first().doc_id == "hit"
    after = text.put_documents(index, spark.createDataFrame([("hit", "new")], "doc_id STRING, text STRING"), e)
    assert after.where("doc_id = 'hit'").count() == 1
    mine = text.callable_embedder(lambda xs: [[float(len(x)), 1.0] for x in xs], "len", "1", 2)
    assert text.embedded(docs, mine).first().vector == [8.0, 1.0]
    with pytest.raises(ValueError):
        text.same_embedder(mine, {"id": "len", "version": "2", "dim": 2})


def test_cascade_skips_what_is_no_text(spark):
    rows = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"\xff\xfe")), (3, None)], "key INT, value BINARY")
    made, report = text.cascade(rows)
    assert [r.text for r in made.collect()] == ["ok"] and tuple(report.first()) == (1, 2)


def test_encodings(spark, tmp_path):
    schema = encoding.schema_of({"properties": {"name": {"type": "string"}, "age": {"type": "integer"}, "active": {"type": "boolean"}, "balance": {"type": "number"}}})
    rows = spark.createDataFrame([("a", 1, True, 0.5)], schema)
    assert encoding.decode_json(encoding.encode_json(rows, "name"), schema).drop("key").collect() == rows.collect()
    with pytest.raises(TypeError):
        encoding.schema_of({"properties": {"x": {"type": "array"}}})
    with pytest.raises(Exception):
        encoding.decode_json(spark.createDataFrame([("a", bytearray(b'{"name":"a"}'))], "key STRING, value BINARY"), schema).collect()
    encoding.to_arrow_ipc(rows, f"file://{tmp_path}/arrow")
    assert list((tmp_path / "arrow").glob("*.arrow"))
    assert encoding.formatted(rows, "csv") == "name,age,active,balance\na,1,True,0.5\n"


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_blocks_give_what_pairs_give(spark, metric, monkeypatch):
    """Copies, zero vectors, other lengths, null, NaN, infinite and very large elements; several blocks and slabs."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6)).round(1).tolist() + [[0.0] * 6] * 150 + [[1.0, 2.0]] * 30 + [None, [], [None] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0]]
    x += [[float("nan")] * 6, [float("inf"), 0, 0, 0, 0, 0.0], [1e200] * 6, [1e-200] * 6, [1e30, 1.0, 0, 0, 0, 0]]
    ids = rng.permutation(len(x)).tolist()
    rows = spark.createDataFrame([(i, v and [e if e is None else float(e) for e in v]) for i, v in zip(ids, x)], "id BIGINT, vector ARRAY<DOUBLE>")
    asked = rows.select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    run = lambda: sorted((r.qid, r.rank, r.id, str(r.distance)) for r in vector.exact_knn(asked, rows, 7, metric).collect())
    monkeypatch.setattr(nearest, "BLOCK", 90)
    monkeypatch.setattr(nearest, "SLAB_BYTES", 20_000)
    got = run()
    monkeypatch.setattr(vector, "FEW", 10**6)
    assert got == run()


def test_batch_search_lists_no_pairs(spark):
    """20 000 queries over 20 000 vectors: no plan lists their 400 000 000 pairs."""
    _, v = vectors(spark, 20_000, 8)
    found = vector.exact_knn(v.select(F.col("id").alias("qid"), F.col("vector").alias("query")), v, 3, "l2")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "zip_with" not in text
    assert found.where("rank = 1 AND qid = id AND distance = 0").count() == 20_000


def test_text_search_over_blocks(spark, monkeypatch):
    """Documents that share lines tie by doc_id; a document counts once, by its nearest line; no plan lists pairs of lines and queries."""
    import hashlib

    def plain(t):
        v = np.array([int.from_bytes(hashlib.sha256(bytes(8) + i.to_bytes(4, "little") + t.encode()).digest()[:1], "big", signed=True) / 128 for i in range(16)])
        return (v / np.sqrt((v * v).sum())).astype(np.float32).astype(float)

    rng, e = random.Random(2), text.hash_embedder(16)
    said = [f"line {i}" for i in range(60)]
    docs = {d: [rng.choice(said[: 5 + d % 50]) for _ in range(rng.randrange(1, 9))] for d in range(400)}
    asked = [f"line {i}" for i in range(0, 60, 7)] + ["elsewhere", "é"]
    monkeypatch.setattr(nearest, "BLOCK", 100)
    rows = spark.createDataFrame([(d, "\n".join(x)) for d, x in docs.items()], "doc_id BIGINT, text STRING").repartition(3)
    found = text.search(text.embedded(rows, e), spark.createDataFrame([*enumerate(asked), (99, None)], "qid INT, text STRING"), 6, e)
    plan = found._jdf.queryExecution().executedPlan().toString()
    vecs = {t: plain(t) for t in said + asked}
    far = lambda a, b: round(1 - min(1.0, vecs[a] @ vecs[b] / np.linalg.norm(vecs[a]) / np.linalg.norm(vecs[b])), 9)
    want = {(q, d, r + 1) for q, t in enumerate(asked) for r, (_, d) in enumerate(sorted((min(far(t, x) for x in lines), d) for d, lines in docs.items())[:6])}
    assert {(r.qid, r.doc_id, r.rank) for r in found.collect()} == want
    assert "zip_with" not in plan and "sha2" not in plan


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_distances_of_batches(spark, metric):
    """Pairs have the same distance over Arrow batches, bit by bit; the level tree takes them."""
    rng = np.random.default_rng(4)
    x = [v.tolist() for v in rng.normal(size=(40, 5))] + [[0.0] * 5, [1.0], [], None, [None] * 5, [float("nan")] * 5, [float("inf")] + [0.0] * 4, [1e200] * 5]
    rows = spark.createDataFrame([(v,) for v in x], "a ARRAY<DOUBLE>")
    pairs = rows.crossJoin(rows.withColumnRenamed("a", "b")).withColumn("slow", distance.METRICS[metric](F.col("a"), F.col("b"))).withColumn("fast", nearest.distances(metric)(F.col("a"), F.col("b")))
    assert pairs.count() == len(x) ** 2 and pairs.where("NOT slow <=> fast").count() == 0
    _, v = vectors(spark, 50, 4)
    found = vector.ann_knn(v.select(F.col("id").alias("qid"), F.col("vector").alias("query")), vector.build_tree(v, metric), 3, metric=metric)
    assert "zip_with" not in found._jdf.queryExecution().executedPlan().toString()
