"""Operators over small tables that hold nulls, blanks, repeats, long texts and clashing columns."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grovelake.llm import components, embeddings, htmltext, langid, mixing, packing, pii, quality, sharding, simhash, suffix
from grovelake.llm import tokens as tk

KIND = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, id STRING, host STRING, node STRING, group_id INT, keep INT, th INT, run INT, shard INT, lang_pred INT, quality_p INT, pii_text INT"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    base = " ".join(word() for _ in range(120))
    near = base.split()
    near[50] = "changed"
    rows = [(k, " ".join(word() for _ in range(rng.randint(30, 90))) + f" mail a{k}@mail1.example.com", "en", f"s{k % 3}") for k in range(20)]
    rows += [(100, base, "en", "s0"), (101, base, "en", None), (102, " ".join(near), None, "s1"), (102, " ".join(near), None, "s1"), (103, None, None, None), (None, None, "fr", "s1"), (104, "", "fr", "s1"), (105, " \n ", "fr", "s2"), (None, "only words without an id here", "fr", "s2"), (106, "x", "de", "s0"), (107, "lang " * 40_000, "de", "s0")]
    extra = ("a", "b", "c", 1, 2, 3, 4, 5, 6, 7, 8)
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *extra) for i, t, lang, s in rows], KIND).cache()


def test_simhash(docs):
    rows = {(r.id, r.th): r for r in simhash.near_groups(docs).collect()}
    by_id = {r.id: r for r in rows.values()}
    assert by_id[101].group_id == 100 and by_id[102].group_id == 100 and by_id[1].group_id == 1
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(100) == 1 and 101 not in ids and 102 not in ids and {103, 104, 105, 106, 107} <= set(ids) and ids.count(None) == 2
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_simhash_recall(spark):
    rng = random.Random(3)
    rows, pairs = [], 60
    for k in range(pairs):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
        rows.append((2 * k, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(200)] = "edit"
        rows.append((2 * k + 1, " ".join(words)))
    found = {r.id: r.group_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert sum(found[2 * k + 1] == 2 * k for k in range(pairs)) >= 0.9 * pairs
    assert all(found[2 * k] == 2 * k for k in range(pairs))


def test_simhash_recall_up_to_the_distance(spark):
    rng = np.random.default_rng(6)
    near = rng.integers(0, 2, (3000, 128))
    far = near.copy()
    for row in far:
        row[rng.choice(128, rng.integers(20, 27), replace=False)] ^= 1
    both = np.packbits(np.concatenate([near, far]), axis=1).view(np.int64).tolist()
    nodes = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(both)], "node BIGINT, h1 BIGINT, h2 BIGINT")
    for most in (4096, 64):  # whole buckets, buckets in parts
        rows = simhash.near_links(nodes, most=most).collect()
        found = {tuple(sorted((r.node, r.low))) for r in rows if r.node != r.low}
        assert sum((k, 3000 + k) in found for k in range(3000)) >= 0.9 * 3000 and len(found) <= 3000
        assert sum(r.n for r in rows) == 2 * len(found)


def _links_by_hand(n, near):
    """(root, number of links) of each of n members, given the pairs that are near."""
    root, count = list(range(n)), [0] * n
    for i, j in near:
        count[i], count[j] = count[i] + 1, count[j] + 1
        lo, hi = sorted((root[i], root[j]))
        if lo != hi:
            root = [lo if r == hi else r for r in root]
    return root, count


@pytest.mark.parametrize("most", [4096, 32])
def test_simhash_matches_brute_force(spark, most):
    rng = random.Random(21)
    texts = []
    for _ in range(40):
        words = [rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randrange(50)) for _ in range(120)]
        for _ in range(rng.choice([1, 1, 2, 12])):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(120)] = f"edit{rng.randrange(9)}"
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    h = simhash.fingerprints(pa.array(texts))[0]
    nodes = sorted({tuple(x) for x in h.tolist()})
    near = [(i, j) for i, j in itertools.combinations(range(len(nodes)), 2) if sum((a ^ b).bit_count() for a, b in zip(nodes[i], nodes[j])) <= 26]
    root, count = _links_by_hand(len(nodes), near)
    of = [nodes.index(tuple(x)) for x in h.tolist()]
    least = {}
    for k, x in enumerate(of):
        least.setdefault(root[x], k)
    got = {r.id: r for r in simhash.near_groups(df, most=most).collect()}  # so few nodes share one bucket
    assert [(got[k].group_id, got[k].keep, got[k].n_links) for k in range(len(texts))] == [(least[root[x]], least[root[x]] == k, count[x]) for k, x in enumerate(of)]
    assert len(near) > 100


def test_many_near_equal_vectors(spark):
    """One bucket of many vectors is compared in units: all are one group and every link is counted."""
    x = np.ones((5000, 8)) + 1e-3 * np.random.default_rng(3).normal(size=(5000, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id BIGINT, embedding ARRAY<DOUBLE>").repartition(4)
    for most in (4096, 1000):
        rows = embeddings.near_groups(df, most=most).collect()
        assert {(r.group_id, r.n_links) for r in rows} == {(0, 4999)} and sum(r.keep for r in rows) == 1


def test_embeddings_match_brute_force(spark):
    x = np.random.default_rng(1).normal(size=(120, 16))
    x = np.concatenate([x, x[:60] + 0.05 * np.random.default_rng(2).normal(size=(60, 16)), x[:9]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    u = (x / np.linalg.norm(x, axis=1)[:, None])[:180]
    near = [(i, j) for i, j in itertools.combinations(range(180), 2) if u[i] @ u[j] >= 0.95]
    root, count = _links_by_hand(180, near)
    root, count = [*root, *root[:9]], [*count, *count[:9]]
    got = {r.id: r for r in embeddings.near_groups(df, recall=0.9999).collect()}
    assert [(got[k].group_id, got[k].n_links) for k in range(189)] == list(zip(root, count)) and len(near) > 40


def test_suffix(docs, spark):
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix.repeated_spans(docs).select("doc_id", "start_word", "end_word").collect()}
    assert got == {(100, 0, 120), (101, 0, 120), (102, 51, 120), (102, 0, 50)} and not any(x[0] == 107 for x in got)
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for k in range(30)]
    windows: dict = {}
    for k, t in rows:
        w = t.split()
        for o in range(len(w) - 7):
            windows.setdefault(tuple(w[o : o + 8]), set()).add(k)
    want = {(k, i) for k, t in rows for o in range(len(t.split()) - 7) if len(windows[tuple(t.split()[o : o + 8])]) > 1 for i in range(o, o + 8)}
    spans = suffix.repeated_spans(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), length=8, gram=3).collect()
    assert {(r.doc_id, i) for r in spans for i in range(r.start_word, r.end_word)} == want
    assert suffix.repeated_spans(docs.limit(0)).count() == 0


def test_embeddings(spark):
    x = np.random.default_rng(1).normal(size=(300, 16))
    x[150:] = x[:150] + 0.05 * np.random.default_rng(2).normal(size=(150, 16))
    rows = [(k, v.tolist(), 0, "n") for k, v in enumerate(x)]
    rows += [(400, x[0].tolist(), 0, "n"), (401, None, 0, "n"), (402, [], 0, "n"), (403, [0.0] * 16, 0, "n"), (404, [float("nan")] * 16, 0, "n"), (None, x[1].tolist(), 0, "n"), (405, [1.0], 0, "n"), (405, [1.0], 0, "n")]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, group_id INT, node STRING")
    out = embeddings.near_groups(df).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    true = [k for k in range(150) if u[k] @ u[150 + k] >= 0.95]
    group = {r.id: r.group_id for r in out if r.id is not None}
    assert len(out) == len(rows) and np.mean([group[150 + k] == group[k] for k in true]) >= 0.9
    assert group[400] == group[0] and all(group[k] == k for k in (401, 402, 403, 404)) and sum(r.keep for r in out if r.id == 405) == 1
    assert embeddings.near_groups(df.limit(0)).count() == 0


def test_html(spark):
    nav = "<nav><a>Home page</a><a>All the news</a></nav>"
    rows = [(k, f"http://www.a.org/{k}", f"<body>{nav}<p>own text of page {k}</p></body>", 1) for k in range(8)]
    rows += [(k, "http://b.org/", f"<body>{nav}<p>own text of page {k}</p></body>", 1) for k in (20, 21)]
    rows += [(k, "http://c.org/x", f"<body>{nav}<p>one page</p></body>", 1) for k in range(30, 40)]
    rows += [(50, None, "<p>no host", 1), (51, "http://a.org", None, 1), (None, None, "", 1)]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, removed INT")
    for limit in (1 << 20, -1):  # by broadcast, by join
        got = {r.page_id: r for r in htmltext.extract(df, broadcast_bytes=limit).collect()}
        assert [got[k].main_text for k in range(8)] == [f"own text of page {k}" for k in range(8)] and got[0].removed == 1
        assert "Home page" in got[20].main_text and "Home page" in got[30].main_text  # few pages; copies of one page
        assert got[50].main_text == "no host" and got[51].main_text is None and got[None].main_text == ""
    assert htmltext.extract(df.limit(0)).count() == 0


def test_language(docs):
    out = langid.identify(docs, langid.train(docs))
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count() and rows[103].lang_pred is None and rows[105].lang_pred is None and rows[107].lang_pred == "de"
    assert langid.train(docs.where("lang IS NULL")) is None and langid.identify(docs, None).where("lang_pred IS NOT NULL").count() == 0
    assert langid.identify(docs.limit(0), langid.train(docs)).count() == 0


def test_quality(docs, spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)] + [(None, 1, 0), (1, None, 0)], "doc_id BIGINT, quality INT, toxic INT")
    out = quality.score_quality(docs, quality.train(docs, labels))
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count() and rows[103].quality_decision == "reject" and rows[105].quality_p is None and rows[107].quality_p is not None
    assert quality.train(docs, labels.limit(0)) is None
    assert {r.quality_decision for r in quality.score_quality(docs, None).where("doc_id = 1").collect()} == {"keep"}


def test_personal_data(docs):
    out = pii.redact(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count() and all("example" not in rows[k].pii_text for k in range(20)) and rows[103].pii_text is None and rows[100].pii_entities == []
    assert pii.redact(docs.limit(0)).count() == 0


def test_packing(docs):
    out = packing.pack(docs, window=512)
    ids = {i for r in out.collect() for i in r.doc_ids}
    assert ids == {*range(20), 100, 101, 102, 106, 107, None}
    assert packing.pack(docs.limit(0)).count() == 0


def test_mixing(docs):
    out = mixing.mix(docs, block=128, shard_slots=32, weights={"s0": 0.5, "s1": 0.25, "s2": 0.25}).collect()
    n = len(out)
    assert len({(r.shard, r.slot) for r in out}) == n and {r.source for r in out} == {"s0", "s1", "s2"}
    share = sum(r.source == "s0" for r in out) / n
    assert abs(share - 0.5) < 5 * (0.25 / n) ** 0.5
    assert mixing.mix(docs.limit(0)).count() == 0
    pieces = mixing.mix_texts(docs, block=128)
    assert pieces.columns == docs.columns and pieces.count() > 0


def test_mixing_gives_a_rare_source_its_share_of_tokens(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = [(1000 * k, " ".join(word() for _ in range(20)), "rare") for k in range(150)] + [(k, " ".join(word() for _ in range(60)), "usual") for k in range(600)] + [(None, "no id", "rare")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    out = mixing.mix(df, block=128, weights={"rare": 0.5, "usual": 0.5}).collect()
    streams = {s: [t for r in sorted((r for r in rows if r[2] == s), key=lambda r: (r[0] is None, r[0] or 0)) for t in [*tk.encode([r[1]])[0].tolist(), tk.END]] for s in ("rare", "usual")}
    for r in out:
        assert r.tokens == streams[r.source][128 * r.block : 128 * r.block + 128] and r.n_tokens == len(r.tokens)
    assert len({(r.shard, r.slot) for r in out}) == len(out) == sum(-(-len(s) // 128) for s in streams.values())
    tokens, slots = {s: sum(r.n_tokens for r in out if r.source == s) for s in streams}, sum(r.source == "rare" for r in out)
    assert abs(tokens["rare"] / sum(tokens.values()) - slots / len(out)) < 0.01


def test_sharding(docs, spark):
    keys = spark.range(20_000)
    r = keys.select(sharding.rendezvous(F.col("id"), [1.0, 1.0, 2.0]).alias("a"), sharding.rendezvous(F.col("id"), [1.0, 1.0, 2.0, 1.0]).alias("b"))
    moved = r.where("a <> b")
    assert moved.where("b <> 3").count() == 0 and abs(moved.count() / 20_000 - 0.2) < 0.02
    assert abs(r.where("a = 2").count() / 20_000 - 0.5) < 0.02
    out = sharding.assign_shards(docs, "doc_id", [1.0, 1.0])
    assert out.where("shard IS NULL").count() == 0 and out.columns == docs.columns
    assert sharding.assign_shards(docs, "doc_id", [0.0]).where("shard IS NOT NULL").count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(100)] + [(7, 7), (None, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_pipeline(docs, spark, tmp_path):
    import corpus_pipeline

    wanted = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(wanted).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)] + [(106, 0, 0), (107, 0, 0)], "doc_id BIGINT, quality INT, toxic INT")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {i for r in rows for i in r.doc_ids}
    assert ids and not ids & {101, 102, 103, 104, 105}
    now = docs.select(wanted)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == wanted


def test_packing_keeps_the_order_of_the_mixture(docs, spark):
    rng = random.Random(9)
    long = [(k, " ".join(f"{rng.choice('zyxwvabc')}{rng.randint(0, 99)}" for _ in range(900)), "en", f"s{k % 2}") for k in range(12)]
    df = spark.createDataFrame(long, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    blocks = mixing.mix(df).orderBy("shard", "slot").collect()
    windows = packing.stage(spark, mixing.stage(spark, df, ""), "").orderBy("run", "window").collect()
    # ends of pieces and spaces at their cuts aside, the text of the windows is that of the slots, one after another
    model = tk._load(tk.VOCABULARY)[0]
    plain = lambda rows: "".join(model.decode([t for t in r.tokens if t != tk.END]) for r in rows).replace(" ", "")
    assert plain(windows) == plain(blocks) and len(blocks) > 12
    pieces = mixing.mix_texts(df)
    assert pieces.select("doc_id").distinct().count() == pieces.count()


def _text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) + rng.choice(["", "", ".", "\n"]) for _ in range(n))


def test_packing_and_mixing_do_not_depend_on_how_ids_are_spread(spark):
    rng = random.Random(12)
    rows = [(k, _text(rng, rng.choice([3, 60, 300, 4000])), f"s{k % 3 % 2}") for k in range(90)]
    near = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    far = spark.createDataFrame([(k * 1_000_003, t, s) for k, t, s in rows], "doc_id BIGINT, text STRING, source STRING")
    named = spark.createDataFrame([(f"d{k:05d}", t, s) for k, t, s in rows], "doc_id STRING, text STRING, source STRING")
    whole = [t for _, text, _ in rows for t in [*tk.encode([text])[0].tolist(), tk.END]]
    found = []
    for df in (near, far, named):
        windows = sorted(packing.pack(df, window=512, run=4096).collect(), key=lambda r: (r.run, r.window))
        assert [t for r in windows for t in r.tokens] == whole and max(r.run for r in windows) > 5
        found.append([(r.run, r.window, r.padding, r.cut, tuple(r.tokens)) for r in windows])
        found[-1] += sorted((r.shard, r.slot, r.source, r.block, tuple(r.tokens)) for r in mixing.mix(df, block=128, shard_slots=32).collect())
    assert found[0] == found[1] == found[2]
    undivided = packing.pack_run([r[0] for r in rows], [r[1] for r in rows], window=512)
    runs = max(x[0] for x in found[0] if len(x) == 5 and isinstance(x[2], int)) + 1
    assert sum(r[2] for r in found[0] if isinstance(r[2], int)) <= sum(undivided["padding"]) + 512 * runs


def test_rows_without_an_id_and_repeated_rows_spread(spark):
    rng = random.Random(13)
    texts = [_text(rng, 100) for _ in range(60)]
    rows = [(None, t) for t in texts] + [(5, texts[0])] * 60
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("source", F.lit(None).cast("string")).withColumn("part", F.lit(1)).withColumn("u", F.lit("x"))
    windows = packing.pack(df, window=256, run=1024).collect()
    assert len({r.run for r in windows}) > 10
    spent = [t for r in windows for t in r.tokens]
    assert sorted(spent) == sorted(t for _, text in rows for t in [*tk.encode([text])[0].tolist(), tk.END])
    blocks = mixing.mix(df, block=64).collect()
    assert sorted(t for r in blocks for t in r.tokens) == sorted(spent) and {r.source for r in blocks} == {None}


def test_mixture_matches_a_plain_layout(spark):
    """Each source gives each block once an epoch; slots, blocks and tokens are as laid out by hand."""
    rng = random.Random(14)
    rows = [(rng.randrange(10**9), _text(rng, rng.choice([5, 40, 900])), rng.choice(["a", "b", None])) for _ in range(80)]
    rows += rows[:3] + [(None, "no id here", "a"), (7, "  ", "a"), (8, None, "b")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    block, shard_slots, weights = 64, 16, {"a": 0.7, "b": 0.2, "": 0.1}
    th = {r.text: r.th for r in df.select("text", F.xxhash64("text").alias("th")).collect()}
    streams = {}
    for s in ("a", "b", None):
        own = sorted((r for r in rows if r[2] == s and r[1] and r[1].strip()), key=lambda r: (r[0] is None, r[0] or 0, th[r[1]]))
        streams[s] = ([t for r in own for t in [*tk.encode([r[1]])[0].tolist(), tk.END]], [r[0] for r in own for _ in range(int(tk.encode([r[1]])[1][0]) + 1)])
    out = mixing.mix(df, block=block, shard_slots=shard_slots, weights=weights).collect()
    sizes = {s: -(-len(t) // block) for s, (t, _) in streams.items()}
    slots = sum(sizes.values())
    assert sorted((r.shard, r.slot) for r in out) == [(k // shard_slots, k % shard_slots) for k in range(slots)]
    order = sorted(streams, key=lambda s: mixing.NONE if s is None else s)
    drawn = {s: 0 for s in order}
    for shard in range(-(-slots // shard_slots)):
        counts = np.random.default_rng([mixing.SEED, shard]).multinomial(min(shard_slots, slots - shard * shard_slots), np.array([weights[s or ""] for s in order]))
        for s, n in zip(order, counts):
            assert sum(r.shard == shard and r.source == s for r in out) == n
            drawn[s] += int(n)
    for s in order:
        given = [r.block for r in out if r.source == s]
        times = [given.count(b) for b in range(sizes[s])]
        assert len(given) == drawn[s] and max(times) - min(times) <= 1
    for r in out:
        tokens, ids = streams[r.source]
        at = slice(r.block * block, (r.block + 1) * block)
        assert r.tokens == tokens[at] and r.n_tokens == len(r.tokens)
        assert [i for i, j in zip(r.doc_ids, [*r.doc_ids[1:], object()]) if i != j] == [i for i, j in zip(ids[at], [*ids[at][1:], object()]) if i != j]
    with pytest.raises(ValueError):
        mixing.MOST_SOURCES, most = 1, mixing.MOST_SOURCES
        try:
            mixing.mix(df)
        finally:
            mixing.MOST_SOURCES = most


def test_templates_match_a_plain_count(spark):
    """A host of many sections: each section's menu is on few of its pages, yet deleted; both ways give the same rows."""
    rows = [(k, "http://big.org/x", f"<body><nav><a>Menu of section number {k % 60}</a></nav><p>own text of page {k}</p></body>", "extra") for k in range(360)]
    rows += [(1000, "http://big.org/y", rows[0][2], "extra"), (1001, None, None, None)]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, row STRING")
    on: dict = {}
    for _, _, html, _ in rows:
        for key in {e[0] for e in htmltext.parse(html)[1] if e[3] >= htmltext.MIN_CHARS} if html else ():
            on.setdefault(key, set()).add(html)
    template = np.array([k for k, pages in on.items() if len(pages) >= htmltext.MIN_PAGES], np.uint64)
    want = sorted((i, *(htmltext.without(h, lambda x: np.isin(x, template)) if h else (None, 0)), x) for i, _, h, x in rows)
    for limit in (1 << 20, -1):
        assert sorted((r.page_id, r.main_text, r.removed, r.row) for r in htmltext.extract(df, broadcast_bytes=limit).collect()) == want
    assert want[0][1] == "own text of page 0" and want[0][2] == 1


def test_samples_are_bounded_however_keys_repeat(spark, monkeypatch):
    words = {"en": "the of and this with", "fr": "être où ça déjà les"}
    rows = [(None, f"{words[lang]} " * 3, lang) for _ in range(300) for lang in words]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    seen = []
    monkeypatch.setattr(langid, "fit", lambda windows, labels: seen.append(len(labels)))
    langid.train(df, max_labelled=50)
    monkeypatch.setattr(quality, "fit", lambda texts, labels: seen.append(len(labels)))
    same = spark.createDataFrame([(1, r[1]) for r in rows], "doc_id BIGINT, text STRING")
    quality.train(same, spark.createDataFrame([(1, 0), (1, 1)], "doc_id BIGINT, quality INT"), max_labelled=50)
    assert seen == [50, 50]
    monkeypatch.undo()
    assert quality.fit(["a b", "c d"], [0, 1]).slope == 1.0 and quality.fit(["a b"] * 3 + ["c"], [0, 0, 0, 1]) is not None


def test_stages_hand_on_columns_of_any_name(spark):
    kind = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, quality_p STRING, quality_decision STRING, pii_text STRING, pii_entities STRING, p STRING, row STRING, piece STRING, rest STRING, u STRING, part STRING, n STRING, at STRING"
    rows = [(k, f"some words of text number {k} and mail a{k}@mail1.example.com", "en", "s", 9, *(f"{c}{k}" for c in "abcdefghijkl")) for k in range(6)]
    df = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id BIGINT, quality INT")
    scored = quality._scored(df, quality.train(df, labels), "text", 0.0, 0.0).where("decision <> 'reject'").select("row.*")
    for out in (scored, simhash.stage(spark, df, ""), pii.stage(spark, df, ""), mixing.stage(spark, df, "")):
        assert out.schema.names == df.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
        assert {tuple(r[5:]) for r in out.collect()} <= {r[5:] for r in rows}
    assert pii.stage(spark, df, "").where("text LIKE '%[EMAIL]%' AND n_chars = length(text)").count() == 6


def test_suffix_takes_ids_of_any_type(spark):
    text = " ".join(f"w{k}" for k in range(70))
    for kind, ids in (("STRING", ("d1", "d2", None)), ("DOUBLE", (0.5, 1.5, None))):
        df = spark.createDataFrame([(i, f"lead{j} {text}") for j, i in enumerate(ids)] + [(ids[0], f"lead0 {text}")], f"doc_id {kind}, text STRING")
        assert sorted((r.doc_id is None, r.doc_id or 0, r.start_word, r.end_word) for r in suffix.repeated_spans(df).select("doc_id", "start_word", "end_word").collect()) == [(False, ids[0], 1, 71), (False, ids[1], 1, 71), (True, 0, 1, 71)]


def test_written_shards(docs, spark, tmp_path):
    sharding.write_shards(docs, "doc_id", [1.0, 0.0, 2.0], f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == docs.count() and set(back.columns) == set(docs.columns) and {r.shard for r in back.select("shard").distinct().collect()} <= {0, 2}
    wrong = back.select("shard", sharding.rendezvous(F.col("doc_id"), [1.0, 0.0, 2.0]).alias("want")).where("shard <> want")
    assert wrong.count() == 0
