"""Parts of the operators against plain Python, without Spark."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from grovelake.llm import embeddings, htmltext, langid, mixing, packing, pii, quality, simhash, suffix
from grovelake.llm import textbuf as tb
from grovelake.llm import tokens as tk

WORDS = {"en": "the of and this with that from have".split(), "fr": "être où ça déjà les une avec dans".split(), "de": "für über groß nicht eine schön ist das".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_language_held_out():
    rng = random.Random(2)
    made = [(lang, prose(rng, lang, rng.randint(5, 200))) for lang in WORDS for _ in range(150)]
    rng.shuffle(made)
    seen, y = [], []
    for lang, text in made[:300]:
        w, _ = langid.windows(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        seen.append(w), y.extend([lang] * len(w))
    net = langid.fit(np.concatenate(seen), y)
    best, p = langid.classify(net, pa.array([t for _, t in made[300:]] + [None, "", "123 !?", (prose(rng, "fr", 20_000)).upper()]))
    assert np.mean([net.languages[k] == lang for k, (lang, _) in zip(best, made[300:])]) > 0.97
    assert best[-4:-1].tolist() == [-1, -1, -1] and net.languages[best[-1]] == "fr"
    assert langid.fit(np.zeros((0, 256), np.uint8), []) is None
    assert langid.fit(np.ones((2, 256), np.uint8), ["x", "x"]).languages == ["x"]


def test_html_text_and_hashes():
    page = '<html><head><title>t</title></head><body><nav><ul><li>one<li>two</ul></nav><p>a &amp; <b>b</b><p>c<br>d<script>var x="</p>"</script><!-- e --></body>'
    text, removed = htmltext.without(page, lambda h: np.zeros(len(h), bool))
    assert text == "one\ntwo\na & b\nc\nd" and removed == 0
    nav = next(e for e in htmltext.parse(page)[1] if page and e[3] == 6)
    same = htmltext.parse(page.replace("<nav>", '<nav class="x">'))[1]
    assert nav[0] in {e[0] for e in same}
    for odd in ("", "<", "plain", "<!-- open", "<script>x", "</p></p>", "<p" * 1000, "<b>" * 5000 + "x"):
        htmltext.without(odd, lambda h: np.zeros(len(h), bool))
    assert htmltext.without("<p>x</p>", lambda h: np.ones(len(h), bool)) == ("x", 0)  # too short for a template
    assert htmltext.without("<div><p>longer than the least</p></div>tail", lambda h: np.ones(len(h), bool)) == ("tail", 1)


def test_quality_held_out_and_calibrated():
    rng = random.Random(4)
    good = [prose(rng, "en", rng.randint(10, 80)) + "." for _ in range(300)]
    bad = [" ".join(rng.choice(["click", "buy", "$$$", "!!!", "free", "the"]) for _ in range(rng.randint(10, 80))) for _ in range(300)]
    model = quality.fit(good[:200] + bad[:200], [1] * 200 + [0] * 200)
    p = np.array(quality.score_texts(model, pa.array(good[200:] + bad[200:] + [None, "", " "])).to_pylist()[:-3], float)
    assert (p[:100] > 0.5).mean() > 0.95 and (p[100:] < 0.5).mean() > 0.95
    assert quality.score_texts(model, pa.array([None, "", " "])).to_pylist() == [None] * 3
    assert quality.fit(["a"], [1]) is None


def _roots(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        lo, hi = sorted((root[a], root[b]))
        root = [lo if r == hi else r for r in root]
    return root


@pytest.mark.parametrize("seed", range(4))
def test_units_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    k = rng.integers(0, 1 << 63, (300, 2)).astype(np.uint64)
    for row in range(150, 300):  # copies of others with up to 30 bits changed
        flips = rng.choice(128, rng.integers(0, 31), replace=False)
        k[row] = k[row - 150] ^ np.array([sum(1 << int(x) for x in flips if x < 64), sum(1 << int(x - 64) for x in flips if x >= 64)], np.uint64)
    near = [(a, b) for a, b in itertools.combinations(range(300), 2) if int(np.bitwise_count(k[a] ^ k[b]).sum()) <= 26]
    mask = simhash.masks(simhash.sampled(3, 4))
    met = [{t for t in range(3) if not ((k[a] ^ k[b]) & mask[t]).any()} for a, b in near]
    for small in (1000, 8):  # by gaps, by blocks
        label, count = simhash.unit_links(k, np.zeros(300, int), np.array([0, 300]), np.zeros(300, int), mask, small=small)
        assert label.tolist() == _roots(300, near) and count.tolist() == [sum(x in p for p in near) for x in range(300)]
        _, count = simhash.unit_links(k, np.full(300, 2), np.array([0, 300]), np.zeros(300, int), mask, small=small)
        assert count.sum() == 2 * sum(not m & {0, 1} for m in met)
    side = (np.arange(300) >= 150).astype(int)
    across = [(a, b) for a, b in near if a < 150 <= b]
    label, count = simhash.unit_links(k, np.zeros(300, int), np.array([0, 300]), side, mask)
    assert label.tolist() == _roots(300, across) and count.sum() == 2 * len(across) > 100


def test_simhash_tables_follow_from_the_nodes():
    for n in (1, 300, 10_000, 1_000_000, 100_000_000):
        bits, tables = simhash.plan(n)
        meet = np.prod([(102 - i) / (128 - i) for i in range(bits)])
        assert 1 - (1 - meet) ** tables >= 0.9 and n / 2**bits <= 256


@pytest.mark.parametrize("seed", range(6))
def test_repeated_windows_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    length = 4
    parts = [rng.integers(0, 3, rng.integers(length, 30)).astype(np.uint32) for _ in range(12)]
    docs = rng.integers(0, 5, 12)
    part, off = suffix.repeated_windows(parts, docs, docs, length)
    holders: dict = {}
    for p, words in enumerate(parts):
        for o in range(len(words) - length + 1):
            holders.setdefault(tuple(words[o : o + length]), []).append((p, o))
    want = {x for at in holders.values() if len({docs[p] for p, _ in at}) > 1 for x in at}
    assert set(zip(part.tolist(), off.tolist())) == want


def test_pstable_chances_and_links():
    rng = np.random.default_rng(0)
    d = 0.7
    a, b = rng.normal(size=200_000) * d, rng.uniform(0, 2, 200_000)
    assert abs((np.floor((a + b) / 2) == 0).mean() - embeddings.meets(d, 2)) < 0.01
    x = rng.normal(size=(60, 8))
    x[30:] = x[:30] + 0.05 * rng.normal(size=(30, 8))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype("<f4")
    label = embeddings.links(x, 0.95, block=7)
    root = list(range(60))
    for i, j in itertools.combinations(range(60), 2):
        if x[i] @ x[j] >= 0.95:
            lo, hi = sorted((root[i], root[j]))
            root = [lo if r == hi else r for r in root]
    assert label.tolist() == root
    assert embeddings.unit(pa.array([None, [], [0.0], [1.0, None], [float("nan")], [float("inf")]])) == [None] * 6


@pytest.mark.parametrize("seed", range(20))
def test_best_cuts_are_optimal(seed):
    rng = random.Random(seed)
    window, sizes = 10, [rng.randint(1, 10) for _ in range(rng.randint(1, 9))]
    penalties = [rng.choice([0, 3, 6]) for _ in sizes]
    best = min(cost for n in range(2 ** (len(sizes) - 1)) if (cost := total(n, sizes, penalties, window)) is not None)
    cuts, cost = packing.best_cuts(sizes, penalties, window)
    assert cost == best and cuts[-1] == len(sizes)


def total(n, sizes, penalties, window):
    cost, at = 0, 0
    for j in range(1, len(sizes) + 1):
        if j == len(sizes) or n >> (j - 1) & 1:
            if sum(sizes[at:j]) > window:
                return None
            cost, at = cost + window - sum(sizes[at:j]) + penalties[j - 1], j
    return cost


def test_packing_keeps_every_token():
    rng = random.Random(1)
    texts = [". ".join(prose(rng, "en", rng.randint(1, 30)) for _ in range(rng.randint(1, 40))) for _ in range(30)] + ["", None, "  ", "word " * 5000]
    rows = packing.pack_run(list(range(len(texts))), texts, window=256)
    want = [t for text in texts if text and text.strip() for t in [*tk.encode([text])[0].tolist(), tk.END]]
    assert np.concatenate(rows["tokens"]).tolist() == want and max(rows["n_tokens"]) <= 256


def test_tokens_match_the_vocabulary():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tk.VOCABULARY)
    texts = ["Plain words here.", "two  spaces\n\nlines\n", "être déjà — ✓", "x" * 300, "a\tb", " lead", ""]
    ids, n = tk.encode(texts)
    edge = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])] == [model.encode(t) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutations_are_bijections(n):
    out = mixing.permuted_index(np.arange(n), np.full(n, n), np.full(n, 99))
    assert sorted(out.tolist()) == list(range(n))


def test_personal_data_is_found_and_consistent():
    model = pii.trained()
    texts = ["write to jane.doe42@mail.example.com today, or call (415) 555-0199.", "In 2019 we sold 42 of 1300 items, 15% more.", None, "", "server 192.168.10.44 is up"]
    out = pii.redact_texts(model, pa.array(texts)).to_pylist()
    assert [e["kind"] for e in out[0]["entities"]] == ["EMAIL", "PHONE"] and "jane" not in out[0]["redacted"]
    assert [x["redacted"] for x in out[1:4]] == [None] * 3 and out[4]["entities"][0]["kind"] == "IP"
    for e in out[0]["entities"]:
        assert texts[0][e["start"] : e["end"]] in ("jane.doe42@mail.example.com", "(415) 555-0199")


def test_word_hashes_do_not_depend_on_the_place():
    texts = ["one two", "two, ONE", "", "ünï two"]
    h = {}
    for _, data, offs in tb.slices(pa.array(texts)):
        s, e, first = tb.words(data, offs)
        for k, x in enumerate(tb.word_hashes(data, s, e).tolist()):
            h.setdefault(data[s[k] : e[k]].tobytes().lower().strip(b","), set()).add(x)
    assert all(len(v) == 1 for v in h.values()) and len(h) == 3


def test_html_omitted_tags_and_quotes():
    none = lambda h: np.zeros(len(h), bool)
    text = lambda page: htmltext.without(page, none)[0]
    assert text("<html><head><title>t</title><body><p>hello world text</p></body></html>") == "hello world text"
    assert text("<head><title>t</title>bare text<p>more") == "bare text\nmore"
    assert text("<head><title>never closed<p>seen</p>") == "seen"
    assert text('<p title="a>b">hello</p>') == "hello" and text("<p title='a>b' x>hello</p>") == "hello"
    assert text("<p title=it's>one</p><p title=it's>two</p>") == "one\ntwo" and text('<p title="open>one</p>') == "one"
    assert text("<p>a</p><select><option>x<p>b</p>") == "a\nx\nb" and text("<select><option>x<p>b</p><select><option>y</select>") == "b" and text("<select><option>x</select>c") == "c"
    for tag in ("svg", "iframe", "noscript"):
        assert text(f"<p>a</p><{tag}><p>b</p>") == "a\nb" and text(f"<p>a</p><{tag}>x</{tag}><p>b</p>") == "a\nb"
    long = "<div>" * 2000 + "<p>words of a long page " * 20_000
    assert text(long).count("long") == 20_000 and text("<a '\" " * 20_000 + ">x") == "x"


def test_any_characters_are_read():
    rng = random.Random(8)
    odd = "²³¹٣৪  ́​\U0001f600\x00\x1c'\"<>&=@.:-_/()09azAZßéあ漢 \n\t"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 300))) for _ in range(120)] + ["1.2.3.²", "1234567890123²", "1.2.3." + "9" * 5000, "4" * 16, "9" * 100_000, "a@" * 50_000, None, ""]
    model = pii.trained()
    together = pii.redact_texts(model, pa.array(texts)).to_pylist()
    assert together == [pii.redact_texts(model, pa.array([t], pa.string())).to_pylist()[0] for t in texts]  # whatever else is in the batch
    some = pa.array(texts, pa.string())
    simhash.fingerprints(some)
    net = langid.fit(np.ones((2, 256), np.uint8), ["x", "y"])
    langid.classify(net, some)
    quality.score_texts(quality.fit(["good words here", "bad words here"] * 4, [1, 0] * 4), some)
    for t in texts:
        htmltext.without(t or "", lambda h: np.zeros(len(h), bool))
    rows = packing.pack_run(list(range(len(texts))), texts, window=256)
    want = [x for t in texts if t and tb.SOLID.search(t) for x in [*tk.encode([t])[0].tolist(), tk.END]]
    assert np.concatenate(rows["tokens"]).tolist() == want


def test_a_repeated_ambiguous_token_takes_the_label_of_its_evidence():
    model = pii.trained()
    found = lambda t: [(e["kind"], t[e["start"] : e["end"]]) for e in pii.redact_texts(model, pa.array([t])).to_pylist()[0]["entities"]]
    assert found("they went to hunterquartz by train") == []
    text = "my password: hunterquartz is old. " + "plain words go on and on. " * 200 + "they went to hunterquartz by train"
    assert found(text) == [("SECRET", "hunterquartz")] * 2
    assert found("the key ideas remain and token economies work, a secret garden") == []


@pytest.mark.parametrize("seed", range(8))
def test_marginals_match_enumeration(seed):
    rng = np.random.default_rng(seed)
    model = pii.Crf()
    model.trans, model.skip = rng.normal(0, 0.6, (pii.K, pii.K)), rng.normal(0, 0.6, (2, pii.K, pii.K))
    n = 5
    unary = rng.normal(0, 1, (n, pii.K))
    tree = seed % 2 == 0
    edges = [(0, 1, 2), (1, 2, 2), (1, 3, 0), (3, 4, 1)] + ([] if tree else [(0, 4, 0)])
    a, b, kind = (np.array(x) for x in zip(*edges))
    ties = [model.skip[0], model.skip[1], model.trans]
    score = 0
    for i in range(n):
        score = score + unary[i].reshape([-1 if k == i else 1 for k in range(n)])
    for i, j, k in edges:
        score = score + ties[k].reshape([pii.K if x in (i, j) else 1 for x in range(n)])
    p = np.exp(score - score.max())
    p /= p.sum()
    want = np.stack([p.sum(tuple(k for k in range(n) if k != i)) for i in range(n)])
    got = model.marginals(unary, a, b, kind)
    assert np.abs(got - want).max() < (1e-3 if tree else 0.1)


def test_language_probabilities_match_a_plain_forward_pass():
    rng = random.Random(2)
    rows = [(lang, prose(rng, lang, 60)) for lang in WORDS for _ in range(10)]
    seen = np.concatenate([langid.windows(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for _, t in rows])
    net = langid.fit(seen, [lang for lang, t in rows for _ in range(-(-len(t.encode()) // 256))], epochs=1)
    got = langid.probabilities(net, seen[:7])
    for w, p in zip(seen[:7], got):
        x, pooled = net.embed[w].astype(float), []
        for width, kernel, bias in zip(langid.WIDTHS, net.kernels, net.biases):
            best = np.full(langid.FILTERS, -np.inf)
            for at in range(256 - width + 1):
                best = np.maximum(best, x[at : at + width].ravel() @ kernel.astype(float))
            pooled.append(np.maximum(best + bias, 0))
        z = np.concatenate(pooled) @ net.out + net.out_bias
        z = np.exp(z - z.max())
        assert np.abs(z / z.sum() - p).max() < 1e-4


def test_quality_logits_match_plain_sums():
    rng = random.Random(3)
    texts = ["été déjà là " + prose(rng, "fr", 9), "one two two", "日本語のテキスト", "x"]
    model = quality.fit(texts * 5, [1, 0, 1, 0] * 5, epochs=2)
    size = quality.BITS
    top = lambda h: int(h) >> (64 - size)
    whole = lambda x: tb.word_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]), folded=False)[0]
    for t in texts:
        raw = t.encode()
        z, n = quality._logits(model, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        grams = [t[k : k + 4].encode() for k in range(len(t) - 3)]
        chars = sum(float(model.chars[top(whole(g))]) for g in grams) / (len(grams) + quality.PRIOR)
        h = [tb.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0] for w in t.split()]
        pairs = [tb.mix(np.array([quality.SAME if a == b else a * np.uint64(31) + b]))[0] for a, b in zip(h, h[1:])]
        words = sum(float(model.words[top(x)]) for x in [*h, *pairs, h[-1]]) / (2 * len(h) + quality.PRIOR)
        assert abs(z[0] - (words + chars + model.bias)) < 1e-4 and n[0] == 2 * len(h)


@pytest.mark.parametrize("encoded", [packing.encoded_texts, mixing.sized_texts])
def test_tokens_of_a_batch_are_held_a_slice_at_a_time(encoded):
    texts = ["", " ", *(f"Text {k}. It has some words! " + "more of them, and more. " * (k % 97) for k in range(8000))]
    batch, peaks = pa.array(texts), {}
    encoded(batch, tk.VOCABULARY)  # the tables that a process keeps
    for n in (1000, len(texts)):
        tracemalloc.start()
        found = encoded(batch[:n], tk.VOCABULARY)
        peaks[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert batch.nbytes > 8 << 20 and peaks[len(texts)] < 40 << 20 and peaks[len(texts)] < 1.6 * peaks[1000], peaks
    assert found[:300].to_pylist() == [encoded(pa.array([x]), tk.VOCABULARY)[0].as_py() for x in texts[:300]] and len(encoded(pa.array([], pa.string()), tk.VOCABULARY)) == 0


def test_sentences_do_not_depend_on_the_text_before():
    texts = ["One ends here.", "   \t two begins with space", "x. ", "\t. ", "", " three", "four.\n", "  \n", "!", " . five"]
    alone = [packing.units(pa.array([x]), tk.VOCABULARY) for x in texts]
    for k, found in enumerate(packing.units(pa.array(texts), tk.VOCABULARY)):
        assert found.tolist() == np.concatenate([x[k] for x in alone]).tolist()


def test_html_less_than_in_tags():
    text = lambda page: htmltext.without(page, lambda h: np.zeros(len(h), bool))[0]
    assert text("<p a<b>one</p <i>>two") == "one\n>two" and text('<a href="x" <b>y</a>z') == "yz" and text("<script <b>x</script>y") == "y"
    assert text("<p>1 < 2 <3 a</p>b <c") == "1 < 2 <3 a\nb <c" and text('<p>a</p><b x="<i>"') == 'a\n<b x="<i>"'
    for odd in ("<a '\" ", "<a ", "<script ", '<a x=">" '):
        assert text("<p>y</p>" + odd * 20_000).startswith("y\n" + odd.strip())
