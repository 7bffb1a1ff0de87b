"""Operator 8, personal data by a skip-chain conditional random field.

Nodes are the words that hold a digit or ``@``, the words of ``LETTERS`` bytes or more up to two places after a
cue (``password``, ``token``, ``key`` and others of ``CUES``), and every other mention of those in the document;
all other words are fixed as ``O`` by a hard constraint, so they enter as evidence and need no message: names and
addresses written in letters alone are not found. Factors: each node's features (its shape, lengths, checksum,
words before and after), transitions between neighbouring words, and skip edges that tie each node to the next one
of its document with the same core (``same``) or with the same core but for digits (``similar``), however far
away. Training maximises the pseudo-likelihood on text that a seeded generator writes with its labels (entities,
their mentions again, and numbers that are not personal). Inference is loopy sum-product message passing over
each whole document's graph until its own messages settle, at most as many rounds as twice its nodes and
``ROUNDS``: a path through all nodes is shorter, so evidence at one mention reaches them all.

Defined results: null text stays null, text without entities is returned as it was; each row is on its own,
so repeated rows get equal results whatever else is in their batch. Offsets count characters of the text. A word
of any length and of any characters is a word like others.
"""

import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb

KINDS = ("O", "EMAIL", "IP", "CARD", "PHONE", "SECRET", "SSN", "IBAN")
K = len(KINDS)
WIDTH = 1 << 13
ROUNDS, SETTLED, DAMPING = 40, 1e-4, 0.3
STRIP_LEFT, STRIP_RIGHT = "\"'|*#$%&!<[{`", "\"'|*#$%&!,.;:?>]}`"
RESULT = "struct<redacted: string, entities: array<struct<kind: string, start: int, end: int, p: double>>>"
LETTERS = 6
CUES = "password passwd passphrase pwd pass secret token key apikey api_key access_key secret_key private_key credential credentials".split()
_DIGITS = frozenset("0123456789")
_MARKED = np.zeros(256, bool)
_MARKED[[*range(48, 58), 64]] = True


def core(word: str) -> tuple[int, int]:
    """Where the word is without what encloses it."""
    left = len(word) - len(word.lstrip(STRIP_LEFT))
    right = len(word.rstrip(STRIP_RIGHT))
    if word[left:right].startswith("(") and not re.search(r"^\(\d+\)", word[left:right]):
        left += 1
    if word[left:right].endswith(")") and "(" not in word[left:right]:
        right -= 1
    return (left, right) if right > left else (0, len(word))


def _shape(word: str) -> str:
    long = re.sub(r"[^\W\d_]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", word)))
    return re.sub(r"(.)\1+", r"\1", long)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _number(word: str) -> bool:
    return word.isascii() and word.isdigit()


def _own_features(raw: str) -> tuple[str, ...]:
    return _seen_features(raw) if len(raw) <= 256 else _features_of(raw)  # only short words are remembered


def _features_of(raw: str) -> tuple[str, ...]:
    a, b = core(raw)
    word = raw[a:b]
    digits = sum(c in _DIGITS for c in word)
    octets = word.split(".")
    out = [
        "s=" + _shape(word),
        "long=" + re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", word)),
        f"n={min(len(word), 50) // 3}",
        f"d={min(digits, 20)}",
        f"alld={_number(word)}:{min(len(word), 20)}",
        f"at={word.count('@')}:{'.' in word.rpartition('@')[2]}",
        f"quad={len(octets) == 4 and all(_number(o) and len(o) < 4 and int(o) < 256 for o in octets)}",
        f"hex={bool(re.fullmatch('[0-9a-fA-F]+', word)) and digits < len(word)}:{min(len(word) // 8, 5)}",
        f"mixed={bool(re.search('[A-Za-z]', word)) and digits > 2}:{min(len(word) // 8, 5)}:{bool(re.search('[^A-Za-z0-9_-]', word))}",
        f"first={word[:1] if not word[:1].isalnum() else ''}",
        "iban=" + str(bool(re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{8,30}", word))),
        "ssn=" + str(bool(re.fullmatch(r"\d{3}-\d{2}-\d{4}", word))),
    ]
    if _number(word) and 13 <= len(word) <= 19:
        out.append(f"luhn={_luhn(word)}")
    return tuple(out)


_seen_features = lru_cache(maxsize=200_000)(_features_of)


def features(words: list[str], k: int) -> list[int]:
    """Indices of one node's features."""
    names = list(_own_features(words[k]))
    for gap in (-2, -1, 1, 2):
        other = words[k + gap] if 0 <= k + gap < len(words) else "<edge>"
        marked = any(c in _DIGITS or c == "@" for c in other)
        a, b = core(other)
        names.append(f"{gap}=" + (_shape(other[a:b]) if marked else "w"))
        if not marked and abs(gap) <= 2 and gap < 0:
            names.append(f"w{gap}=" + other[a:b].lower() + (other[-1] if other[-1] in ":=" else ""))
    return [zlib.crc32(x.encode()) % WIDTH for x in names]


def _keys(word: str) -> tuple[str, str]:
    a, b = core(word)
    body = word[a:b].casefold()
    return body, re.sub(r"\d", "9", body)


def skip_edges(docs: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, kind): each node with the next node of its document of the same core (0), else similar (1)."""
    left, right, kind = [], [], []
    last: dict = {}
    for i, (d, word) in enumerate(zip(docs.tolist(), words)):
        same, similar = _keys(word)
        found = last.get((d, 0, same))
        if found is not None:
            left.append(found), right.append(i), kind.append(0)
        near = last.get((d, 1, similar))
        if near is not None and near != found:
            left.append(near), right.append(i), kind.append(1)
        last[d, 0, same] = last[d, 1, similar] = i
    return np.array(left, np.int64), np.array(right, np.int64), np.array(kind, np.int64)


class Crf:
    """Weights: emission (WIDTH, K), transitions (K, K), skip ties of both kinds (2, K, K)."""

    def __init__(self) -> None:
        self.emit, self.trans, self.skip = np.zeros((WIDTH, K)), np.zeros((K, K)), np.zeros((2, K, K))

    def unary(self, feats: list[list[int]], free_left: np.ndarray, free_right: np.ndarray) -> np.ndarray:
        """Log potentials with the fixed ``O`` neighbours' transitions."""
        n = np.array([len(f) for f in feats])
        flat = np.concatenate([np.array(f, np.int64) for f in feats]) if len(feats) else np.zeros(0, np.int64)
        out = np.add.reduceat(self.emit[flat], np.cumsum(n) - n, axis=0) if len(feats) else np.zeros((0, K))
        return out + free_left[:, None] * self.trans[0] + free_right[:, None] * self.trans[:, 0]

    def marginals(self, unary: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray, docs: np.ndarray | None = None) -> np.ndarray:
        """Loopy sum-product; kind 2 is a transition, 0 and 1 are skip ties. Each of ``docs`` ends when its own messages settle."""
        docs = np.zeros(len(unary), np.int64) if docs is None else docs
        ties = np.concatenate([self.skip, self.trans[None]])
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        pot = np.concatenate([ties[kind], ties[kind].transpose(0, 2, 1)]) if len(a) else np.zeros((0, K, K))
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        msg, belief = np.zeros((len(src), K)), unary.copy()
        most = ROUNDS + 2 * np.bincount(docs, minlength=1)
        open_, turn = np.arange(len(src)), 0
        while len(open_):
            x = (belief[src[open_]] - msg[back[open_]])[:, :, None] + pot[open_]
            top = x.max(1)
            new = np.log(np.exp(x - top[:, None]).sum(1)) + top
            new -= new.max(1, keepdims=True)
            new = (1 - DAMPING) * new + DAMPING * msg[open_]
            moved = np.zeros(len(most))
            np.maximum.at(moved, docs[src[open_]], np.abs(new - msg[open_]).max(1))
            msg[open_] = new
            belief[dst[open_]] = unary[dst[open_]]
            np.add.at(belief, dst[open_], new)
            turn += 1
            open_ = open_[((moved >= SETTLED) & (most > turn))[docs[src[open_]]]]
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def fit(self, feats: list[list[int]], y: np.ndarray, prev: np.ndarray, nxt: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray, steps: int = 150) -> None:
        """Pseudo-likelihood by Adam: each label given its features and its neighbours' labels."""
        n = np.array([len(f) for f in feats])
        flat, owner = np.concatenate([np.array(f) for f in feats]), np.repeat(np.arange(len(feats)), n)
        start = np.cumsum(n) - n
        params = [self.emit, self.trans, self.skip]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        eye = np.eye(K)
        for t in range(1, steps + 1):
            z = np.add.reduceat(self.emit[flat], start, axis=0) + self.trans[prev] + self.trans[:, nxt].T
            np.add.at(z, b, self.skip[kind, y[a]])
            np.add.at(z, a, self.skip[kind, :, y[b]])
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - eye[y]) / len(y)
            grads = [np.zeros_like(x) for x in params]
            for k in range(K):
                grads[0][:, k] = np.bincount(flat, g[owner, k], WIDTH)
            np.add.at(grads[1], prev, g)
            np.add.at(grads[1].T, nxt, g)
            np.add.at(grads[2], (kind, y[a]), g[b])
            turned = np.zeros_like(self.skip)
            np.add.at(turned, (kind, y[b]), g[a])
            grads[2] += turned.transpose(0, 2, 1)
            for k, x in enumerate(params):
                grad = grads[k] + 2e-5 * x
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.01 * (grad * grad - v[k])
                x -= 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)


def written_text(rng: random.Random) -> tuple[list[str], list[int]]:
    """One labelled document: words and the place of each word's kind in KINDS."""
    word = lambda: "".join(rng.choice("aeioutnrsldhcmpg") for _ in range(rng.randint(2, 10)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def entity() -> tuple[list[str], int]:
        kind = rng.choice(KINDS[1:])
        if kind == "EMAIL":
            words = [rng.choice([f"{word()}.{digits(2)}@", f"{word()}@", f"{word()}_{word()}@", f"{word()}{digits(3)}@"]) + rng.choice([f"mail{digits(1)}.example.com", f"{word()}.org", f"{word()}.{word()}.net", f"{word()}.com"])]
        elif kind == "IP":
            words = [".".join(str(rng.randint(0, 255)) for _ in range(4))]
        elif kind == "CARD":
            whole = rng.choice("3456789") + digits(rng.choice([14, 14, 14, 13]))
            whole = whole + next(c for c in "0123456789" if _luhn(whole + c)) if rng.random() < 0.6 else whole + digits(1)
            words = [whole] if rng.random() < 0.8 else [whole[k : k + 4] for k in range(0, len(whole), 4)]
        elif kind == "PHONE":
            area, tail = digits(3), f"{digits(3)}-{digits(4)}"
            words = rng.choice([[f"+{rng.randint(1, 99)}", f"({area})", tail], [f"+1", f"({area})", tail], [f"({area})", tail], [f"{area}-{tail}"], [f"+{rng.randint(1, 99)}", area, digits(3), digits(4)]])
        elif kind == "SECRET":
            key = rng.choice(["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64]))), "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(15)) + digits(1), "ghp_" + "".join(rng.choice("abcdefghijkABCDEFGHIJK0123456789") for _ in range(35)) + digits(1), "sk-" + "".join(rng.choice("abcdefghijkABCDEFGHIJK0123456789") for _ in range(40))])
            if rng.random() < 0.25:  # letters only: nothing but the cue before it tells
                key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ_!") for _ in range(rng.randint(7, 20))).strip("!")
                return [rng.choice(["password:", "passwd:", "token=", "secret:", "key:", "pwd=", "api_key="]), rng.choice([key, f'"{key}"'])], 0
            words = [rng.choice([key, f'"{key}"', f"'{key}'"])]
            if rng.random() < 0.15:
                words = [rng.choice(["password", "passwd", "token", "secret", "key", "api_key"]) + rng.choice("=:") + key[rng.randint(0, 20) :]]
        elif kind == "SSN":
            words = [f"{digits(3)}-{digits(2)}-{digits(4)}"]
        else:
            words = [rng.choice(["DE", "FR", "ES", "GB"]) + digits(2) + digits(rng.randint(14, 20))]
        if rng.random() < 0.05:
            words = [w.upper() for w in words]
        return words, KINDS.index(kind)

    def plain() -> str:
        return rng.choice([digits(rng.randint(1, 6)), str(rng.randint(1900, 2040)), f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(2)}%", f"${digits(3)}.{digits(2)}", f"{word()}{digits(1)}", f"{digits(1)}th", f"{digits(4)}-{digits(2)}-{digits(2)}", f"v{digits(1)}.{digits(1)}", f"({digits(1)})", f"{digits(2)}/{digits(2)}", f"{word()}-{digits(2)}", f"{digits(1)},{digits(3)}", f"@{word()}", f"#{digits(3)}", f"({rng.randint(1900, 2030)})", f"{digits(3)}-{digits(3)}", digits(rng.randint(7, 11)), f"http://{word()}.com/{digits(3)}"])

    words: list[str] = []
    labels: list[int] = []
    known: list = []
    for _ in range(rng.randint(3, 14)):
        for _ in range(rng.randint(0, 7)):
            words.append(word() + rng.choice(["", "", "", ".", ","]))
            labels.append(0)
        if rng.random() < 0.1:  # a cue that nothing secret follows
            words += [rng.choice(CUES), word(), word()]
            labels += [0, 0, 0]
        if rng.random() < 0.45:
            words.append(plain() + rng.choice(["", "", ".", ","]))
            labels.append(0)
        else:
            body, kind = rng.choice(known) if known and rng.random() < 0.3 else entity()
            if (body, kind) in known and any(c in _DIGITS for c in body[-1]) and rng.random() < 0.3:  # a mention that differs at its end
                body = [*body[:-1], body[-1][:-1] + rng.choice("0123456789")]
            if not kind:  # a cue and a secret in letters; later mentions have no cue
                words.append(body[0])
                labels.append(0)
                body, kind = body[1:], KINDS.index("SECRET")
                known.append((body, kind))
                words.append(body[0])
                labels.append(kind)
                continue
            known.append((body, kind))
            if kind == KINDS.index("SECRET") and not re.search("[=:]", body[0]) and any(c in _DIGITS for c in body[0]) and rng.random() < 0.7:
                lead = rng.choice([["token", "="], ["key", "="], ["password:"], ["secret", "="], ["api_key", "="]])
                words += lead
                labels += [0] * len(lead)
            tail = rng.choice(["", "", "", ".", ",", "###", "!!", "%%%", "&&&", "***", "$$$"])
            words += [*body[:-1], body[-1] + tail]
            labels += [kind] * len(body)
    return words, labels


def _hashes_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = tb.words(data, np.array([0, len(data)]))
    return tb.word_hashes(data, starts, ends)


_CUE = np.unique(_hashes_of([*CUES, *(c + "=" for c in CUES)]))


def nodes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the words that are nodes."""
    marks = np.concatenate([[0], np.cumsum(_MARKED[data])])
    marked = marks[ends] > marks[starts]
    h, size = tb.word_hashes(data, starts, ends), ends - starts
    doc = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    cue = np.flatnonzero(np.isin(h, _CUE))
    near = np.concatenate([cue + 1, cue + 2])
    of = np.concatenate([cue, cue])
    ok = near < len(starts)
    near, of = near[ok], of[ok]
    near = near[(doc[near] == doc[of]) & (size[near] >= LETTERS) & ~np.isin(near, cue)]
    if len(near):  # all mentions of a word that follows a cue, within its document
        here = tb.mix(h ^ tb.mix(doc.astype(np.uint64)))
        marked |= np.isin(here, here[near]) & (size >= LETTERS)
    return np.flatnonzero(marked)


def graph(words_of: list[list[str]]) -> tuple:
    """Nodes and edges of documents: (document, word place, features, left fixed, right fixed, a, b, kind)."""
    docs, places, feats, node_words = [], [], [], []
    for d, words in enumerate(words_of):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, first = tb.words(data, np.array([0, len(data)]))
        for k in nodes(data, starts, ends, first).tolist():
            docs.append(d), places.append(k), feats.append(features(words, k)), node_words.append(words[k])
    return _edges(np.array(docs, np.int64), np.array(places, np.int64), feats, node_words)


def _edges(docs: np.ndarray, places: np.ndarray, feats: list, node_words: list[str]) -> tuple:
    near = (docs[1:] == docs[:-1]) & (places[1:] == places[:-1] + 1) if len(docs) else np.zeros(0, bool)
    left, right = np.ones(len(docs), bool), np.ones(len(docs), bool)
    left[1:], right[:-1] = ~near, ~near
    a, b, kind = skip_edges(docs, node_words)
    chain = np.flatnonzero(near)
    return docs, places, feats, left, right, np.concatenate([a, chain]), np.concatenate([b, chain + 1]), np.concatenate([kind, np.full(len(chain), 2)])


@lru_cache(maxsize=2)
def trained(n_docs: int = 2000, seed: int = 11) -> Crf:
    """Fitted on ``n_docs`` generated documents."""
    rng = random.Random(seed)
    made = [written_text(rng) for _ in range(n_docs)]
    docs, places, feats, left, right, a, b, kind = graph([w for w, _ in made])
    y = np.array([made[d][1][k] for d, k in zip(docs, places)])
    prev, nxt = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
    prev[1:][~left[1:]] = y[:-1][~left[1:]]
    nxt[:-1][~right[:-1]] = y[1:][~right[:-1]]
    model = Crf()
    skips = kind < 2
    model.fit(feats, y, prev, nxt, a[skips], b[skips], kind[skips])
    return model


def find_entities(model: Crf, texts: pa.Array) -> list[list[tuple[str, int, int, float]]]:
    """(kind, first byte, end byte, probability) of the entities of each text."""
    out: list[list] = [[] for _ in range(len(texts))]
    for row, data, offs in tb.slices(texts):
        starts, ends, first = tb.words(data, offs)
        if not len(starts):
            continue
        node = nodes(data, starts, ends, first)
        if not len(node):
            continue
        raw = data.tobytes()
        docs = np.searchsorted(first, node, "right") - 1
        feats, node_words = [], []
        for w, d in zip(node.tolist(), docs.tolist()):
            lo, hi = max(w - 2, int(first[d])), min(w + 3, int(first[d + 1]))
            around = [raw[starts[x] : ends[x]].decode("utf-8", "replace") for x in range(lo, hi)]
            feats.append(features(around, w - lo))
            node_words.append(around[w - lo])
        docs, places, feats, left, right, a, b, kind = _edges(docs, node, feats, node_words)
        p = model.marginals(model.unary(feats, left, right), a, b, kind, docs)
        label = p.argmax(1)
        at = 0
        while at < len(node):
            to = at + 1
            if label[at]:
                while to < len(node) and label[to] == label[at] and not left[to] and KINDS[label[at]] in ("PHONE", "CARD") and len(node_words[to - 1]) < 13:
                    to += 1
                s, e = int(starts[node[at]]), int(ends[node[to - 1]])
                s += len(node_words[at][: core(node_words[at])[0]].encode())
                e -= len(node_words[to - 1][core(node_words[to - 1])[1] :].encode())
                base = int(offs[docs[at]])
                out[row + int(docs[at])].append((KINDS[label[at]], s - base, e - base, float(p[np.arange(at, to), label[at:to]].min())))
            at = to
    return out


def redact_texts(model: Crf, texts: pa.Array) -> pa.Array:
    """The struct of RESULT; ``redacted`` is null where nothing is found."""
    redacted, entities = [], []
    for k, found in enumerate(find_entities(model, texts)):
        if not found:
            redacted.append(None), entities.append([])
            continue
        raw = texts[k].as_py().encode()
        parts, rows, at, chars = [], [], 0, 0
        for kind, s, e, p in found:
            chars += len(raw[at:s].decode())
            size = len(raw[s:e].decode())
            rows.append({"kind": kind, "start": chars, "end": chars + size, "p": p})
            chars += size
            parts += [raw[at:s], f"[{kind}]".encode()]
            at = e
        redacted.append(b"".join([*parts, raw[at:]]).decode()), entities.append(rows)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    return pa.StructArray.from_arrays([pa.array(redacted, pa.string()), pa.array(entities, kind)], ["redacted", "entities"])


def pii(text: Column, spark) -> Column:
    """Struct of the redacted text (null: nothing found) and the entities."""
    shared = spark.sparkContext.broadcast(trained())

    @F.arrow_udf(RESULT)
    def found(texts: pa.Array) -> pa.Array:
        return redact_texts(shared.value, texts)

    return found(text)


def _beside(docs: DataFrame, text: str) -> DataFrame:
    """(row, p): the columns of ``docs``, whatever their names, and what is found in the text."""
    return docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), pii(F.col(text), docs.sparkSession).alias("p"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii_entities`` and ``pii_text`` after its own columns; columns of those names are replaced."""
    row = lambda c: F.col("row").getField(c)
    kept = [row(c).alias(c) for c in docs.columns if c not in ("pii_entities", "pii_text")]
    return _beside(docs, text).select(*kept, F.col("p.entities").alias("pii_entities"), F.coalesce("p.redacted", row(text)).alias("pii_text"))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return redact(docs).select("doc_id", "pii_entities", "pii_text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with entities replaced by their kind; n_chars follows the text, other columns stay."""
    clean = F.coalesce("p.redacted", F.col("row").getField("text"))
    new = {"text": clean, "n_chars": F.length(clean).cast("bigint")}
    return _beside(docs, "text").select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))
