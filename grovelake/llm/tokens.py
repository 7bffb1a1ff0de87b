"""Token ids of whole texts by a public vocabulary file; its path is a parameter and must exist on each node."""

from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from . import textbuf as tb

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
END = 2  #: closes each document
MOST_PARTS = 500_000  #: parts of texts that a process remembers


@lru_cache(maxsize=4)
def _load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = np.array([1 if model.is_byte(i) else len(model.id_to_piece(i).replace("▁", " ").encode()) for i in range(model.get_piece_size())], np.int64)
    return model, size


class _Cache:
    """Ids of the parts of texts that were met before; emptied when it is full."""

    def __init__(self, path: str) -> None:
        self.model, _ = _load(path)
        self.space = self.model.piece_to_id("▁")
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 18, np.int32), 0

    def add(self, raw: list[bytes], opens: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """(first id in the pool, number of ids) of new parts. Those after
        a space get the space that the vocabulary puts before a text; others must lose it."""
        texts = [x.decode()[1:] if x[:1] == b" " and not first else x.decode() for x, first in zip(raw, opens)]
        found = self.model.encode(texts, num_threads=1)
        for k, (x, first) in enumerate(zip(raw, opens)):
            if x == b" " and not first:
                found[k] = [self.space]
            elif x[:1] == b"\n" and not first:
                found[k] = found[k][1:] if found[k][:1] == [self.space] else found[k]
        sizes = np.array(list(map(len, found)), np.int64)
        total = int(sizes.sum())
        while self.used + total > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        begin = self.used + np.cumsum(sizes) - sizes
        self.used += total
        return begin, sizes

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens never reach over the start of a run of spaces and line ends, so parts between those are apart."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        blank = (data == 32) | (data == 10)
        head = blank.copy()
        head[1:] &= ~blank[:-1]
        first = offs[:-1][np.diff(offs) > 0]
        head[first] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(data))
        opens = np.zeros(len(data), bool)
        opens[first] = True
        opens = opens[starts]
        keys = tb.word_hashes(data, starts, ends, folded=False) ^ (opens * np.uint64(0x5DEECE66D))
        unique, first_at, place = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > MOST_PARTS:
            self.clear()
        at = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != unique
        if new.any():
            raw, where = data.tobytes(), first_at[new]
            begin, sizes = self.add([raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())], opens[where].tolist())
            self.keys, self.start, self.size = np.insert(self.keys, at[new], unique[new]), np.insert(self.start, at[new], begin), np.insert(self.size, at[new], sizes)
            at = np.searchsorted(self.keys, unique)
        slots = at[place]
        size = self.size[slots]
        edge = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.start[slots] - edge[:-1].astype(np.int32), size) + np.arange(edge[-1], dtype=np.int32)]
        return ids, np.diff(edge[np.searchsorted(starts, offs)])


@lru_cache(maxsize=2)
def _cache(path: str) -> _Cache:
    return _Cache(path)


def encode(texts: list[str] | pa.Array, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each text); null is as empty."""
    parts = [_cache(path).ids(data, offs) for _, data, offs in tb.slices(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string()))]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def sizes(path: str = VOCABULARY) -> np.ndarray:
    """The bytes that each id stands for, a space before a word with it."""
    return _load(path)[1]


def width(path: str = VOCABULARY) -> str:
    """The kind of integers that hold every id of the vocabulary."""
    return "<u2" if _load(path)[0].get_piece_size() <= 1 << 16 else "<i4"


def token_ends(ids: np.ndarray, data: bytes, path: str = VOCABULARY) -> np.ndarray:
    """Where each token of one text ends in its UTF-8 bytes, moved on to the end of a character."""
    model, size = _load(path)
    ends = np.cumsum(size[ids]) - 1 if len(ids) else np.zeros(0, np.int64)  # a space is put before the text
    if len(ids) and ends[-1] != len(data):  # text that the vocabulary normalises: ask it for each place
        text = data.decode()
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]).astype(np.int64)
        ends = at[np.array([p.end for p in model.encode(text, out_type="immutable_proto").pieces], np.int64)]
        ends[-1] = len(data)
    ends = np.clip(ends, 0, len(data))
    raw = np.frombuffer(data, np.uint8)
    while True:
        inside = (ends < len(data)) & (raw[np.minimum(ends, len(data) - 1)] & 0xC0 == 0x80) if len(data) else np.zeros(len(ends), bool)
        if not inside.any():
            return ends
        ends = ends + inside
