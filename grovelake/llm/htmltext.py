"""Operator 2, HTML extraction by removal of site templates.

Each page is parsed to elements; an element's hash covers its tag, its text with white space drawn together
and its children, in order, without attributes, comments, scripts and styles. Spark counts, per host, on how
many different pages (by the hash of the whole page, so that copies of one page count once) each subtree of at
least ``MIN_CHARS`` characters occurs. Those on at least ``MIN_PAGES`` pages are the host's template, however large
the host is. A second pass deletes them and returns the text that is left, blocks on lines of their own.

The template's hashes reach the second pass as one sorted array, broadcast, where they take at most
``broadcast_bytes``; beyond that each page's own hashes are joined with them. Both ways give the same rows.

Defined results: null html gives null text, html without text an empty one. Pages without a host (null or
relative url) are one host. Repeated rows each get their own result. Quoted attributes may hold ``>``. A
tag runs to the next ``>`` out of quotes, a ``<`` in it is a part of its attributes; what begins like a tag that no
such ``>`` ends is text to the end of the page. Unclosed
elements end with their parent, a ``p``, ``li``, ``tr``, ``td``, ``th``, ``dt``, ``dd`` or ``option`` also where the next one
begins; a ``head`` also where its first text or element of the body begins, a ``select`` at the next block or ``select``.
An ``svg``, ``iframe``, ``noscript`` or ``select`` that no end tag follows hides nothing. End tags of what is not open
are skipped; an unclosed comment or script runs to the end of the page.
"""

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PAGES, MIN_CHARS, BROADCAST_BYTES = 5, 16, 64 << 20
_IN_TAG = r"""(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|template)\b{_IN_TAG}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*){_IN_TAG}(>|\Z)", re.S | re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
SKIPPED = frozenset(["head", "noscript", "svg", "iframe", "select"])
IN_HEAD = frozenset("title base link meta style script template noscript html head".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
SCOPE = frozenset("html body div table ul ol dl article section nav aside main header footer td th form select".split())
hash64 = xxhash.xxh3_64_intdigest


class _Open:
    __slots__ = ("tag", "parts", "chars", "begin", "hides")

    def __init__(self, tag: str, begin: int, hides: bool = False) -> None:
        self.tag, self.parts, self.chars, self.begin, self.hides = tag, [tag.encode()], 0, begin, hides


def parse(page: str) -> tuple[list[str], list[tuple[int, int, int, int]], int]:
    """(pieces of text and line ends, elements as (hash, first piece, end piece, characters), hash of the page)."""
    pieces: list[str] = []
    elements: list[tuple[int, int, int, int]] = []
    root = _Open("", 0)
    stack, count, hidden = [root], {}, 0
    here, at = root, 0
    low, last = page.lower(), {}

    def hides(tag: str, after: int) -> bool:
        """Whether an element keeps its text back: not if no end tag follows it, but for a head, which needs none."""
        if tag not in SKIPPED:
            return False
        if tag not in last:
            last[tag] = low.rfind("</" + tag)
        return tag == "head" or last[tag] >= after

    def close() -> None:
        nonlocal here, hidden
        done = stack.pop()
        here = stack[-1]
        count[done.tag] -= 1
        key = hash64(b"".join(done.parts))
        if done.chars:
            elements.append((key, done.begin, len(pieces), done.chars))
        here.parts.append(b"\x02" + key.to_bytes(8, "little"))
        here.chars += done.chars
        hidden -= done.hides
        if not done.hides and done.tag not in INLINE:
            pieces.append("\n")

    def close_to(tags: tuple, scope: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                while len(stack) > k:
                    close()
                return
            if stack[k].tag in scope:
                return

    for token in TOKEN.finditer(page):
        if token.group(4) == "":  # no > follows: the rest is text, and isn't searched again
            break
        if here.tag == "head" and token.start() > at and not page[at : token.start()].isspace():
            close()
        if token.start() > at and not hidden:
            text = page[at : token.start()]
            words = (entities.unescape(text) if "&" in text else text).split()
            if words:
                joined = " ".join(words)
                here.parts.append(b"\x01" + joined.encode("utf-8", "replace"))
                here.chars += len(joined)
                pieces.append((" " if text[0].isspace() else "") + joined + (" " if text[-1].isspace() else ""))
            elif pieces and not pieces[-1].endswith((" ", "\n")):
                pieces.append(" ")
        at = token.end()
        tag = token.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if token.group(2):
            if count.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                while len(stack) > k:
                    close()
            continue
        if tag not in IN_HEAD and count.get("head"):
            close_to(("head",), frozenset())
        if count.get("select") and (tag == "select" or tag in CLOSES_P) and tag != "hr":
            close_to(("select",), frozenset())
        if tag in CLOSES_P and count.get("p"):
            close_to(("p",), SCOPE)
        if tag in SIBLINGS and any(count.get(t) for t in SIBLINGS[tag]):
            close_to(SIBLINGS[tag], frozenset(("table", "ul", "ol", "dl", "select")))
        if tag in VOID:
            if tag in ("br", "hr"):
                pieces.append("\n")
            continue
        if tag not in INLINE and pieces and pieces[-1] != "\n":
            pieces.append("\n")
        here = _Open(tag, len(pieces), hides(tag, at))
        stack.append(here)
        count[tag] = count.get(tag, 0) + 1
        hidden += here.hides
    if here.tag == "head" and not page[at:].isspace():
        close()
    if at < len(page) and not hidden:
        words = entities.unescape(page[at:]).split()
        if words:
            joined = " ".join(words)
            here.parts.append(b"\x01" + joined.encode("utf-8", "replace"))
            here.chars += len(joined)
            pieces.append((" " if page[at].isspace() else "") + joined)
    while len(stack) > 1:
        close()
    return pieces, elements, hash64(b"".join(root.parts))


def _text(pieces: list[str]) -> str:
    lines = (" ".join(line.split()) for line in "".join(pieces).split("\n"))
    return "\n".join(line for line in lines if line)


def without(page: str, is_template) -> tuple[str, int]:
    """(text, number of deleted subtrees); is_template tells of an array of hashes which are the template's."""
    pieces, elements, _ = parse(page)
    removed = 0
    if elements:
        found = is_template(np.array([e[0] for e in elements], np.uint64))
        reach = -1
        # outermost first: an element ends after those within it, and begins no later
        for k in sorted(np.flatnonzero(found).tolist(), key=lambda k: (elements[k][1], -elements[k][2])):
            _, begin, end, chars = elements[k]
            if end > reach and chars >= MIN_CHARS:
                pieces[begin:end] = ["\n"] + [""] * (end - begin - 1)
                reach, removed = end, removed + 1
    return _text(pieces), removed


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def _key(host: int, hashes: np.ndarray) -> np.ndarray:
    x = hashes ^ np.uint64(host)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _host_hash(host: str) -> int:
    return hash64(host.encode())


def _subtrees(pages: DataFrame, mark: str) -> DataFrame:
    """(host_key, key, mark) of the subtrees of (host, html, mark) that are long enough; of a page ``mark`` is its own hash if there is none."""

    def subtrees(batches):
        for batch in batches:
            hosts, keys, marks = [], [], []
            given = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for host, page, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), given):
                _, elements, root = parse(page)
                own = np.array(list({e[0] for e in elements if e[3] >= MIN_CHARS}), np.uint64)
                h = _host_hash(host)
                keys.append(_key(h, own))
                hosts.append(np.full(len(own), h, np.uint64))
                marks.append(np.full(len(own), root if m is None else m, np.uint64))
            if hosts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (hosts, keys, marks)], names=["host_key", "key", mark])

    return pages.mapInArrow(subtrees, f"host_key bigint, key bigint, {mark} bigint")


def template_keys(pages: DataFrame, html: str = "html", url: str = "url", min_pages: int = MIN_PAGES) -> DataFrame:
    """(host_key, key): the template subtrees of each host; host_key is the host's hash."""
    rows = pages.where(F.col(html).isNotNull()).select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    counted = _subtrees(rows, "page").groupBy("host_key", "key").agg(F.countDistinct("page").alias("n"))
    return counted.where(F.col("n") >= min_pages).select("host_key", "key")


def extract(pages: DataFrame, html: str = "html", url: str = "url", min_pages: int = MIN_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with ``host``, ``main_text`` and ``removed``; columns of those names are replaced."""
    from .store import written

    spark = pages.sparkSession
    templates = written(template_keys(pages, html, url, min_pages), "templates")
    names = [c for c in pages.columns if c not in ("host", "main_text", "removed")]
    kind = "struct<text: string, removed: int>"

    def result(rows):
        texts, removed = zip(*rows) if rows else ((), ())
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["text", "removed"])

    rows = pages.select(F.struct(*(F.col(c) for c in names)).alias("row"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    if templates.count() * 8 <= broadcast_bytes:
        known = np.sort(np.asarray(templates.select("key").toArrow()["key"]).astype(np.int64).view(np.uint64))
        shared = spark.sparkContext.broadcast(known)

        @F.arrow_udf(kind)
        def cleaned(hosts: pa.Array, htmls: pa.Array) -> pa.Array:
            table, out = shared.value, []
            for host, page in zip(hosts.to_pylist(), htmls.to_pylist()):
                h = _host_hash(host)

                def known_here(x, h=h):
                    k = _key(h, x)
                    at = np.minimum(np.searchsorted(table, k), max(len(table) - 1, 0))
                    return table[at] == k if len(table) else np.zeros(len(x), bool)

                out.append((None, 0) if page is None else without(page, known_here))
            return result(out)

        out = rows.withColumn("out", cleaned(F.col("host"), F.col("html")))
    else:

        @F.arrow_udf(kind)
        def cleaned(hosts: pa.Array, htmls: pa.Array, lists: pa.Array) -> pa.Array:
            out = []
            for host, page, keys in zip(hosts.to_pylist(), htmls.to_pylist(), lists):
                table = np.asarray(keys.values).astype(np.int64).view(np.uint64) if keys.is_valid else np.zeros(0, np.uint64)
                h = _host_hash(host)
                out.append((None, 0) if page is None else without(page, lambda x, h=h, table=table: np.isin(_key(h, x), table)))
            return result(out)

        held = written(rows.withColumn("u", F.monotonically_increasing_id()), "pages")
        own = _subtrees(held.where("html IS NOT NULL").select("host", "html", "u"), "u").join(templates, ["host_key", "key"], "left_semi")
        per_page = own.groupBy("u").agg(F.collect_list("key").alias("keys"))  # no more than the page's own subtrees
        out = held.join(per_page, "u", "left").withColumn("out", cleaned(F.col("host"), F.col("html"), F.col("keys")))
    return out.select("row.*", "host", F.col("out.text").alias("main_text"), F.col("out.removed").alias("removed"))


def op2_html(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "host", "main_text", "removed")
