"""Evaluation texts in a corpus: suffix arrays over the corpus, searched for every test suffix.

Each batch of documents is a shard. Its words (runs of letters and digits,
without case and accents) become 64-bit hashes, a suffix array over them is
built by prefix doubling to a depth of at least min_words, and each suffix of
each test item is searched in it by bisection, all at once in numpy. Equal
ranges give the places; of these only the matches that can't be extended to the left are
kept, as each other is part of one, and their full length is found by bisection over
hashes of runs of words. The longest match of each document and item comes out with
where it begins in both.

Plan: one scan of the corpus without a shuffle of texts; hits alone are
aggregated to one row a pair. The test items travel to the tasks with the code,
in blocks of at most MAX_BLOCK_WORDS words, read one at a time, so that neither the
driver nor a task holds more however many items there are. If there is a second
block, the shards are written with their arrays at the first, and all blocks search
those; each block's hits are written before the next block is read. Places are
expanded in runs of MAX_PLACES, so repeated phrases take time, not memory.

Cases: null or empty texts hold nothing; an item with fewer than min_words words
can't be found; copies of a document are found each by itself, copies of an item
each under its own id; rows with null ids are left out; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, Rolling, materialize, raw, slices, strings, word_hashes

MIN_WORDS = 13
MAX_BLOCK_WORDS, MAX_PLACES = 2_000_000, 1 << 20
#: Bytes of text in one shard: a few hundred thousand words, some 50 MB of arrays.
SHARD_BYTES = 3_000_000


def folded(text: str) -> str:
    """text in lower case, without accents, with a space for all but letters, digits and marks that belong to them."""
    text = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c if (k := unicodedata.category(c)[0]) in "LN" else "" if k == "M" or c in "​‌‍­﻿" else " " for c in text)


def fold(column: pa.Array) -> pa.Array:
    """folded() of each row; rows of ASCII alone only need lower case."""
    plain = pc.string_is_ascii(column).to_pylist()
    if all(plain):
        return pc.utf8_lower(column)
    table = _Fold()
    return pa.array([x.lower() if p else x.casefold().translate(table) for x, p in zip(column.to_pylist(), plain)], pa.large_string())


class _Fold(dict):
    """A table for str.translate that learns folded() a character at a time."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = c if code < 128 else folded(c)
        return out


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word; no hash is 0."""
    data, bounds = raw(fold(column))
    h, row = word_hashes(data, bounds, WORD_BYTES)
    return h | np.uint64(1), row


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of tokens in the order of the suffixes that begin there, compared over depth tokens at least."""
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
    width = 1
    while width < depth:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        # only positions that share their rank with another still need an order
        size = np.bincount(rank)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            break
        key = rank[open_] * np.int64(n + 1) + after[open_]
        by = np.argsort(key, kind="stable")
        key, open_ = key[by], open_[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = rank[open_]
        first = np.concatenate(([True], group[1:] != group[:-1]))
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        within = np.arange(len(open_)) - np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(open_))))
        order[start[group] + within] = open_
        fresh = np.zeros(n, bool)
        fresh[start] = True
        fresh[(start[group] + within)[new]] = True
        rank[order] = np.cumsum(fresh) - 1
        width *= 2
    return order


def find(tokens: np.ndarray, array: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of queries, the range of the suffix array whose suffixes begin with it. tokens end in as many 0 as a query is wide."""
    width, bounds = queries.shape[1], []
    for right in (False, True):
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(array), np.int64)
        while (live := lo < hi).any():
            mid = (lo + hi) // 2
            at = array[np.minimum(mid, len(array) - 1)]
            less, equal = np.zeros(len(queries), bool), np.ones(len(queries), bool)
            for k in range(width):
                t = tokens[at + k]
                less |= equal & (t < queries[:, k])
                equal &= t == queries[:, k]
                if not equal.any():
                    break
            up = live & (less | equal if right else less)
            lo = np.where(up, mid + 1, lo)
            hi = np.where(live & ~up, mid, hi)
        bounds.append(lo)
    return bounds[0], bounds[1]


class Shard:
    """The words of some texts, a 0 between two texts, with their suffix array."""

    def __init__(self, tokens: np.ndarray, row: np.ndarray, array: np.ndarray):
        self.tokens, self.row, self.array = tokens, row, array

    @classmethod
    def of(cls, texts: pa.Array, depth: int) -> Shard:
        h, row = words(texts)
        gap = np.flatnonzero(row[1:] != row[:-1]) + 1
        h, row = np.insert(h, gap, 0), np.insert(row, gap, -1)
        return cls(h, row, suffix_array(h, depth) if len(h) >= depth else np.empty(0, np.int64))


class Items:
    """A block of test items: the hashes of all items' words, a 0 after each, and the item of each."""

    def __init__(self, hashes: list[np.ndarray], ids: list[int], min_words: int):
        self.tokens = np.concatenate([x for a in hashes for x in (a, np.zeros(1, np.uint64))])
        self.of = np.repeat(np.arange(len(hashes)), [len(a) + 1 for a in hashes])
        self.ids, self.min_words = np.array(ids), min_words
        self.ends = np.cumsum([len(a) + 1 for a in hashes]) - 1
        self.starts = self.ends - np.array([len(a) for a in hashes])

    def suffixes(self) -> np.ndarray:
        """Where min_words words or more of an item follow."""
        at = np.arange(len(self.tokens))
        return at[at + self.min_words <= self.ends[self.of]]


_KEYS = ("row", "item", "words", "doc_at", "item_at")


def _longest(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The longest match of each row and item, the first of equals."""
    order = np.lexsort((found["item_at"], found["doc_at"], -found["words"], found["item"], found["row"]))
    f = {k: v[order] for k, v in found.items()}
    first = np.append(True, (f["row"][1:] != f["row"][:-1]) | (f["item"][1:] != f["item"][:-1]))[: len(order)]
    return {k: v[first] for k, v in f.items()}


def longest_matches(shard: Shard, items: Items) -> dict[str, np.ndarray]:
    """row, item, words, doc_at and item_at (words before the match) of the longest match of each pair in one shard."""
    best = {k: np.empty(0, np.int64) for k in _KEYS}
    suffixes, least = items.suffixes(), items.min_words
    if not len(shard.array) or not len(suffixes):
        return best
    tokens = np.concatenate((shard.tokens, np.zeros(least, np.uint64)))
    lo, hi = find(tokens, shard.array, items.tokens[suffixes[:, None] + np.arange(least)])
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return best
    begins, lo, n = suffixes[hit], lo[hit], (hi - lo)[hit]
    upto = np.concatenate(([0], np.cumsum(n)))
    texts, tests = Rolling(shard.tokens), Rolling(items.tokens)
    # where each text begins and ends
    edge = np.flatnonzero(np.concatenate(([True], shard.tokens == 0, [True])))
    for a in range(0, int(upto[-1]), MAX_PLACES):
        flat = np.arange(a, min(a + MAX_PLACES, int(upto[-1])))
        which = np.searchsorted(upto, flat, "right") - 1
        place, begin = shard.array[lo[which] + flat - upto[which]], begins[which]
        left = np.where(place > 0, shard.tokens[np.maximum(place, 1) - 1], 0)
        asked = np.where(begin > 0, items.tokens[np.maximum(begin, 1) - 1], 0)
        whole = (left != asked) | (left == 0)
        place, begin = place[whole], begin[whole]
        k = np.searchsorted(edge, place, "right")
        most = np.minimum(edge[k] - 1 - place, items.ends[items.of[begin]] - begin)
        size, beyond = np.full(len(place), least, np.int64), most + 1
        while (live := beyond - size > 1).any():
            middle = np.where(live, (size + beyond) // 2, size)
            same = texts.of(place, place + middle) == tests.of(begin, begin + middle)
            size, beyond = np.where(live & same, middle, size), np.where(live & ~same, middle, beyond)
        fresh = {"row": shard.row[place], "item": items.of[begin], "words": size, "doc_at": place - edge[k - 1], "item_at": begin - items.starts[items.of[begin]]}
        best = _longest({key: np.concatenate((best[key], fresh[key])) for key in _KEYS})
    return best


def _blocks(items: DataFrame, min_words: int) -> Iterator[Items]:
    """The test items in blocks, one on the driver at a time."""
    hashes: list[np.ndarray] = []
    ids: list[int] = []
    tests = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null and item_id is not null")
    for item in tests.toLocalIterator():
        h, _ = words(pa.array([item["text"]], pa.large_string()))
        if len(h) < min_words:
            continue
        if hashes and sum(map(len, hashes)) + len(h) > MAX_BLOCK_WORDS:
            yield Items(hashes, ids, min_words)
            hashes, ids = [], []
        hashes.append(h)
        ids.append(item["item_id"])
    if hashes:
        yield Items(hashes, ids, min_words)


SHARD = "docs array<long>, tokens binary, row binary, places binary"


def _shards(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[pa.Array, Shard]]:
    for batch in batches:
        for part in slices(batch, "text", SHARD_BYTES):
            yield part.column("doc_id"), Shard.of(strings(part.column("text")), depth)


def _written(depth: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, s in _shards(batches, depth):
            parts = [pa.array([x.tobytes()], pa.binary()) for x in (s.tokens, s.row.astype(np.int64), s.array.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([docs.to_pylist()], pa.list_(pa.int64())), *parts], names=["docs", "tokens", "row", "places"])

    return task


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Shard]]:
    for batch in batches:
        for k in range(batch.num_rows):
            t, r, p = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in (("tokens", np.uint64), ("row", np.int64), ("places", np.int64)))
            yield batch.column("docs")[k].values, Shard(t, r, p)


FOUND = "doc_id long, item_id long, match_words long, doc_at long, item_at long"


def _search(block: Items, written: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, shard in _read(batches) if written else _shards(batches, block.min_words):
            m = longest_matches(shard, block)
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(m["row"])), pa.array(block.ids[m["item"]].astype(np.int64)), *(pa.array(m[k]) for k in ("words", "doc_at", "item_at"))], names=["doc_id", "item_id", "match_words", "doc_at", "item_at"])

    return task


def contaminated(corpus: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, match_words, doc_at, item_at) of each document that holds min_words consecutive words of an item: the longest run, and the words before it in both."""
    rows = corpus.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text <> ''")
    blocks = _blocks(items, min_words)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return corpus.sparkSession.createDataFrame([], FOUND)
    if second is None:
        found = rows.mapInArrow(_search(first, False), FOUND)
    else:
        shards = materialize(rows.mapInArrow(_written(min_words), SHARD))
        found = materialize(shards.mapInArrow(_search(first, True), FOUND))
        del first
        while second is not None:
            found = found.unionByName(materialize(shards.mapInArrow(_search(second, True), FOUND)))
            second = next(blocks, None)
    # a document's rows are one shard's, but ids may repeat
    place = F.struct("match_words", -F.col("doc_at"), -F.col("item_at"))
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("match_words", "doc_at", "item_at"), place).alias("m"))
    return best.select("doc_id", "item_id", "m.*")


def decontaminated(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """corpus without the documents found."""
    return corpus.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
