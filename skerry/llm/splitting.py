"""Texts over a size limit cut into overlapping pieces at natural boundaries.

Recursive bisection: a text longer than the limit is cut at the strongest
boundary near its midpoint (between paragraphs, lines, sentences, clauses,
words; the middle itself where there is none), and each half longer than the
limit minus the overlap is cut again. Each piece but the first is then led by
the overlap: the last characters before it.

Cases: lengths are Unicode characters after spaces, tabs and line ends are
removed from both ends; a null or short text is not cut; a text without any
boundary is cut at midpoints, but not before a combining mark; keys may be null
or repeated, each row is cut by itself; a limit of null or below 1 limits nothing, an
overlap of null or below 0 counts as 0, one of the limit or more as the limit less 1;
empty tables give empty results. Plan:
one scan, no shuffle; the limits table is broadcast, it holds one row an item kind.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Boundaries, the strongest first; the cut stands after the match.
BOUNDARIES = [re.compile(x) for x in (r"\n[ \t\r]*\n\s*", r"\n\s*", r"[.!?।。…][\"'”’»)\]]*\s+", r"[,;:)–—]\s+", r"\s+")]


def spans(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """The [start, end) that partition text: one if it fits, else each up to max_chars - overlap long."""
    if max_chars <= overlap or max_chars < 1 or overlap < 0:
        raise ValueError("the limit must be larger than the overlap")
    if len(text) <= max_chars:
        return [(0, len(text))]
    cuts = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]
    done, open_ = [], [(0, len(text))]
    while open_:
        s, e = open_.pop()
        if e - s <= max_chars - overlap:
            done.append((s, e))
            continue
        middle, reach, cut = (s + e) / 2, (e - s) // 4, 0
        for at in cuts:
            i = bisect_left(at, middle)
            near = [x for x in at[max(0, i - 1) : i + 1] if s < x < e and abs(x - middle) <= reach]
            if near:
                cut = min(near, key=lambda x: (abs(x - middle), x))
                break
        if not cut:
            cut = int(middle)
            while cut < e - 1 and cut - middle <= reach and unicodedata.combining(text[cut]):
                cut += 1
        open_ += [(cut, e), (s, cut)]
    return done


def pieces(text: str, max_chars: int, overlap: int) -> list[str]:
    """The pieces of a trimmed text, each but the first led by the overlap characters before it."""
    return [text[max(0, s - overlap if s else 0) : e] for s, e in spans(text, max_chars, overlap)]


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n"))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["item_kind", "item_key", "piece_no", "start_at", "piece"]
    for batch in batches:
        # a text and its pieces at a time, however long the batch
        for part in slices(batch, "text"):
            for kind, key, text, size, over in zip(*(part.column(c).to_pylist() for c in ("item_kind", "item_key", "text", "max_chars", "overlap_chars"))):
                cut = spans(text, size, over)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind] * len(cut), pa.string()),
                        pa.array([key] * len(cut), pa.string()),
                        pa.array(range(1, len(cut) + 1), pa.int32()),
                        pa.array([max(0, s - over) for s, _ in cut], pa.int32()),
                        pa.array([text[max(0, s - over) : e] for s, e in cut], pa.string()),
                    ],
                    names=names,
                )


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces (item_kind, item_key, piece_no, start_at, piece) of each item over its kind's limit.

    items: item_kind, item_key, text. limits: item_kind, max_chars, overlap_chars.
    """
    rows = items.select("item_kind", F.col("item_key").cast("string").alias("item_key"), trimmed(F.col("text")).alias("text"))
    over = F.least(F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)), F.col("max_chars") - 1)
    limit = limits.filter("max_chars >= 1").select("item_kind", "max_chars", over.alias("overlap_chars"))
    over = rows.join(F.broadcast(limit), "item_kind").filter(F.length("text") > F.col("max_chars"))
    return over.mapInArrow(_split, "item_kind string, item_key string, piece_no int, start_at int, piece string")


def oversized(split: DataFrame) -> DataFrame:
    """(item_kind, item_key) of the items that were cut: those with a second piece."""
    return split.filter("piece_no = 2").select("item_kind", "item_key")
