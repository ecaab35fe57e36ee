"""Lines repeated across one site's pages: found by content-defined chunks, then cut out.

Each text is read as one stream of bytes in lower case without spaces, tabs and line
ends and with runs of digits as one digit. A rolling hash over a window of WINDOW bytes of that
stream sets the cuts, wherever lines end (content-defined chunking). Lines are mapped to
chunks after: a chunk whose two cuts were set by bytes of one line alone is that line's, and
the same wherever the line stands. Pages are counted for each chunk of each site; a line of which all
chunks are repeated is a candidate, and an exact count of the whole line's hash
decides. A line that holds no chunk of its own, because it is short, counts as one chunk.

Plan: two scans of the text column. The first emits counts aggregated in each
batch, so that a site or chunk that holds a third of the rows arrives as a few
rows a batch. A chunk on a tenth of a site's pages can occur at most ten times
a page on average, so the table of repeated chunks is small by proof; Spark
broadcasts it if its measured size allows, and joins by shuffle otherwise.

Cases: a null or empty text has no lines; blank lines are counted in line_no but
never found; copied rows count as pages of their own; null urls form one site;
a page with a null id is counted and found as null; a text without line ends is one
line; empty tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Rolling, mixed, raw, site_of, slices, strings

#: Bytes of the rolling window, and the mask whose zero is a cut: chunks of 32 bytes on average.
WINDOW, MASK = 8, np.uint64(31)
MIN_PAGES, MIN_SHARE = 3, 0.1


def chunked(texts: pa.Array) -> dict[str, np.ndarray]:
    """Of each line's chunks: row, line_no, line (hash of its line), units (chunks of that line) and unit (its own hash)."""
    data, bounds = raw(pc.utf8_lower(texts))
    none = np.empty(0, np.int64)
    if not len(data):
        return {"row": none, "line_no": none, "line": none, "units": none, "unit": none}
    newline = data == 10
    before = np.cumsum(newline) - newline
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    digit = (data >= 48) & (data <= 57)
    follows = np.zeros(len(data), bool)
    follows[1:] = digit[1:] & digit[:-1] & (row[1:] == row[:-1])
    kept = np.flatnonzero(~(newline | (data == 32) | (data == 9) | follows))
    if not len(kept):
        return {"row": none, "line_no": none, "line": none, "units": none, "unit": none}
    rolling = Rolling(BYTE_VALUES[np.where(digit, 48, data)[kept]])
    line = (before + row)[kept]
    starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    ends = np.append(starts[1:], len(kept))
    # the cuts of the stream, by content alone
    at = np.arange(WINDOW, len(kept) + 1)
    cuts = at[mixed(rolling.of(at - WINDOW, at)) & MASK == 0]
    # chunks between cuts whose windows lie within one line
    frm, to = cuts[:-1], cuts[1:]
    of = np.searchsorted(starts, frm, "right") - 1 if len(frm) else none
    own = (frm - WINDOW >= starts[of]) & (to <= ends[of]) if len(frm) else np.empty(0, bool)
    frm, to, of = frm[own], to[own], of[own]
    # lines without a chunk are one
    alone = np.flatnonzero(np.bincount(of, minlength=len(starts)) == 0)
    frm, to, of = np.concatenate((frm, starts[alone])), np.concatenate((to, ends[alone])), np.concatenate((of, alone))
    whole = mixed(rolling.of(starts, ends) + (ends - starts).astype(np.uint64)).view(np.int64)
    first = kept[starts]
    return {
        "row": row[first][of],
        "line_no": (before[first] - before[np.minimum(bounds[:-1], len(data) - 1)][row[first]] + 1)[of],
        "line": whole[of],
        "units": np.bincount(of, minlength=len(starts))[of],
        "unit": mixed(rolling.of(frm, to) + (to - frm).astype(np.uint64)).view(np.int64),
    }


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            c = chunked(strings(part.column("text")))
            pairs = np.unique(np.stack([c["row"], c["unit"]]), axis=1) if len(c["row"]) else np.empty((2, 0), np.int64)
            site = part.column("site").to_numpy()[pairs[0]]
            keys, n = np.unique(np.stack([site, pairs[1]]), axis=1, return_counts=True) if len(site) else (pairs, np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(n.astype(np.int64))], names=["site", "unit", "pages"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # a number for each row of the scan, as ids may be null
    at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    for batch in batches:
        for part in slices(batch, "text"):
            c = chunked(strings(part.column("text")))
            rows = pa.array(c["row"] + at)
            at += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [rows, part.column("page_id").take(pa.array(c["row"])), part.column("site").take(pa.array(c["row"])), *(pa.array(c[k].astype(np.int64)) for k in ("line_no", "line", "units", "unit"))],
                names=["row", "page_id", "site", "line_no", "line", "units", "unit"],
            )


def repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, line_no) of each non-blank line on at least min_pages and min_share of its site's rows."""
    rows = pages.select(F.col("id").cast("bigint").alias("page_id"), F.xxhash64(site_of()).alias("site"), F.col("content_text").alias("text"))
    sites = rows.groupBy("site").agg(F.greatest(F.lit(min_pages), F.ceil(F.count("*") * F.lit(str(min_share)).cast("decimal(10,9)"))).alias("least"))
    units = rows.select("site", "text").mapInArrow(_counts, "site long, unit long, pages long").groupBy("site", "unit").agg(F.sum("pages").alias("pages"))
    repeated = units.join(sites, "site").filter("pages >= least").select("site", "unit")
    candidates = (
        rows.mapInArrow(_lines, "row long, page_id long, site long, line_no long, line long, units long, unit long")
        .join(repeated, ["site", "unit"], "left_semi")
        .groupBy("row", "page_id", "site", "line_no", "line", "units")
        .count()
        .filter("count = units")
        .groupBy("row", "page_id", "site", "line")
        .agg(F.collect_set("line_no").alias("at"))
    )
    exact = candidates.groupBy("site", "line").count().join(sites, "site").filter("count >= least").select("site", "line")
    return candidates.join(exact, ["site", "line"], "left_semi").select("page_id", F.explode("at").alias("line_no")).withColumn("line_no", F.col("line_no").cast("int"))


def without_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, clean_text): content_text without the given (page_id, line_no); a null text stays null."""
    gone = lines.groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    rows = pages.select(F.col("id").cast("bigint").alias("page_id"), F.col("content_text").alias("text"))
    kept = F.filter(F.split("text", "\n", -1), lambda line, at: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), (at + 1).cast("int")))
    return rows.join(gone, "page_id", "left").select("page_id", F.array_join(kept, "\n").alias("clean_text"))
