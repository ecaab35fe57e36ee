"""Texts cut into overlapping chunks by a window that prefers natural ends.

The window holds max_chars characters. If it doesn't reach the end of the text, it is
cut back to the last blank line in it, else to the last sentence end or line end by
priority, if that lies in its second half; the next window starts overlap
characters before the cut, which needs overlap < max_chars // 2 + 1, else a window
might not advance.

Plan: one Arrow function over batches of texts and an explode, no shuffle. As a fold in
native expressions the same takes some twenty times as long, because each step copies its
window for every separator.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

MAX_CHARS, OVERLAP, LEAST = 1500, 200, 20
#: Ends by priority after the blank line; the cut keeps the first character.
SEPARATORS = (". ", "? ", "! ", "\n")
#: The blank characters that text.strip removes.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def windows(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """The [start, end) of the windows of a text."""
    out, at, half = [], 0, max_chars // 2
    while at + max_chars < len(text):
        end = text.rfind("\n\n", at, at + max_chars)
        if end - at <= half:
            ends = (text.rfind(x, at, at + max_chars) + 1 for x in SEPARATORS)
            end = next((e for e in ends if e - 1 - at > half), at + max_chars)
        out.append((at, end))
        at = end - overlap
    return [*out, (at, len(text))]


def split_text(c: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """array<string> of the chunks of a text; a text that fits is one chunk, in others chunks of up to least characters are dropped."""
    if not 0 <= overlap < max_chars // 2 + 1:
        raise ValueError("overlap must be smaller than half a window")

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            t = (t or "").strip(BLANK)
            if len(t) <= max_chars:
                out.append([t] if t else [])
            else:
                out.append([p for p in (t[a:b].strip(BLANK) for a, b in windows(t, max_chars, overlap)) if len(p) > least])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<string>")(c)


def chunk_rows(df: DataFrame, key: str, text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, mark: str = "") -> DataFrame:
    """(key, chunk_id, chunk_index, total_chunks, text, char_count) of each row's chunks; chunk_id is the key, a mark and the index."""
    rows = df.select(F.col(key), split_text(F.col(text), max_chars, overlap).alias("_p"))
    rows = rows.select(key, F.size("_p").alias("total_chunks"), F.posexplode("_p").alias("chunk_index", "text"))
    name = F.concat(F.col(key).cast("string"), F.lit(f":{mark}:" if mark else ":"), F.col("chunk_index"))
    return rows.select(key, name.alias("chunk_id"), "chunk_index", "total_chunks", "text", F.length("text").alias("char_count"))


def faq_text(question: Column, answer: Column, text: Column) -> Column:
    both = (tx.text_or_empty(question) != "") & (tx.text_or_empty(answer) != "")
    return F.when(both, F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), answer)).otherwise(text)


def cleaned(chunks: DataFrame) -> DataFrame:
    """Chunks with clean text, the invalid dropped, char_count counted again."""
    c = tx.clean_chunk(F.col("text"))
    return chunks.withColumn("text", c).filter(tx.valid_chunk(F.col("text"))).withColumn("char_count", F.length("text"))
