"""A question answered from chunks and their vectors, by interfaces for the two models.

An embedder turns texts into vectors, a generator turns messages into an answer;
both are functions that the caller provides. ``hashed_embedding`` is a stand-in for
tests: hashed words, not a language model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import rules as rl
from . import conversation as cv
from . import retrieval as rt
from . import vector_index as vx

Embedder = Callable[[list[str]], np.ndarray]
Generator = Callable[[list[dict[str, str]]], str]
FALLBACK_CHUNKS = 3
NO_ANSWER = "No relevant information was found for this question."


def hashed_embedding(texts: list[str], size: int = 64) -> np.ndarray:
    out = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = xxhash.xxh64_intdigest(w)
            out[i, h % size] += 1 if h >> 63 else -1
        out[i] /= max(1e-9, float(np.linalg.norm(out[i])))
    return out


def embedded(chunks: DataFrame, embed: Embedder = hashed_embedding, batch: int = 64) -> DataFrame:
    """chunks with embedding, in batches of texts."""

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in columns:
            parts = [embed([t or "" for t in texts[i : i + batch]]) for i in range(0, len(texts), batch)]
            yield pd.Series([v for p in parts for v in p.tolist()], dtype=object)

    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return chunks.withColumn("embedding", F.pandas_udf(run, "array<float>")("text"))


def _schema(chunks: DataFrame, row) -> T.StructType:
    extra = {"score": T.DoubleType(), "rank": T.LongType(), "kind": T.StringType(), "hits": T.LongType()}
    return T.StructType([T.StructField(n, chunks.schema[n].dataType if n in chunks.columns else extra[n]) for n in row.__fields__])


@dataclass
class Answer:
    question: str
    text: str
    kind: str
    sources: list[str] = field(default_factory=list)
    fallback: bool = False


def retrieved(chunks: DataFrame, question: str, kinds: rl.Rules, embed: Embedder = hashed_embedding, k: int = rt.TOP_K, least: float = rt.LEAST_SCORE) -> DataFrame:
    """The chunks for a question: best of each node, enriched for missions, ranked, cut to the budget. chunks: chunk columns, seq, embedding."""
    spark = chunks.sparkSession
    kind = spark.range(1).select(rt.question_kind(F.lit(question), kinds)).first()[0]
    vector = [float(x) for x in embed([question])[0]]
    best = vx.search(chunks, vector, 2 * k, least, "node_id", "seq")
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "seq")))
    if kind in ("mission", "payload"):
        best = rt.enriched(best, chunks, k)
    return rt.within_budget(rt.reranked(best, kind)).withColumn("kind", F.lit(kind))


def ask(chunks: DataFrame, question: str, history: list[dict[str, str]], generate: Generator, kinds: rl.Rules = (), embed: Embedder = hashed_embedding) -> Answer:
    """Answer a question and append both to the history, which is cut to the last turns. Without chunks by vector, keywords are tried."""
    question = question.strip()
    if not question:
        return Answer(question, NO_ANSWER, "general", fallback=True)
    # at most a few rows: the budget bounds them
    found = retrieved(chunks, question, kinds, embed).orderBy("rank").collect()
    fallback = not found
    if fallback:
        found = rt.keyword_search(chunks, question, FALLBACK_CHUNKS).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "seq"))).orderBy("rank").collect()
    rows = chunks.sparkSession.createDataFrame(found, _schema(chunks, found[0])) if found else None
    context, sources = cv.NOTHING, []
    if rows is not None:
        rows = rows.withColumn("q", F.lit(question))
        context = cv.context_blocks(rows, "q").first()["context"]
        sources = [r["source"] for r in cv.source_rows(rows, "q").orderBy("rank").collect()]
    text = generate([*history, {"role": "user", "content": f"<context>\n{context}\n</context>\n\nQuestion: {question}"}]) if found else NO_ANSWER
    history += [{"role": "user", "content": question}, {"role": "assistant", "content": text}]
    del history[: max(0, len(history) - 2 * cv.MAX_TURNS)]
    return Answer(question, text, found[0]["kind"] if found and "kind" in found[0] else "general", sources, fallback)
