"""Sources mixed to target shares of the total size in tokens.

Weights. The sources' token shares are tempered: a source's weight is its share times
(target / share) ** exponent, normalised; exponent 1 gives the targets, 0 the natural
shares, and without targets the target is the same for all, so that the weight is share ** (1 - exponent).
Bisection finds the largest exponent in [0, 1] at which, for the budget of tokens asked for, no source must repeat its
documents more often than its limit (and at which the weights' entropy is no more than asked for, if it is). Without a
budget, the mix is as large as the repetition limits allow at the targets themselves, so
that the bisection ends at exponent 1 and every share is met.

Realisation by budgeted block permutations: a source is taken in epochs, each a
permutation of its documents by a hash of (seed, epoch, id). Whole epochs are
taken as long as the source's budget of tokens lasts, and of the last one the head
of the permutation. The head is found by blocks of the hash's range: tokens are
summed by block and by SPAN blocks, whole spans and then whole blocks are taken by running sums, and only the
block in which the budget ends is sorted, so that no task sorts a whole source,
however large. BLOCK_DOCS documents are expected in a block. Each use of a document comes
out with its epoch, its block and its position in the block: read in this order, the mix is a
permutation in every epoch.

Plan: one Arrow pass counts tokens (the tokenizer's file is a parameter, is sent to the
executors once and read once a task); ids and sizes alone are shuffled, aggregated by source and
block; the tables of sources are small (one row a source of the targets). Texts are joined in only by the caller.

Cases: sources are compared without case, outer spaces and with "_" for spaces and
hyphens; documents with null or empty text, null source or null id, and sources
without a target are not used; a target without documents has actual share 0, and
the others keep their proportions; copied rows are documents of their own; max_repeats below 1 or
null counts as 1, a target share of null or below as 0; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Public vocabulary by which sizes are measured.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_DOCS, SPAN = 2_000, 1_000
SEED = 17
#: How the vocabulary's public tokenizer cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(c)), r"[\s\-]+", "_")


def _counter(name: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    return task


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of the documents that can be mixed, written once."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), "text").filter("doc_id is not null and source <> '' and text <> ''")
    documents.sparkSession.sparkContext.addFile(tokenizer)
    return materialize(rows.mapInArrow(_counter(os.path.basename(tokenizer)), "doc_id long, source string, tokens long").filter("tokens > 0"))


def tempered(tokens: dict[str, int], targets: dict[str, float] | None = None, entropy: float | None = None, max_repeats: dict[str, int] | None = None, budget: float | None = None) -> tuple[float, dict[str, float]]:
    """(exponent, weights) by the largest exponent in [0, 1] that keeps the limits, found by bisection; 0 if none does.

    entropy in nats bounds the weights' entropy; max_repeats with a budget of tokens bounds how often a source repeats.
    """
    total = sum(tokens.values())
    share = {s: t / total for s, t in tokens.items() if t > 0}
    aim = {s: (targets[s] if targets else 1.0) for s in share if not targets or targets.get(s, 0) > 0}

    def at(a: float) -> dict[str, float]:
        p = {s: math.exp(math.log(share[s]) + a * (math.log(aim[s]) - math.log(share[s]))) for s in aim}
        n = sum(p.values())
        return {s: x / n for s, x in p.items()}

    def kept(a: float) -> bool:
        w = at(a)
        if entropy is not None and -sum(x * math.log(x) for x in w.values() if x > 0) > entropy * (1 + 1e-12):
            return False
        # up to a token of rounding
        return budget is None or all(w[s] * budget <= max(1, (max_repeats or {}).get(s, 1)) * tokens[s] + 1 for s in w)

    if not aim:
        return 0.0, {}
    lo, hi = 0.0, 1.0
    if kept(hi):
        return hi, at(hi)
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if kept(mid) else (lo, mid)
    return lo, at(lo)


def plan(sizes: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, budget, exponent) of each target source; budget is what the source gives."""
    spark = sizes.sparkSession
    t = targets.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats"))
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    # one row a source of the targets
    rows = t.join(have, "source", "left").fillna(0, ["docs", "tokens"]).collect()
    live = [r for r in rows if r["tokens"] and r["target_share"]]
    weight = sum(r["target_share"] for r in live)
    size = budget if budget is not None else min((int(r["max_repeats"] * r["tokens"] / (r["target_share"] / weight)) for r in live), default=0)
    tokens, limits = {r["source"]: r["tokens"] for r in live}, {r["source"]: r["max_repeats"] for r in live}
    exponent, w = tempered(tokens, {r["source"]: r["target_share"] / weight for r in live}, max_repeats=limits, budget=size)
    # beyond what all documents at their limits hold, or what the natural shares allow, the mix is as large as it can be
    size = min([size, *(limits[s] * tokens[s] / w[s] for s in w)])
    out = [(r["source"], r["target_share"], r["max_repeats"], r["docs"], r["tokens"], int(size * w.get(r["source"], 0.0)), exponent) for r in rows]
    return spark.createDataFrame(out, "source string, target_share double, max_repeats int, docs long, tokens long, budget long, exponent double")


def mix(sizes: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, epoch, block, position): each use of a document; those not used have no row."""
    p = F.broadcast(planned.filter("budget > 0 and tokens > 0").select("source", "max_repeats", "docs", F.col("tokens").alias("all_tokens"), "budget"))
    whole_epochs = F.least(F.expr("try_divide(budget, all_tokens)").cast("int"), F.col("max_repeats"))
    rows = sizes.join(p, "source").withColumn("epochs", whole_epochs)
    rows = rows.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("all_tokens")).otherwise(0))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs") + F.when(F.col("rest") > 0, 1).otherwise(0)))).filter("epoch > 0 and (rest > 0 or epoch <= epochs)")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("bigint")
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed), F.col("epoch"), F.col("doc_id")))
    rows = rows.withColumn("block", F.floor(F.shiftrightunsigned("place", 33) * blocks / float(1 << 31)).cast("bigint")).withColumn("span", F.floor(F.col("block") / SPAN).cast("bigint"))
    last = F.col("epoch") > F.col("epochs")
    sums = rows.filter(last).groupBy("source", "span", "block", "rest").agg(F.sum("tokens").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sums.groupBy("source", "span", "rest").agg(F.sum("n").alias("n")).withColumn("ahead", earlier(Window.partitionBy("source").orderBy("span"))).filter("ahead < rest").select("source", "span", "ahead")
    cut = sums.join(spans, ["source", "span"]).withColumn("before", F.col("ahead") + earlier(Window.partitionBy("source", "span").orderBy("block"))).filter("before < rest")
    cut = cut.select("source", "block", F.lit(True).alias("reached"), "before", "n")
    rows = rows.join(cut, ["source", "block"], "left")
    inside = F.col("before") + F.col("n") <= F.col("rest")
    rows = rows.filter(~last | F.col("reached"))
    w = Window.partitionBy("source", "epoch", "block").orderBy("place", "doc_id", "tokens")
    rows = rows.withColumn("position", F.row_number().over(w)).withColumn("upto", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter(~last | inside | (F.col("before") + F.col("upto") <= F.col("rest"))).select("doc_id", "source", "tokens", "epoch", "block", "position")


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, target_share, docs_used, tokens_used, actual_share, most_repeats) of each target source."""
    # the first epoch holds each document that is used at all
    got = mixed.groupBy("source").agg(F.sum(F.when(F.col("epoch") == 1, 1).otherwise(0)).alias("docs_used"), F.sum("tokens").alias("tokens_used"), F.max("epoch").alias("most_repeats"))
    rows = planned.select("source", "target_share").join(got, "source", "left").fillna(0, ["docs_used", "tokens_used", "most_repeats"])
    total = rows.agg(F.sum("tokens_used").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("source", "target_share", "docs_used", "tokens_used", F.when(F.col("total") > 0, F.col("tokens_used") / F.col("total")).otherwise(0.0).alias("actual_share"), "most_repeats")


def temperature_report(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, tokens, natural_share, weight, exponent): weights by temperature at the entropy of the targets, without their order, for the sources of the targets that have documents."""
    spark = sizes.sparkSession
    planned = plan(sizes, targets).filter("tokens > 0 and target_share > 0").collect()
    have, aim = {r["source"]: r["tokens"] for r in planned}, {r["source"]: r["target_share"] for r in planned}
    n, total = sum(aim.values()), sum(have.values())
    exponent, w = tempered(have, entropy=-sum(x / n * math.log(x / n) for x in aim.values())) if have else (1.0, {})
    return spark.createDataFrame([(s, t, t / total, w.get(s, 0.0), exponent) for s, t in have.items()], "source string, tokens long, natural_share double, weight double, exponent double")
