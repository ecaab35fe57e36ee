"""Statistics of each page's text, and what kind of text its main body is.

Thresholds on statistics are noisy labelling functions: those of a line (its share of
symbols and of common words, the length of its words, its end, its marks), and those of the document that
it stands in (the five statistics of the result). Each votes for one kind (prose, list,
table, junk) or abstains. How often each fires on lines of each kind is learned by
expectation-maximization from their agreements alone, and each line gets the
posterior over the kinds. A page's posterior is the mean of its main body's lines,
weighted by their characters, that is the share of each kind that is expected. Its
kind is the one that is likeliest on lines with more than half of the characters, else the
one whose expected share is more than half.

Which functions fire on a line is a mask of len(FUNCTIONS) bits, so the lines of
any corpus fall into at most 2 ** len(FUNCTIONS) = 524,288 patterns: EM runs over
the counts of the patterns that occur, gathered from all lines, and the posteriors are a table of
that bounded size.

Plan: one Arrow pass a page emits the statistics and (mask, characters) pairs,
summed within the page; counts by mask are aggregated with partial sums; the
posterior table is joined by broadcast, by the bound above.

Cases: a null text has null statistics and no finding; an empty text has 0 words;
blank lines and noise lines are not judged; a page on which no kind is expected on more than
half of the characters, or without any line to judge, has no kind; copies are judged each;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, runs
from .pairs import STOPWORDS

KINDS = ("prose", "list", "table", "junk")
#: The labelling functions and the kinds that each votes for.
FUNCTIONS = (
    ("bullet", "list"),
    ("enumerator", "list"),
    ("separated_cells", "table"),
    ("comma_cells", "table"),
    ("name_and_value", "table"),
    ("many_symbols", "junk"),
    ("code_signs", "junk"),
    ("long_tokens", "junk"),
    ("odd_letters", "junk"),
    ("repeated_words", "junk"),
    ("sentence_end", "prose"),
    ("common_words", "prose"),
    ("sentence_shape", "prose"),
    ("short_line", "list"),
    ("page_of_few_common_words", "list table junk"),
    ("page_of_symbols", "list table junk"),
    ("page_of_long_words", "list table junk"),
    ("page_of_sentence_ends", "prose"),
    ("page_of_few_ends", "list table junk"),
)
#: Weight of a vote on the document's statistics, which all its lines share, against one on the line.
SHARED = 0.2
COMMON = frozenset(w for words in STOPWORDS.values() for w in words) | set("का के की है हैं में से पर को ने और एक यह नहीं तक लिए गया रही जाता करें हर वर्ष बाद होते सकते".split())

BULLET = re.compile(r"\s*(?:[•◦▪‣●○■□–—*+·-]|&bull;)\s+(?=[\w“\"'(\[])")
ENUMERATOR = re.compile(r"\s*(?:\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]|#\d+)\s+\S")
CODE = re.compile(r"[;{}]\s*$|\w\(.*\)\s*[;{]|[\w\]]\s*(?:===?|=>|\+=|!=|:=|&&|\|\|)\s*\S|^\s*(?:var|let|const|function|return|import|#include|def|class|if|for|while)\b.*[({=;:]|^\s*[.#@][\w-]+[\w-]*\s*\{|</?\w+[^>]*>|\b0x[0-9a-f]+\b|^[\s0-9a-f]*(?:[0-9a-f]{2,8}[ :]){5,}|^\s*\$ |\b\w+\.\w+\(")
VALUE = re.compile(r"\s*[^:=|\d][^:=|]{0,60}\s*[:=]\s*[-+±<>~]?\d[\d.,:/-]*\s*\S{0,8}(?:\s\S{0,10}){0,3}\s*$")
NUMBER = re.compile(r"[-+]?\d[\d.,]*%?$")
SYMBOLS = re.compile(r"[^\w\sऀ-ॿ]|_")
RUN = re.compile(r"([^\w\s.])\1{4,}")
_GAPS, _WORDY, _LETTERS, _COMMAS, _AFTER = re.compile(r" {3,}"), re.compile(r"\w"), re.compile(r"[^\W\d_]{2}"), re.compile(r"[,;]"), re.compile(r"[,;] ")
_CLUSTERS, _VOWELS = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}|[a-z]\d+[a-z]|\d[a-z]+\d[a-z]*\d|[a-z0-9+/=]{25}"), re.compile(r"[aeiouy]")


_PLAIN = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b).isspace())


def _symbols(text: str) -> int:
    """How many characters are neither letters, digits, marks nor spaces."""
    return len(text.encode().translate(None, _PLAIN)) if text.isascii() else len(SYMBOLS.findall(text))


def mask(line: str) -> int:
    """The functions that fire on a line, as bits."""
    text = line.strip()
    words = text.lower().split()
    n, size = len(words), len(text)
    last = text[-1] if text[-1] not in "\"'”’»)]" or size < 2 else text[-2]
    end, m = last in ".!?।…:", 0
    share = _symbols(text) / size
    common = sum(map(COMMON.__contains__, words)) / n
    letters = size - n + 1
    odd_start = not text[0].isalpha() or text[1:2] in ".)" or text[1:3] in ("i.", "i)", "v.", "v)")
    bullet = odd_start and bool(BULLET.match(text))
    number = odd_start and not bullet and bool(ENUMERATOR.match(text))
    m |= bullet << 0 | number << 1
    if common < 0.2 or n < 8:
        cells = text.split("\t") if "\t" in text else text.split(" | ") if " | " in text else text.split("|") if text.count("|") >= 2 else _GAPS.split(text) if "   " in text else ()
        if len(cells) > 1 and share < 0.3 and sum(len(c) for c in cells) / len(cells) < 40 and all(map(_WORDY.search, filter(str.strip, cells))):
            m |= 1 << 2
        if ("," in text or ";" in text) and not _AFTER.search(text) and (commas := _COMMAS.split(text))[2:] and share < 0.3 and sum(len(c) for c in commas) / len(commas) < 30:
            m |= 1 << 3
        if not bullet and not number and n <= 12 and (":" in text or "=" in text) and VALUE.match(text):
            m |= 1 << 4
    if share > 0.3 or share > 0.05 and RUN.search(text) or 8 < size < 200 and common == 0 and not m & 0b1100 and not _LETTERS.search(text):
        m |= 1 << 5
    if common < 0.25 and CODE.search(text):
        m |= 1 << 6
    if letters / n > 16 or common < 0.2 and max(map(len, words)) > 34:
        m |= 1 << 7
    if common < 0.12 and not m & 0b11100 and _odd(words):
        m |= 1 << 8
    if n >= 8 and common < 0.25 and len({w.strip(",.;") for w in words}) < 0.66 * n:
        m |= 1 << 9
    if end and n >= 5 and common > 0.08 and share < 0.15:
        m |= 1 << 10
    if n >= 5 and common >= 0.2:
        m |= 1 << 11
    if n >= 6 and 2.5 <= letters / n <= 10 and share < 0.12 and common >= 0.1 and not m & 0b11111:
        m |= 1 << 12
    if n <= 8 and not end and share < 0.15 and not m & 0b11100:
        m |= 1 << 13
    return m


def _odd(words: list[str]) -> bool:
    """Most long words have no vowels, many consonants in a row, or letters and digits mixed."""
    long = [x for w in words if len(x := w.strip(".,;:!?()\"'")) >= 4]
    odd = sum(bool(_CLUSTERS.search(w)) or w.isascii() and w.isalpha() and not _VOWELS.search(w) for w in long)
    return len(long) > 0 and odd > 0.5 * len(long)


def statistics(text: str) -> dict[str, float]:
    words = text.split()
    lines = [y for x in text.split("\n") if (y := x.strip())]
    n, size = len(words), sum(map(len, words))
    return {
        "words": n,
        "mean_word_length": size / n if n else 0.0,
        "symbol_ratio": _symbols(text) / size if size else 0.0,
        "line_end_share": sum(x[-1] in ".!?।…\"”:" for x in lines) / len(lines) if lines else 0.0,
        "common_word_share": sum(map(COMMON.__contains__, map(str.lower, words))) / n if n else 0.0,
    }


#: The first bit of the functions on the document's statistics.
_PAGE = next(i for i, (name, _) in enumerate(FUNCTIONS) if name.startswith("page_"))


def page_mask(stats: dict[str, float]) -> int:
    """The functions that fire on a document's statistics, as bits of the mask of each of its lines."""
    if not stats["words"]:
        return 0
    ends = stats["line_end_share"]
    fires = (stats["common_word_share"] < 0.08, stats["symbol_ratio"] > 0.12, stats["mean_word_length"] > 8, ends >= 0.4, ends < 0.15)
    return sum(x << (_PAGE + i) for i, x in enumerate(fires))


def learn(counts: dict[int, int], rounds: int = 40) -> np.ndarray:
    """The posterior over KINDS of each mask of counts, in their order, by EM over the counts of all masks."""
    k, f = len(KINDS), len(FUNCTIONS)
    masks, n = np.array(list(counts), np.int64), np.array(list(counts.values()), float)
    votes = (masks[:, None] >> np.arange(f)) & 1
    own = np.array([[KINDS[j] in kinds.split() for j in range(k)] for _, kinds in FUNCTIONS])
    # where each function starts, and the weight of that start against the counts: functions fire on their own kind
    start = np.where(own, 0.5, 0.03)
    weight = np.array([[SHARED if name.startswith("page_") else 1.0] for name, _ in FUNCTIONS])
    strength = 0.05 * max(1.0, n.sum()) / k
    rate, prior = start.copy(), np.array([0.7, 0.1, 0.1, 0.1])
    post = np.empty((len(masks), k))
    for _ in range(rounds):
        logp = np.log(prior) + votes @ (weight * np.log(rate)) + (1 - votes) @ (weight * np.log(1 - rate))
        post = np.exp(logp - logp.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        w = n[:, None] * post
        total = w.sum(axis=0)
        prior = (total + 0.02 * n.sum() + 1) / (total + 0.02 * n.sum() + 1).sum()
        fired, seen = votes.T @ w + strength * start, np.broadcast_to(total + strength, own.shape).copy()
        # a function that votes for several kinds has one rate on them, as it can't tell them apart
        several = np.flatnonzero(own.sum(axis=1) > 1)
        for x in (fired, seen):
            x[several] = np.where(own[several], (x[several] * own[several]).sum(axis=1, keepdims=True), x[several])
        rate = fired / seen
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
    return post


_STATS = "words bigint, mean_word_length double, symbol_ratio double, line_end_share double, common_word_share double"
#: A verdict on each page of a batch with text, noise and title.
Judge = Callable[[pa.RecordBatch], list[bool]]
_NAMES = [x.split()[0] for x in _STATS.split(", ")]
MEASURED = f"row long, page_id long, {_STATS}, body bigint, masks array<struct<mask:int,lines:int,chars:int>>, residue boolean"
_MASK = pa.struct([("mask", pa.int32()), ("lines", pa.int32()), ("chars", pa.int32())])


def _measure(batches: Iterator[pa.RecordBatch], judge: Judge | None) -> Iterator[pa.RecordBatch]:
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    for batch in runs(batches):
        stats, bodies, masks = [], [], []
        for text, noise in zip(batch.column("text").to_pylist(), batch.column("noise").to_pylist()):
            if text is None:
                stats.append({}), bodies.append(0), masks.append([])
                continue
            stats.append(statistics(text))
            whole = page_mask(stats[-1])
            lines: Counter[int] = Counter()
            chars: Counter[int] = Counter()
            for line, gone in zip(text.split("\n"), noise):
                if gone is False and line.strip():
                    m = mask(line) | whole
                    lines[m] += 1
                    chars[m] += len(line.strip())
            bodies.append(sum(chars.values()))
            masks.append([{"mask": m, "lines": lines[m], "chars": chars[m]} for m in lines])
        columns = [pa.array([s.get(x) for s in stats], pa.int64() if x == "words" else pa.float64()) for x in _NAMES]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(stats)) + row), batch.column("page_id"), *columns, pa.array(bodies, pa.int64()), pa.array(masks, pa.list_(_MASK)), pa.array(judge(batch) if judge else [False] * len(stats), pa.bool_())], names=["row", "page_id", *_NAMES, "body", "masks", "residue"])
        row += len(stats)


def measured(bodies: DataFrame, judge: Judge | None = None) -> DataFrame:
    """The statistics of each page of main_body.main_bodies, the masks of its main body's lines, and in residue what judge, asked in the same pass, says of the pages of a batch; written once."""
    return materialize(bodies.select("page_id", "title", "text", "noise").mapInArrow(lambda batches: _measure(batches, judge), MEASURED))


def page_types(measure: DataFrame) -> DataFrame:
    """(page_id, statistics, a posterior for each of KINDS, kind): kind is the one that holds more than half of the main body, or null."""
    spark = measure.sparkSession
    # at most 2 ** len(FUNCTIONS) rows
    counts = {r["mask"]: r["n"] for r in measure.select(F.explode("masks").alias("x")).groupBy("x.mask").agg(F.sum("x.lines").alias("n")).collect()}
    post = learn(counts)
    table = spark.createDataFrame([(m, KINDS[int(p.argmax())], *map(float, p)) for m, p in zip(counts, post)], "mask int, likeliest string, " + ", ".join(f"{k} double" for k in KINDS))
    # pages are told apart by a number, as ids may be null or repeated
    lines = measure.select("row", "body", F.explode("masks").alias("x")).select("row", "body", "x.*").join(F.broadcast(table), "mask")
    expected = ((F.sum(F.col(k) * F.col("chars")) / F.max("body")).alias(k) for k in KINDS)
    counted = ((F.sum(F.when(F.col("likeliest") == k, F.col("chars")).otherwise(0)) / F.max("body")).alias(f"counted_{k}") for k in KINDS)
    shares = lines.groupBy("row").agg(*expected, *counted)
    kind = F.coalesce(*(F.when(F.col(c + k) > 0.5, F.lit(k)) for c in ("counted_", "") for k in KINDS))
    return measure.select("row", "page_id", *_NAMES).join(shares.select("row", *KINDS, kind.alias("kind")), "row", "left").drop("row")


def findings(pages: DataFrame, types: DataFrame, residue: DataFrame) -> DataFrame:
    """(page_id, finding): list, table or junk (not on residue pages), and wrong_count."""
    kinds = types.filter(F.col("kind") != "prose").join(residue, "page_id", "left_anti").select("page_id", F.col("kind").alias("finding"))
    told = pages.select(F.col("id").cast("bigint").alias("page_id"), F.col("word_count").cast("bigint").alias("told"))
    wrong = types.filter("words is not null").select("page_id", "words").join(told, "page_id").filter(~F.col("words").eqNullSafe(F.col("told")))
    return kinds.unionByName(wrong.select("page_id", F.lit("wrong_count").alias("finding")))
