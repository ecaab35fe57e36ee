"""Text from scanned pages: its noise found line by line, and repaired into paragraphs.

- Misread words. Each word has a glyph key: letters that scans confuse (0 and o,
  1 and l, rn and m, cl and d ...) fold to one, so a misread word and its original
  share a key. A join on that key links rare words to frequent ones. Skip-gram
  vectors with negative sampling, learned from all texts, say how well an original
  goes with the words around the rare word: the sum of the products of its vector with their context vectors,
  less what any context gives, estimates the logarithm of the odds that it stands there. The
  link is taken if the ratio of frequencies times those odds is FAVOUR or more, so that a
  rare word that its context supports as it is stays, and a misreading that is not so rare
  is found where its context asks for the original; of several originals the likeliest
  is taken. Digits or signs among the letters are odds of ODD by themselves.
- Broken words. A line that ends in a hyphen within a word that goes on in the next
  text line: the joined word must be more frequent than the word with the hyphen.
- Page numbers are labels that count up by one from page to page, bare numbers only
  if they stand apart from other numbers. Running headers are lines beside them, at a
  form feed or at the file's ends that recur in the file, or whose form (codes and
  digits masked) recurs in that place in the corpus.

Plan: each file is parsed once (its page borders, line ends and joined words) and
written. Words are counted once in each different text, so that a text under many ids
doesn't make its misread forms frequent. Links are made between different words, not
files. Which words have links travels to the tasks as a bitmap of BITS bits, in which
a chance hit costs a row and changes nothing: a file emits its hits with the sum of the
context vectors around them; these meet the links by a join. What a file needs comes back
in one table, joined once with the files. The vectors are trained in the tasks, each on
its own texts from one start, and averaged; words share BUCKETS vectors by hash, so the
model has a fixed size of 2 * BUCKETS * SIZE floats whatever the vocabulary.

Cases: a null or empty text has no lines; files without any sign of a scan come out
with what the rules find, usually nothing; texts under two ids are judged each; line
numbers count blank lines; null ids come out as null; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, raw, runs, slices, strings, word_hashes

#: An original is at least so many times as frequent as its misread form, if the context is neutral, and so frequent at all.
FAVOUR, FREQUENT = 10, 5
#: An original is always at least so many times as frequent, and the odds that digits or signs among letters are misread.
LEAST_FAVOUR, ODD = 3, 20
#: Weight of the context's odds, and the most that they count to both sides, as a logarithm.
TRUST, MOST_ODDS = 0.5, 4.0
#: Vectors, their size, words on each side, negative samples that a batch of BATCH pairs shares, their weight against one pair, the learning rate, and the share of words above which a word is sampled.
BUCKETS, SIZE, WINDOW, NEGATIVES, WEIGHT, BATCH, RATE, SAMPLED = 1 << 15, 16, 3, 64, 3.0, 4096, 0.1, 3e-4
#: Bits of the bitmap of linked words.
BITS = 1 << 20
#: Lines between two page borders at least, and files in which a form must recur to count as a header's form.
PAGE_LINES, FORM_FILES = 8, 3

HYPHENS = "-‐‑­¬–"
WORD = re.compile(r"[^\W_]+(?:[@|!'’0-9][^\W_]+)*[@|]?|[@|][^\W\d_]+")
COMPOUND = re.compile(r"(?<![^\W\d_])[^\W\d_]++-[^\W\d_]+")
#: Confusable glyphs, each written in the strokes that it is taken for.
_GLYPHS = str.maketrans({"e": "c", "t": "f", "i": "l", "1": "l", "|": "l", "!": "l", "j": "l", "0": "o", "5": "s", "9": "g", "q": "g", "@": "a", "8": "b", "6": "b", "h": "b", "é": "c", "u": "ll", "n": "rl", "m": "rrl", "d": "cl", "w": "vv"})
_NUMBER = r"[0-9lIOo|]{1,5}"
LABEL = re.compile(rf"(?P<open>[-—–\[(]?)\s*(?P<word>(?:page|pg\.?|p\.|p[a@]ge|seite|página|पृष्ठ)?)\s*(?P<n>{_NUMBER})(?:\s*(?:of|/|von|de|sur)\s*{_NUMBER})?\s*(?P<close>[-—–\])]?)(?P<tail>\s*[|·]\s*[^\W\d_]+)?", re.I)
ROMAN = re.compile(r"(?=[ivxlcdm])(m*)(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
_ROMAN = {"m": 1000, "d": 500, "c": 100, "l": 50, "x": 10, "v": 5, "i": 1}
CODE = re.compile(r"[A-Z0-9@|]{2,}(?:-[0-9A-ZlO|]+)+[,:]?")
_ODD = re.compile(r"[^\W\d_][@|!01569]|[@|!]\w|[^\W\d_]\d+[^\W\d_]|^[015689][^\W\d_]{2}")
_LETTERS = re.compile(r"[^\W\d_]{2}")
_NAME = re.compile(r"[A-Z]{1,4}\d+[A-Z]?|[A-Za-z]+\d{1,2}")
_DIGITS = re.compile(r"\d+")
_NUMERAL = re.compile(r"(?=.*\d)(?=.*[lOI])[\dlOI]{2,}")
BLANK = "\x0c \t\r"


def glyph_key(word: str) -> str:
    return word.lower().translate(_GLYPHS)


def odd_shape(word: str) -> bool:
    """Digits or signs among the letters of a word."""
    return not word.isalpha() and bool(_ODD.search(word)) and bool(_LETTERS.search(word)) and not _NAME.fullmatch(word)


def form(line: str) -> str:
    """A line's form: codes and numbers masked, confusable glyphs folded."""
    if line.replace(" ", "").isalpha():
        return " ".join(glyph_key(line).split())
    return " ".join("#" if CODE.fullmatch(x) else glyph_key(x if odd_shape(x) else _DIGITS.sub("#", x)) for x in line.split())


def value(label: str) -> int:
    return int(re.sub(r"[lI|]", "1", re.sub(r"[Oo]", "0", label)))


def roman(text: str) -> int:
    """The value of a roman numeral in small letters, 0 for other texts."""
    if not text or text[0] not in _ROMAN or not ROMAN.fullmatch(text):
        return 0
    v = [_ROMAN[c] for c in text]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def borders(lines: list[str]) -> tuple[set[int], dict[int, str]]:
    """(lines that are page numbers for sure, candidates for running headers with their form), by index."""
    text = [x.strip(BLANK) for x in lines]
    full = [i for i, x in enumerate(text) if x]
    place = {i: k for k, i in enumerate(full)}
    bare, labels, numerals = {}, {}, {}
    for i in full:
        m = LABEL.fullmatch(text[i])
        if m and re.search(r"\d|^[lIO]+$", m["n"]):
            kind = (m["open"], m["word"].lower().replace("@", "a")[:2], m["close"], bool(m["tail"]))
            (bare if kind == ("", "", "", False) else labels)[i] = (kind, value(m["n"]))
        if r := roman(text[i]):
            numerals[i] = r
    numbers: set[int] = set()
    groups: dict[tuple, list[int]] = {}
    for i, (kind, _) in labels.items():
        groups.setdefault(kind, []).append(i)
    for at in groups.values():
        chain = _chain(at, {i: labels[i][1] for i in at}, 2)
        numbers |= set(chain if len(chain) > 1 else at if len(at) == 1 else ())
    chain = _chain(sorted(numerals), numerals)
    numbers |= set(chain if len(chain) > 1 else ())
    ends = {full[0], full[-1]} if full else set()
    chain = _chain(sorted(bare), {i: v for i, (_, v) in bare.items()})
    if len(chain) > 1:
        numbers |= set(chain)
    elif not numbers:
        numbers |= ends & set(numerals)
        for i in ends & set(bare):
            k = place[i]
            if not any(full[j] in bare for j in (k - 1, k + 1) if 0 <= j < len(full)):
                numbers.add(i)
    heads: dict[int, str] = {}
    feeds = {i for i, x in enumerate(lines) if x.startswith("\x0c")}
    by_numbers = {full[j] for i in numbers for j in (place[i] - 1, place[i] + 1) if 0 <= j < len(full)}
    by_feeds = {full[place[i] - 1] for i in feeds if place.get(i, 0) > 0}
    for i in sorted((by_numbers | by_feeds | feeds & set(full) | ends) - numbers - set(bare)):
        if not text[i][0].islower() and _LETTERS.search(text[i]):
            heads[i] = form(text[i])
    # lines of several words that recur at a distance, without any number beside them
    seen: dict[str, list[int]] = {}
    for i in full:
        x = text[i]
        if x[0].isupper() and " " in x and x[-1] not in ".,;:" and i not in numbers and i not in bare and not re.search(r"[|\t]|\s{3}", x):
            seen.setdefault(form(x), []).append(i)
    for f, at in seen.items():
        if len(at) > 2 and sum(b - a >= PAGE_LINES for a, b in zip(at, at[1:])) >= 2:
            heads |= dict.fromkeys(at, f)
    return numbers, heads


def _chain(at: list[int], v: dict[int, int], apart: int = PAGE_LINES) -> list[int]:
    """The longest run of indices whose values count up by one, some lines apart at least (a gap of one page is allowed)."""
    best: dict[int, tuple[int, int | None]] = {}
    # of each value, the best run that ends in it, among the indices that are far enough behind
    ending: dict[int, tuple[int, int]] = {}
    behind = 0
    for i in at:
        while behind < len(at) and i - at[behind] >= apart:
            j = at[behind]
            ending[v[j]] = max(ending.get(v[j], (0, -1)), (best[j][0], j))
            behind += 1
        n, j = max(ending.get(v[i] - 1, (0, -1)), ending.get(v[i] - 2, (0, -1)))
        best[i] = (n + 1, j if n else None)
    if not best:
        return []
    i = max(best, key=lambda x: best[x][0])
    out = []
    while i is not None:
        out.append(i)
        i = best[i][1]
    return out[::-1]


_TAIL = re.compile(r"[\s\x0c]*([^\W_][\w@|]*)")


def _head(line: str) -> str:
    """The head of a word in which a line ends with a hyphen, else ''."""
    cut = line.rstrip()
    if not cut or cut[-1] not in HYPHENS:
        return ""
    k = len(cut) - 1
    while k and (cut[k - 1].isalnum() or cut[k - 1] in "_@|'’"):
        k -= 1
    while k < len(cut) - 1 and not cut[k].isalnum():
        k += 1
    return cut[k:-1]


def broken(lines: list[str], furniture: set[int]) -> dict[int, tuple[int, str, str]]:
    """Of each line that ends in a hyphen within a word: the next text line, the word's head and its tail."""
    out = {}
    for i, line in enumerate(lines):
        head = _head(line) if i not in furniture else ""
        if not head:
            continue
        j = i + 1
        while j < len(lines) and (j in furniture or not lines[j].strip(BLANK)):
            j += 1
        tail = _TAIL.match(lines[j]) if j < len(lines) else None
        if tail:
            out[i] = (j, head, tail[1])
    return out


def joinable(lines: list[str], numbers: set[int], heads: dict[int, str]) -> set[str]:
    """The words, joined and as compounds, that line ends may break, whichever of the candidates turn out to be headers."""
    out = set()
    for i, line in enumerate(lines):
        head = _head(line) if i not in numbers else ""
        j = i + 1
        while head and j < len(lines):
            if j not in numbers and lines[j].strip(BLANK):
                tail = _TAIL.match(lines[j])
                if tail:
                    out |= {(head + tail[1]).lower(), f"{head}-{tail[1]}".lower()}
                if j not in heads:
                    break
            j += 1
    return out


def words_of(line: str) -> list[str]:
    return WORD.findall(line)


# ---- each file once

PARSED = "row long, file_id long, text string, numbers array<int>, heads array<struct<at:int,form:string>>, joined array<string>"
_HEADS = pa.list_(pa.struct([("at", pa.int32()), ("form", pa.string())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Page borders and the words that line ends may break, with a number for each row, as ids may be null or repeated."""
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    for batch in runs(batches):
        numbers, heads, joined = [], [], []
        for text in batch.column("text").to_pylist():
            lines = text.split("\n")
            n, h = borders(lines)
            numbers.append(sorted(n)), heads.append([{"at": i, "form": f} for i, f in h.items()]), joined.append(sorted(joinable(lines, n, h)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(batch.num_rows) + row), batch.column("file_id"), batch.column("text"), pa.array(numbers, pa.list_(pa.int32())), pa.array(heads, _HEADS), pa.array(joined, pa.list_(pa.string()))],
            names=["row", "file_id", "text", "numbers", "heads", "joined"],
        )
        row += batch.num_rows


# ---- words and their links


def bit(word: str) -> int:
    return xxhash.xxh64_intdigest(word) % BITS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            low = text.lower()
            n.update(WORD.findall(low))
            n.update(COMPOUND.findall(low))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])


VOCABULARY = "word string, n long, glyphs string, odd boolean, bit int, bucket int"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), batch.column("n"), pa.array(list(map(glyph_key, words)), pa.string()), pa.array(list(map(odd_shape, words)), pa.bool_()), pa.array(list(map(bit, words)), pa.int32()), pa.array(buckets(words), pa.int32())],
            names=["word", "n", "glyphs", "odd", "bit", "bucket"],
        )


# ---- skip-gram vectors


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and row of each word."""
    data, bounds = raw(pc.utf8_lower(texts))
    h, row = word_hashes(data, bounds)
    return (h % np.uint64(BUCKETS)).astype(np.int64), row


def buckets(words: list[str]) -> np.ndarray:
    """The bucket of each word: that of its first run of letters and digits, as texts are cut for the vectors."""
    out = np.zeros(len(words), np.int32)
    b, row = _hashed(pa.array(words, pa.large_string()))
    out[row[::-1]] = b[::-1]
    return out


class Vectors:
    """Skip-gram vectors with negative sampling, over buckets of words."""

    def __init__(self, frequency: np.ndarray):
        rng = np.random.default_rng(11)
        self.share = frequency / max(1.0, frequency.sum())
        self.own = ((rng.random((BUCKETS, SIZE)) - 0.5) / SIZE).astype(np.float32)
        self.context = np.zeros((BUCKETS, SIZE), np.float32)
        self.pairs = 0

    def learn(self, words: np.ndarray, row: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over the words of some texts."""
        p = self.share[words]
        with np.errstate(divide="ignore"):
            keep = rng.random(len(words)) < np.sqrt(SAMPLED / p) + SAMPLED / p
        words, row = words[keep], row[keep]
        own, near = [], []
        for d in range(1, WINDOW + 1):
            same = row[d:] == row[:-d]
            a, b = words[:-d][same], words[d:][same]
            own += [a, b]
            near += [b, a]
        if not own or not sum(map(len, own)):
            return
        own, near = np.concatenate(own), np.concatenate(near)
        order = rng.permutation(len(own))
        own, near = own[order], near[order]
        for at in range(0, len(own), BATCH):
            self._step(own[at : at + BATCH], near[at : at + BATCH], words[rng.integers(0, len(words), NEGATIVES)])
        self.pairs += len(own)

    def _step(self, own: np.ndarray, near: np.ndarray, noise: np.ndarray) -> None:
        v, u, un = self.own[own], self.context[near], self.context[noise]
        g = RATE * (1 - _sigmoid((v * u).sum(1, keepdims=True)))
        gn = -RATE * WEIGHT / NEGATIVES * _sigmoid(v @ un.T)
        _add(self.own, own, g * u + gn @ un)
        _add(self.context, near, g * v)
        np.add.at(self.context, noise, gn.T @ v)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def _add(table: np.ndarray, at: np.ndarray, change: np.ndarray) -> None:
    """table[at] += change, summed over equal places and bounded where many of a batch fall on one."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    table[ordered[first]] += np.clip(np.add.reduceat(change[order], first), -0.5, 0.5)


def _train(frequency: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rng = Vectors(frequency), np.random.default_rng(TaskContext.get().partitionId() if TaskContext.get() else 0)
        for batch in batches:
            for part in slices(batch, "text"):
                model.learn(*_hashed(strings(part.column("text"))), rng)
        if model.pairs:
            blob = np.concatenate((model.own, model.context)).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([float(model.pairs)]), pa.array([blob], pa.binary())], names=["pairs", "model"])

    return task


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, pairs = np.zeros(2 * BUCKETS * SIZE), 0.0
    for batch in batches:
        for n, blob in zip(batch.column("pairs").to_pylist(), batch.column("model")):
            total += n * np.frombuffer(blob.as_buffer(), np.float32)
            pairs += n
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([(total / pairs).astype(np.float32).tobytes()], pa.binary())], names=["pairs", "model"])


def vectors(texts: DataFrame, frequency: np.ndarray) -> Vectors:
    """Vectors learned from all texts: in each task from one start, then averaged by the pairs seen (in 8 tasks, then here)."""
    schema = "pairs double, model binary"
    learned = texts.select("text").mapInArrow(_train(frequency), schema).repartition(8).mapInArrow(_average, schema)
    out, rows = Vectors(frequency), learned.collect()
    pairs = sum(r["pairs"] for r in rows)
    if pairs:
        m = sum(r["pairs"] / pairs * np.frombuffer(r["model"], np.float32) for r in rows).reshape(2 * BUCKETS, SIZE)
        out.own, out.context = m[:BUCKETS].astype(np.float32), m[BUCKETS:].astype(np.float32)
    return out


# ---- links in context

_SUMS = [f"c{k}" for k in range(SIZE)]
HITS = "row long, term string, times long, " + ", ".join(f"{c} double" for c in _SUMS)


def _hits(bits: np.ndarray, context: np.ndarray, mean: np.ndarray):
    """(row, term, times, sums): each file's words in the bitmap, with the sum of what its contexts say beyond the mean."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in runs(batches):
            rows, terms, times, sums = [], [], [], []
            for row, text, joined in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "joined"))):
                words = WORD.findall(text.lower())
                found: dict[str, list[int]] = {w: [] for w in joined if bits[bit(w)]}
                for k, w in enumerate(words):
                    hit = known.get(w)
                    if hit is None:
                        hit = bool(bits[bit(w)])
                        if len(known) < 200_000:
                            known[w] = hit
                    if hit:
                        found.setdefault(w, []).append(k)
                if not found:
                    continue
                near = {j for at in found.values() for k in at for j in range(max(0, k - WINDOW), min(len(words), k + 1 + WINDOW))}
                order = sorted(near)
                vector = dict(zip(order, context[buckets([words[j] for j in order])] - mean)) if order else {}
                for w, at in found.items():
                    rows.append(row), terms.append(w), times.append(len(at))
                    sums.append(sum((vector[j] for k in at for j in range(max(0, k - WINDOW), min(len(words), k + 1 + WINDOW)) if j != k), np.zeros(SIZE)))
            sums = np.array(sums, float).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(terms, pa.string()), pa.array(times, pa.int64()), *(pa.array(sums[:, k]) for k in range(SIZE))], names=["row", "term", "times", *_SUMS])

    return task


def _scored(own: np.ndarray):
    """(term, original, score): the logarithm of the odds that the term is a misread original."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, often, times = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "often", "times"))
            sums = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _SUMS], axis=1)
            odds = (own[batch.column("bucket").to_numpy()] * sums).sum(1) / np.maximum(times, 1)
            odd = batch.column("odd").to_numpy(zero_copy_only=False)
            score = np.log(often / np.maximum(n, 1)) + np.clip(TRUST * odds, -MOST_ODDS, MOST_ODDS) + np.log(ODD) * odd
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("original"), pa.array(score)], names=["term", "original", "score"])

    return task


def knowledge(rows: DataFrame) -> DataFrame:
    """Each file as parsed, with fixes (misread word to original), joins (joined words to count) and forms (of headers); rows: file_id, text."""
    parsed = materialize(rows.mapInArrow(_parse, PARSED))
    counts = parsed.select("text").distinct().mapInArrow(_count, "word string, n long")
    joined = parsed.select(F.explode("joined").alias("word"), F.lit(0).cast("bigint").alias("n"))
    words = materialize(counts.unionByName(joined).groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(_described, VOCABULARY))
    frequency = np.zeros(BUCKETS)
    # one row a bucket
    for r in words.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        frequency[r["bucket"]] = r["n"]
    frequent = words.filter((F.col("n") >= FREQUENT) & F.col("word").rlike(r"^[\p{L}\p{M}'’-]+$")).select("glyphs", F.col("word").alias("original"), F.col("n").alias("often"), "bucket")
    # words of one or two letters are too short to tell apart by their glyphs, unless a digit or sign stands in them
    rare = words.filter(F.col("word").rlike(r"\p{L}.*\p{L}.*\p{L}|\p{L}.*[0-9@|!]|[0-9@|!].*\p{L}")).select("glyphs", F.col("word").alias("term"), "n", "odd", "bit")
    links = materialize(rare.join(frequent, "glyphs").filter((F.col("original") != F.col("term")) & (F.col("often") >= LEAST_FAVOUR * F.greatest("n", F.lit(1)))).drop("glyphs"))
    bits = np.zeros(BITS, bool)
    # at most one row a bit
    bits[[r["bit"] for r in links.select("bit").distinct().collect()]] = True
    model = vectors(parsed, frequency)
    mean = (model.share[:, None] * model.context).sum(0)
    hits = materialize(parsed.select("row", "text", "joined").mapInArrow(_hits(bits, model.context, mean), HITS))
    told = hits.groupBy("term").agg(F.sum("times").alias("times"), *(F.sum(c).alias(c) for c in _SUMS))
    scored = links.join(told, "term").mapInArrow(_scored(model.own), "term string, original string, score double")
    best = scored.groupBy("term").agg(F.max(F.struct("score", "original")).alias("b")).filter(F.col("b.score") >= float(np.log(FAVOUR))).select("term", F.col("b.original").alias("original"))
    null = {"fix": "struct<term:string,original:string>", "join": "struct<term:string,n:bigint>", "head": "string"}

    def fact(df: DataFrame, name: str, value) -> DataFrame:
        return df.select("row", *(value.alias(c) if c == name else F.lit(None).cast(t).alias(c) for c, t in null.items()))

    fixes = fact(hits.select("row", "term").join(best, "term"), "fix", F.struct("term", "original"))
    said = parsed.select("row", F.explode("joined").alias("word")).join(words.filter("n > 1").select("word", "n"), "word")
    forms = parsed.select("row", F.explode("heads.form").alias("form")).groupBy("row", "form").agg(F.count("*").alias("n"))
    common = forms.filter("n >= 2").groupBy("form").count().filter(F.col("count") >= FORM_FILES).select("form", F.lit(True).alias("common"))
    heads = forms.join(common, "form", "left").filter(F.col("common") | (F.col("n") >= 2))
    facts = fixes.unionByName(fact(said, "join", F.struct(F.col("word").alias("term"), "n"))).unionByName(fact(heads, "head", F.col("form")))
    facts = facts.groupBy("row").agg(F.collect_list("fix").alias("fixes"), F.collect_list("join").alias("joins"), F.collect_set("head").alias("forms"))
    return parsed.drop("joined").join(facts, "row", "left")


# ---- files


class File:
    """One file's lines with their noise, given what the corpus says about its terms."""

    def __init__(self, text: str, numbers: set[int], heads: set[int], fixes: dict[str, str], joins: dict[str, int]):
        self.lines = text.split("\n")
        self.fixes, self.joins = fixes, joins
        self.numbers, self.heads = numbers, heads
        furniture = self.numbers | self.heads
        self.breaks = {}
        for i, (j, a, b) in broken(self.lines, furniture).items():
            whole, compound = (a + b).lower(), f"{a}-{b}".lower()
            hyphen = self.lines[i].rstrip()[-1]
            known = max(joins.get(whole, 0), joins.get(fixes.get(whole, ""), 0), FREQUENT if whole in fixes else 0)
            if known > joins.get(compound, 0) and (b[0].islower() or hyphen != "-") or hyphen in "‐­¬" and b[0].islower() and known >= joins.get(compound, 0):
                self.breaks[i] = (j, a, b)
        halves = {(i, "a") for i in self.breaks} | {(j, "b") for j, _, _ in self.breaks.values()}
        self.misread = set()
        for i, line in enumerate(self.lines):
            if i in furniture:
                continue
            words = words_of(line)
            for k, w in enumerate(words):
                if k == len(words) - 1 and (i, "a") in halves or k == 0 and (i, "b") in halves:
                    continue
                if w.lower() in fixes or _NUMERAL.fullmatch(w):
                    self.misread.add(i)
        for i, (j, a, b) in self.breaks.items():
            whole = (a + b).lower()
            if whole in fixes and joins.get(whole, 0) < FREQUENT:
                good = fixes[whole]
                (self.misread.add(i) if not good.startswith(a.lower()) else None), (self.misread.add(j) if not good.endswith(b.lower()) else None)

    def noise(self) -> list[tuple[int, str]]:
        out = [(i + 1, "page_number") for i in self.numbers] + [(i + 1, "running_header") for i in self.heads]
        return sorted(out + [(i + 1, "broken_word") for i in self.breaks] + [(i + 1, "misread") for i in self.misread])

    def _fixed(self, word: str) -> str:
        good = self.fixes.get(word.lower())
        if good is None:
            return word
        return good.upper() if word.isupper() else good[:1].upper() + good[1:] if word[:1].isupper() else good

    def paragraphs(self) -> str:
        """The text in continuous paragraphs, without furniture, with words joined and corrected."""
        furniture, out, open_ = self.numbers | self.heads, [], ""
        width = max((len(x) for i, x in enumerate(self.lines) if i not in furniture), default=0)
        skip: dict[int, int] = {}
        for i, line in enumerate(self.lines):
            if i in furniture:
                continue
            line = line.strip(BLANK)
            if not line:
                if open_ and open_[-1] in ".!?।:”\"":
                    out.append(open_)
                    open_ = ""
                continue
            line = line[skip.get(i, 0) :].lstrip()
            if i in self.breaks:
                j, a, b = self.breaks[i]
                line = line.rstrip(HYPHENS + " ")[: -len(a) or None] + a + b
                skip[j] = self.lines[j].strip(BLANK).find(b) + len(b)
            line = WORD.sub(lambda m: self._fixed(m[0]), line)
            short = len(self.lines[i]) < 0.6 * width
            joiner = "" if line[:1] in ".,;:!?)" else " "
            open_ = f"{open_}{joiner}{line}".strip()
            if short and line[-1:] in ".!?।:":
                out.append(open_)
                open_ = ""
        return "\n\n".join(x for x in [*out, open_] if x)


def _files(batch: pa.RecordBatch) -> Iterator[tuple[int, File]]:
    for i, text, numbers, heads, fixes, joins, forms in zip(*(batch.column(c).to_pylist() for c in ("file_id", "text", "numbers", "heads", "fixes", "joins", "forms"))):
        known = set(forms or ())
        yield i, File(text, set(numbers), {h["at"] for h in heads if h["form"] in known}, {r["term"]: r["original"] for r in fixes or ()}, {r["term"]: r["n"] for r in joins or ()})


def _noise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches):
        rows = [(i, n, kind) for i, f in _files(batch) for n, kind in f.noise()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["file_id", "line_no", "noise"])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches):
        rows = [(i, f.paragraphs()) for i, f in _files(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["file_id", "paragraphs"])


def _rows(files: DataFrame) -> DataFrame:
    return files.select(F.col("id").cast("bigint").alias("file_id"), F.col("extracted_text").alias("text")).filter("text is not null")


def scan_noise(files: DataFrame) -> DataFrame:
    """(file_id, line_no, noise) of each noisy line."""
    return knowledge(_rows(files)).mapInArrow(_noise, "file_id long, line_no int, noise string")


def repaired(files: DataFrame) -> DataFrame:
    """(file_id, paragraphs): each text repaired into continuous paragraphs."""
    return knowledge(_rows(files)).mapInArrow(_repair, "file_id long, paragraphs string")
