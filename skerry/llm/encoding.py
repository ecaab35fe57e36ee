"""Texts decoded with a wrong character encoding: found, and restored where possible.

A noisy channel: someone wrote a word, it was encoded to bytes, the bytes were
decoded with the wrong encoding, and some bytes were lost on the way (controls
dropped, or undecodable bytes replaced by U+FFFD). For each channel a token becomes
a lattice of bytes, exact where a character stands for one byte and a wildcard
where bytes were lost, and a Viterbi search finds the cheapest original. A token is
damage if its best path is cheaper than the token as it stands, and a document is
garbled if it holds such a token.

- Words. A path may spell a word of the corpus. Such paths run through a trie of
  the corpus' words that the channels can make into the token; the cost of a word
  falls with the logarithm of its frequency. It beats the token if it is FAVOUR times
  as frequent, by different texts or by rows (damage that is copied into many rows
  stands in few texts). Single-byte channels have these paths only.
- Free paths. A path may leave each character as it is, or read a well-formed UTF-8
  sequence through the channel, at the cost of the characters' frequencies in the
  corpus. That legitimate characters happen to form a sequence for a usual character
  is nearly impossible (COINCIDENCE); so unknown words are decoded too. Readings that
  were wrong more than once are undone by searching again until nothing is cheaper.
- U+FFFD and C1 controls are written by nobody: a token with one is damage even if
  no path restores it. A token that is nothing but the garbled form of one letter or
  quote is left alone: texts quote such signs to discuss them.

Plan: a first scan groups the rows by text and counts the tokens with non-ASCII
characters in different texts and in rows (summed in each batch); from here on the
work is on different tokens, not on texts. Words meet tokens by a shuffle join of
the words' channel images, losses removed, with the tokens' forms, losses removed; a
form has as many words as differ in lost bytes alone. Each token is solved once. A second scan emits the
tokens of each document that a channel can have made, which meet the damaged ones
by a semi-join. No vocabulary is collected or broadcast by hand; counts of
characters are collected, at most the 150,000 or so of Unicode.

Cases: null, empty and ASCII texts are not damaged; foreign letters in proper use
are not damage whatever their script; copies are judged each; null ids come out as
null; what no channel explains stays as it is; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, runs

#: Encodings as which UTF-8 may have been read.
READ_AS = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_2", "koi8_r", "cp1254", "iso8859_15")
#: (written in, read as) pairs of single-byte encodings.
LEGACY = (("cp1252", "cp1251"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1250"), ("cp1252", "koi8_r"), ("cp1252", "cp1253"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"))
#: How many times more often than the damaged form the original must occur, and least often, in different texts or in rows.
FAVOUR, LEAST = 4, 3
#: A character is usual if it stands in at least this share of the non-ASCII words' occurrences in different texts, or in this many.
USUAL_SHARE, USUAL = 2e-5, 5
#: Costs (negative log probabilities): of a channel, of a byte lost, of a character that nobody writes, and that characters form the sequence of a usual one by chance.
CHANNEL, LOSS, NEVER, COINCIDENCE = 3.0, 1.0, 40.0, 8.0

RUN = re.compile(r"[^\x00-\x7fऀ-ॿ]+")
PAIR = re.compile(r"[^\x00-\x7fऀ-ॿ]{2}")
TOKEN = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
ASCII_EDGE = ".,;:!?\"'()[]{}<>/|*#=+-_"
EDGE = " \t\r\n" + ASCII_EDGE + "“”„«»।"
QUOTES = "’‘“”'\""
LOST = "�"
CONTROL = re.compile(r"[\x80-\x9f]")
#: What may get lost: controls, no-break spaces, soft hyphens and what was replaced.
LOSABLE = re.compile(rf"[\x80-\x9f\xa0\xad{LOST}]")


def _table(codec: str) -> dict[str, int]:
    """The byte of each non-ASCII character of an encoding; bytes it leaves undefined stand for the C1 control."""
    return {bytes([b]).decode(codec) if _has(codec, b) else chr(b): b for b in range(128, 256)}


def _has(codec: str, b: int) -> bool:
    try:
        bytes([b]).decode(codec)
        return True
    except UnicodeDecodeError:
        return False


TABLES = {c: _table(c) for c in dict.fromkeys((*READ_AS, *(r for _, r in LEGACY)))}
BACK = {c: {b: ch for ch, b in t.items()} for c, t in TABLES.items()}
#: All non-ASCII characters that a channel can make; a token with any other is no channel's image.
MADE = frozenset(ch for t in TABLES.values() for ch in t) | {LOST}
#: Channels: (written in, read as); None for a character that became one U+FFFD or several.
CHANNELS: tuple[tuple[str, str | None], ...] = (*(("utf-8", c) for c in READ_AS), *LEGACY, ("utf-8", None))
WILD, FOREIGN = -1, -2


def lattice(span: str, codec: str | None) -> list[int]:
    """The byte of each character of span, WILD for a lost one, FOREIGN for one that the encoding doesn't have."""
    table = TABLES.get(codec or "", {})
    return [ord(ch) if ch < "\x80" else WILD if ch == LOST else table.get(ch, FOREIGN) for ch in span]


def _sequence(lead: int) -> int:
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0


def image(word: str, wrote: str, read: str | None) -> str | None:
    """What a channel makes of a word, without what may get lost; None if it can't be written so."""
    try:
        data = word.encode(wrote)
    except UnicodeEncodeError:
        return None
    return LOSABLE.sub("", "".join(chr(b) if b < 128 else BACK[read][b] for b in data)) if read else LOSABLE.sub("", re.sub(r"[^\x00-\x7f]", "", word))


def images(word: str) -> set[str]:
    """The forms under which tokens that are garbled forms of word are looked up."""
    out = {image(word, wrote, read) for wrote, read in CHANNELS if read}
    if len(word) == 1 or re.search("[A-Za-z0-9]", word):
        # without any letter left, a longer word can't be told from all others of its length
        out |= {re.sub(r"[^\x00-\x7f]", LOST, word), re.sub(r"[^\x00-\x7f]", lambda m: LOST * len(m[0].encode("utf-8", "replace")), word)}
    return {x for x in out if x and x != word}


def forms(token: str) -> set[str]:
    """The forms that a token is looked up by."""
    return {x for x in (LOSABLE.sub("", token), token if LOST in token else "") if x}


class Characters:
    """Costs of characters by their counts in a corpus, and the cheapest character of each pattern of bytes."""

    def __init__(self, counts: dict[str, int]):
        self.total = sum(counts.values())
        self.costs = {c: math.log((self.total + 1) / n) for c, n in counts.items() if n > 0}
        self.unseen = math.log(self.total + 1) + 1
        self.costs |= {chr(c): NEVER for c in range(128, 160)} | {LOST: NEVER}
        least = max(USUAL, USUAL_SHARE * self.total)
        self.usual = {c for c, n in counts.items() if n >= least and self.costs[c] < NEVER}
        self._patterns: dict[tuple[int, ...], str | None] = {}

    def cost(self, c: str) -> float:
        return 0.0 if c < "\x80" else self.costs.get(c, self.unseen)

    def of(self, text: str) -> float:
        return sum(map(self.cost, text))

    def named(self, pattern: tuple[int, ...]) -> str | None:
        """The character with these bytes, the cheapest usual one where some are lost; None if there is none."""
        if pattern not in self._patterns:
            if WILD in pattern:
                fit = [c for c in self.usual if len(b := c.encode("utf-8", "replace")) == len(pattern) and all(p in (WILD, x) for p, x in zip(pattern, b))]
                self._patterns[pattern] = min(fit, key=lambda c: (self.costs[c], c), default=None)
            else:
                try:
                    self._patterns[pattern] = bytes(pattern).decode("utf-8")
                except UnicodeDecodeError:
                    self._patterns[pattern] = None
        return self._patterns[pattern]


def free_path(span: str, codec: str, chars: Characters) -> tuple[float, str]:
    """The cheapest reading of span through UTF-8 read as codec, where each character may also stand for itself."""
    data, n = lattice(span, codec), len(span)
    best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(math.inf, 0, "")] * n
    for i in range(n):
        so_far = best[i][0]
        if (c := so_far + chars.cost(span[i])) < best[i + 1][0]:
            best[i + 1] = (c, i, span[i])
        k = _sequence(data[i])
        if k and i + k <= n and all(x == WILD or 0x80 <= x < 0xC0 for x in data[i + 1 : i + k]):
            ch = chars.named(tuple(data[i : i + k]))
            if ch is not None:
                c = so_far + chars.cost(ch) + LOSS * data[i : i + k].count(WILD) - COINCIDENCE * (ch in chars.usual)
                if c < best[i + k][0]:
                    best[i + k] = (c, i, ch)
    out, i = [], n
    while i:
        out.append(best[i][2])
        i = best[i][1]
    return best[n][0], "".join(reversed(out))


def decoded(span: str, chars: Characters) -> tuple[float, str]:
    """(gain, original) of the cheapest free path over all channels, searched again as long as it gains."""
    gain, text = 0.0, span
    while PAIR.search(text):
        c, out = min((free_path(text, codec, chars) for codec in READ_AS), default=(math.inf, text))
        more = chars.of(text) - c - CHANNEL
        if more <= 0 or len(out) >= len(text):
            break
        gain, text = gain + more, out
    return gain, text


def trie_of(words: dict[str, float]) -> list[tuple[dict[str, int], str | None]]:
    """A trie of words: (children, the word that ends there) of each node."""
    nodes: list[tuple[dict[str, int], str | None]] = [({}, None)]
    for w in words:
        at = 0
        for ch in w:
            step = nodes[at][0]
            if ch not in step:
                step[ch] = len(nodes)
                nodes.append(({}, None))
            at = step[ch]
        nodes[at] = (nodes[at][0], w)
    return nodes


def _steps(data: list[int], i: int, want: bytes, read: str | None) -> dict[int, float]:
    """Where the bytes of one character, exact or lost, may end that begin at i, with the cost of what was lost."""
    if read is None:
        # a character became one replacement, or one for each byte
        ends = {i + k: LOSS for k in (1, len(want)) if i + k <= len(data) and all(x == WILD for x in data[i : i + k])}
        return ends
    at = {i: 0.0}
    for b in want:
        nxt: dict[int, float] = {}
        ch = BACK[read][b] if b >= 128 else chr(b)
        for j, c in at.items():
            if j < len(data) and (data[j] == b or data[j] == WILD):
                cost = c + (LOSS if data[j] == WILD else 0.0)
                nxt[j + 1] = min(cost, nxt.get(j + 1, math.inf))
            if LOSABLE.match(ch):
                nxt[j] = min(c + LOSS, nxt.get(j, math.inf))
        at = nxt
    return at


def viterbi(span: str, words: dict[str, float]) -> tuple[float, str] | None:
    """(cost, word): the cheapest path over all channels that spells one of the words; words: each with its log frequency.

    States are (characters read, node of the trie of the words), searched from left to right.
    """
    trie, best = trie_of(words), None
    for wrote, read in CHANNELS:
        data = lattice(span, read)
        layers: list[dict[int, float]] = [{} for _ in range(len(span) + 1)]
        layers[0][0] = 0.0
        for i in range(len(span) + 1):
            open_ = list(layers[i].items())
            while open_:
                node, cost = open_.pop()
                if cost > layers[i][node]:
                    continue
                for ch, child in trie[node][0].items():
                    if ch < "\x80":
                        ends = {i + 1: 0.0} if i < len(span) and span[i] == ch else {}
                    else:
                        try:
                            ends = _steps(data, i, ch.encode(wrote), read)
                        except UnicodeEncodeError:
                            ends = {}
                    for j, more in ends.items():
                        if cost + more < layers[j].get(child, math.inf):
                            layers[j][child] = cost + more
                            if j == i:
                                open_.append((child, cost + more))
        for node, cost in layers[-1].items():
            w = trie[node][1]
            if w is not None and w != span:
                found = (cost + CHANNEL - words[w], w)
                best = found if best is None or found < best else best
    return best


def solve(token: str, own: int, own_rows: int, words: list[tuple[str, int, int]], chars: Characters) -> tuple[str, bool] | None:
    """(original, evidence) of a token whose best path beats the token itself, the token itself for damage that no path undoes, None for no damage.

    Without evidence, the token counts in documents that hold others with evidence.
    own, own_rows: different texts and rows that hold the token's word; words: (word, texts, rows) of the corpus' words with a form of the token.
    """
    word = token.strip(EDGE)
    never = bool(CONTROL.search(token)) or LOST in token and word != LOST
    counts = {w: n for w, n, _ in words}
    options: list[tuple[float, str]] = []
    gain, out = decoded(token, chars)
    if gain > 0:
        gain -= max(0.0, math.log((1 + own) / (1 + counts.get(out.strip(EDGE), 0))))
        if gain > 0:
            options.append((CHANNEL + LOSS * token.count(LOST) + chars.of(out) - math.log1p(counts.get(out.strip(EDGE), 0)), out))
    favoured = {w: math.log(max(n, 1)) for w, n, rows in words if n >= max(LEAST, FAVOUR * own) or rows >= max(LEAST, FAVOUR * own_rows)}
    found = viterbi(word, favoured) if favoured else None
    if found is not None:
        options.append((found[0] + chars.of(found[1]), token.replace(word, found[1])))
    if not options:
        return (token, True) if never else None
    best = min(options)[1]
    rest = best.strip(EDGE)
    quoted = RUN.fullmatch(word) and (len(rest) == 1 and (rest.isalpha() or rest in QUOTES) or not rest and best.strip(ASCII_EDGE) in QUOTES)
    return best, never or not (len(word) < 2 or quoted)


# ---- over the corpus


def core(token: str) -> str:
    return token.strip(ASCII_EDGE)


def _asked(token: str) -> bool:
    """Some channel can have made the token."""
    return all(c < "\x80" or c in MADE for c in token) or LOST in token or bool(CONTROL.search(token))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: Counter[str] = Counter()
        all_rows: Counter[str] = Counter()
        for text, copies in zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist()):
            found = set(map(core, TOKEN.findall(text)))
            n.update(found)
            all_rows.update(found if copies == 1 else dict.fromkeys(found, copies))
        names = ["token", "word", "asked", "n", "in_rows"]
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([t.strip(EDGE) for t in n], pa.string()), pa.array(list(map(_asked, n)), pa.bool_()), pa.array(list(n.values()), pa.int64()), pa.array([all_rows[t] for t in n], pa.int64())], names=names)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches, 5_000):
        rows = [(f, t) for t, w in zip(batch.column("token").to_pylist(), batch.column("word").to_pylist()) for f in forms(w)]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], names=["form", "token"])


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches, 5_000):
        words = [x for x in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "in_rows"))) if not x[0].isascii() and LOST not in x[0] and not CONTROL.search(x[0])]
        rows = [(i, *x) for x in words for i in images(x[0])]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["form", "word", "n", "in_rows"])


def _solve(counts: dict[str, int]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars = Characters(counts)
        for batch in runs(batches, 5_000):
            columns = (batch.column(c).to_pylist() for c in ("token", "own", "own_rows", "options"))
            got = [(t, solve(t, own, own_rows, [(o["word"], o["n"], o["in_rows"]) for o in options or ()], chars)) for t, own, own_rows, options in zip(*columns)]
            got = [(t, *r) for t, r in got if r is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["token", "original", "evidence"])

    return task


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches):
        at, tokens = [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            own = {t for t in map(core, TOKEN.findall(text)) if _asked(t)}
            at += [k] * len(own)
            tokens += own
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(tokens, pa.string())], names=["id", "token"])


def _rows(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("text").rlike(r"[^\x00-\x7F]"))


def damaged_tokens(rows: DataFrame) -> DataFrame:
    """(token, original, evidence) of each different token of the texts whose best path beats the token itself, written once."""
    counted = rows.groupBy("text").agg(F.count("*").alias("copies")).mapInArrow(_count, "token string, word string, asked boolean, n long, in_rows long")
    tokens = materialize(counted.groupBy("token", "word", "asked").agg(F.sum("n").alias("n"), F.sum("in_rows").alias("in_rows")))
    vocabulary = tokens.groupBy("word").agg(F.sum("n").alias("n"), F.sum("in_rows").alias("in_rows"))
    chars = tokens.select("n", F.explode(F.array_distinct(F.regexp_extract_all("token", F.lit(r"[^\x00-\x7F]"), F.lit(0)))).alias("c")).groupBy("c").agg(F.sum("n").alias("n"))
    counts = {r["c"]: r["n"] for r in chars.collect()}
    asked = tokens.filter("asked").select("token", "word")
    made = vocabulary.filter((F.col("n") >= LEAST) | (F.col("in_rows") >= LEAST)).mapInArrow(_images, "form string, word string, n long, in_rows long")
    options = asked.mapInArrow(_forms, "form string, token string").join(made, "form").groupBy("token").agg(F.collect_set(F.struct("word", "n", "in_rows")).alias("options"))
    own = vocabulary.select("word", F.col("n").alias("own"), F.col("in_rows").alias("own_rows"))
    return materialize(asked.join(own, "word").join(options, "token", "left").mapInArrow(_solve(counts), "token string, original string, evidence boolean"))


def garbled(corpus: DataFrame) -> DataFrame:
    """(doc_id) of the documents of which at least a part was decoded with a wrong encoding."""
    rows = _rows(corpus)
    held = rows.select(F.col("doc_id").alias("id"), "text").mapInArrow(_tokens, "id long, token string")
    return held.join(damaged_tokens(rows).filter("evidence"), "token", "left_semi").select(F.col("id").alias("doc_id")).distinct()


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches):
        out = []
        for text, fixes in zip(batch.column("text").to_pylist(), batch.column("fixes").to_pylist()):
            known = {r["token"]: r["original"] for r in fixes}

            def mend(m: re.Match, known=known) -> str:
                t = core(m[0])
                return m[0].replace(t, known[t]) if t in known else m[0]

            out.append(TOKEN.sub(mend, text))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "restored_text"])


def restore(corpus: DataFrame) -> DataFrame:
    """(doc_id, restored_text) of each garbled document."""
    rows = _rows(corpus)
    # the same text has the same tokens, whatever its ids
    keyed = rows.withColumn("id", F.md5("text"))
    held = keyed.select("id", "text").mapInArrow(_tokens, "id string, token string").distinct()
    fixes = held.join(damaged_tokens(rows), "token").groupBy("id").agg(F.collect_list(F.struct("token", "original")).alias("fixes"), F.max("evidence").alias("evidence")).filter("evidence")
    return keyed.join(fixes, "id").select("doc_id", "text", "fixes").mapInArrow(_mend, "doc_id long, restored_text string")
