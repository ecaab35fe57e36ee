"""Broken question and answer pairs, flagged by ordered rules.

Each rule looks for one defect and every rule that triggers is emitted, in the
order of DEFECTS; the first is the pair's main defect. Emptiness, refusals,
copies and languages are judged from the pair alone. An abrupt end is judged
against the whole corpus of answers: counts of how often each word, and each
pair of words, ends a sentence and how often it goes on; an unpunctuated answer
that ends in a word that hardly ever ends a sentence, or in the torn head of a
longer word, was cut.

Plan: one Arrow pass judges each pair and is written once, with hashes of the last
word and pair of words where the corpus must decide. A second pass, over different
answers, finds words, sentence ends and heads of words in numpy over the batch's
bytes and emits counts by hash, summed in the batch; a shuffle sums them. The asked
hashes alone are joined with the counts; no vocabulary is sent to the driver or to
the tasks. A last word that many answers share is one row on the counts' side.

Short answers are no cases when they lack a full stop (a definition of the
problem): by the corpus' counts only answers of LONG words or more are cut, and
torn heads are looked for from SENTENCE words on; marks of a cut and open brackets
count at any length. All words and phrases by language are one parameter (Words), so that a
language is added by a caller.

Cases: a null, blank or filler answer is empty whatever the question; with a
null or blank question only the rules on the answer apply; copies of a pair are
flagged each by itself; a null id comes out as null; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, WORD_BYTES, Rolling, materialize, mixed, raw, runs, slices, strings

DEFECTS = ("empty_answer", "copied_question", "refusal", "wrong_language", "truncated_answer")

#: Answers that say nothing, without punctuation.
FILLERS = {"na", "n a", "none", "null", "nil", "nan", "undefined", "tbd", "tba", "tbc", "todo", "blank", "empty", "pending", "placeholder", "not available", "no answer", "coming soon", "to be added", "to be done", "a", "answer", "antwort", "réponse", "respuesta", "उत्तर"}
LABEL = re.compile(r"^\W*(?:(?:a|q|re|aw|ans|answer|question|frage|antwort|réponse|pregunta|respuesta|प्रश्न|उत्तर|you asked?|your question|about your question|the question|vous demandez|votre question|su pregunta|ihre frage)\s*(?:[:.)\]]|\s[–—-]|(?=[\"“«„]))\s*)+", re.I)
#: What may stand around a question that an answer only repeats.
LABEL_WORDS = set("a q re ans answer question frage antwort réponse pregunta respuesta प्रश्न उत्तर you ask asked your about the is was".split())

STOPWORDS = {
    "en": "the of and to in is are was were with for on at by from this that which it its be been has have had not what how why when where who does do did can may will any an or as if there their your you we they than more most near then out one two all each only first into over under after before so but".split(),
    "fr": "le la les des du de une un et est sont à au aux en dans pour par sur avec ne pas que qui quelle quel comment pourquoi où il elle nous vous je ce cette ces son sa ses été après près peu plus données fichiers sans ou".split(),
    "es": "el la los las de del una un y es son en para por con no que qué cuál cómo por qué cuándo dónde se su sus este esta fue más datos al lo cada está tiene según sobre después cerca o".split(),
    "de": "der die das den dem des ein eine einen und ist sind in im zu zur für von mit auf bei nicht wie was warum wann wo wer welche welcher es sie ihr ich wir dieser diese wurde wurden werden daten dateien daher oder aus nach über kann beträgt".split(),
}
_VERB = r"(?:answer|respond|reply|help|assist|comment|share|discuss|provide|disclose|say|tell|offer|give|support|process|fulfil|complete|handle)"
REFUSALS = [
    re.compile(x, re.I)
    for x in (
        rf"\b(?:cannot|can[’']?t|can not|could not|couldn[’']?t|won[’']?t|will not|unable to|not able to|not allowed to|not permitted to|not in a position to|not going to|refuse to|decline to|must decline|have to decline|prefer not to)\b[^.!?]{{0,25}}\b{_VERB}\b",
        rf"\bnot possible for (?:me|us)\b[^.!?]{{0,25}}\b{_VERB}\b",
        r"\b(?:no|not an?|any) (?:answer|reply|response|comment|information)\b[^.!?]{0,30}\b(?:can be given|is possible|to give|to share|available for this)",
        r"\bdo(?:es)? not have an? (?:answer|reply|response)\b",
        r"\b(?:i|we) (?:must |have to |respectfully )?decline\b",
        r"\bje ne (?:peux|puis|suis)[^.!?]{0,40}(?:répondre|aider|réponse|fournir|partager|mesure|autoris)|\bnous ne pouvons[^.!?]{0,30}(?:répondre|aider|fournir|donner)|\b(?:impossible|refus\w+) de (?:vous )?(?:répondre|aider|donner)|aucune réponse ne peut",
        r"\bno (?:puedo|podemos|es posible|me es posible|estoy|estamos)[^.!?]{0,40}(?:responder|contestar|ayudar|respuesta|autorizad|condiciones|compartir)|\bno se puede dar (?:una )?respuesta",
        r"\b(?:kann|können|darf|dürfen|möchte) (?:ich|wir|dazu|hierzu|leider|diese|ihnen|die)?[^.!?]{0,50}(?:nicht|keine)[^.!?]{0,30}(?:beantworten|antworten|helfen|geben|auskunft|antwort|äußern|sagen)|\b(?:ich|wir) (?:kann|können|darf|dürfen)[^.!?]{0,50}(?:nicht|keine)[^.!?]{0,30}(?:beantworten|antworten|helfen|geben|äußern|sagen)|nicht möglich[^.!?]{0,40}(?:beantworten|antworten)",
        r"(?:उत्तर|जवाब|जानकारी|सहायता|मदद|टिप्पणी)[^।.!?]{0,25}(?:नहीं|असमर्थ)[^।.!?]{0,12}(?:दे|कर|सक|हूँ|हैं|है)|(?:देने|बताने|करने) में असमर्थ",
    )
]
#: Sentences that may go with a refusal without being an answer, by words that occur in them.
COURTESY = re.compile(r"sorry|apolog|regret|unfortunat|thank|please|kindly|contact|ask|help|question|anything else|understand|désolé|merci|veuillez|regrett|malheureus|lo siento|lament|gracias|por favor|pregunta|leider|bitte|tut mir|danke|entschuld|क्षमा|खेद|कृपया|धन्यवाद", re.I)

CUT_MARK = re.compile(r"(?:\[?\s*(?:\.\.\.|…)\s*\]?|[(\[{]\s*(?:\.\.\.|…)?|(?:\bread|\bshow|\bsee) more\W*|\bweiterlesen\W*|\blire la suite\W*|\bleer más\W*|\bmehr (?:lesen|anzeigen)\W*|और पढ़ें\W*|\(?(?:truncated|gekürzt|cut off)\)?\W*)$", re.I)
DANGLING = set(
    "the a an of to in on at by for from with and or but nor as if when while because although since than that which who whose into onto over under about between such is are was were be been has have had can may will would should must not its their our your this these those each every very more most so too"
    " le la les l un une des du de d et ou mais que qui dont en dans par pour sur avec sans à au aux est sont ce cette ces ne se son sa ses chez vers lorsque quand si très plus"
    " el los las una unos unas del y o pero que en con por para sin sobre desde hasta es son se su sus al lo cuando si como muy más"
    " der die das den dem des ein eine einen einem einer und oder aber dass in im ins an am auf mit von vom zu zum zur für bei nach aus über unter ist sind wird werden wurde nicht wenn weil als wie sehr"
    " और या का के की को में से पर एक यह जो कि तो ने तथा".split()
)
OPEN_MARK = set(",;:-–—(/&+=“„«¿¡")
#: Words from which an answer is a sentence, and words from which its end is judged by how its last word goes on elsewhere; shorter answers may be fragments.
SENTENCE, LONG = 4, 7
#: A word or pair goes on if the Wilson lower bound (of so many deviations) of its share of ends is under this share.
END_SHARE, DEVIATIONS = 0.02, 1.0
PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
END_MARK = set(".!?।。…")

WORD = re.compile(r"[^\W_]+(?:[ऀ-ॣ०-ॿ‌‍]|[’'\-.](?=\w)|[^\W_])*")


_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_HIDDEN = re.compile(r"[\u200b-\u200f\u202a-\u202e\u2060\ufeff\xad]")


def plain(text: str | None) -> str:
    """text without tags, entities and invisible characters, with single spaces."""
    text = text or ""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return " ".join((text if text.isascii() else _HIDDEN.sub("", text)).split())


def _filler(text: str, known: frozenset[str]) -> bool:
    flat = " ".join(re.sub(r"\W+", " ", text.lower()).split())
    # a filler of marks and letters is at most twice as long as its words
    if len(flat) > 2 * max(map(len, known), default=0) + 2:
        return False
    return flat in known or (words := " ".join(WORD.findall(text.lower()))) in known or not words


def is_empty(answer: str | None, fillers: frozenset[str] = frozenset(FILLERS)) -> bool:
    return _filler(plain(answer), fillers)


def _strict(text: str) -> list[str]:
    return re.findall(r"[^\W_ऀ-ॿ]+|[ऀ-ॿ]+", text.lower().replace("’", "'"))


#: Signs of which each refusal holds one, looked for before the patterns.
SIGNS = ("not", "n't", "n’t", "cant", "wont", "couldnt", "unable", "refus", "declin", "no ", "any ", " ne ", "imposs", "aucune", "nicht", "keine", "नहीं", "असमर्थ")


#: Letters of a language that has a script of its own, and letters that the others of the Latin script don't use.
SCRIPTS = (("hi", "ऄ-हक़-ॡ"),)
LETTERS = (("fr", "èêëîïôûùœç"), ("es", "ñ¿¡íóúá"), ("de", "äöüß"))


@dataclass(frozen=True, eq=False)
class Words:
    """What the rules know of languages. signs: of these, each text that a refusal pattern matches holds one (none: all texts are searched)."""

    fillers: frozenset[str] = frozenset(FILLERS)
    label: re.Pattern = LABEL
    label_words: frozenset[str] = frozenset(LABEL_WORDS)
    stopwords: tuple[tuple[str, tuple[str, ...]], ...] = tuple((k, tuple(v)) for k, v in STOPWORDS.items())
    scripts: tuple[tuple[str, str], ...] = SCRIPTS
    letters: tuple[tuple[str, str], ...] = LETTERS
    refusals: tuple[re.Pattern, ...] = tuple(REFUSALS)
    signs: tuple[str, ...] = SIGNS
    courtesy: re.Pattern = COURTESY
    cut_mark: re.Pattern = CUT_MARK
    dangling: frozenset[str] = frozenset(DANGLING)

    @functools.cached_property
    def owners(self) -> dict[str, list[str]]:
        """The languages of each stopword."""
        out: dict[str, list[str]] = {}
        for lang, words in self.stopwords:
            for w in set(words):
                out.setdefault(w, []).append(lang)
        return out

    @functools.cached_property
    def script_letters(self) -> list[tuple[str, re.Pattern]]:
        return [(lang, re.compile(f"[{letters}]")) for lang, letters in self.scripts]


DEFAULT = Words()


def language_of(text: str, words: Words = DEFAULT) -> str:
    """The language whose script or stopwords a text shows, '' if it shows none clearly."""
    if not text.isascii():
        for lang, letters in words.script_letters:
            if own := len(letters.findall(text)):
                # names and codes may be in Latin letters; a mixture shows no language
                return lang if own >= 2 * len(re.findall(r"\b[a-zà-öø-ÿœß]{2,}\b", text)) else ""
    low, owners = text.lower(), words.owners
    score: Counter[str] = Counter()
    for w in re.findall(r"[^\W\d_]+", low):
        for lang in owners.get(w, ()):
            score[lang] += 1 / len(owners[w])
    if not low.isascii():
        for lang, letters in words.letters:
            score[lang] += 0.7 * min(3, sum(c in letters for c in low))
    best = score.most_common(2)
    if not best or best[0][1] < 1.3 or len(best) > 1 and best[0][1] < 1.5 * best[1][1]:
        return ""
    return best[0][0]


class Question:
    """What the rules need of a question."""

    def __init__(self, text: str | None, words: Words = DEFAULT):
        self.text = plain(text)
        self.strict = _strict(self.text)
        self.language = language_of(self.text, words)


#: The questions looked at last, as many pairs ask the same.
question_of = functools.lru_cache(maxsize=20_000)(Question)


class Pair:
    """A question and its answer, with the rules on them."""

    def __init__(self, question: str | None, answer: str | None, words: Words = DEFAULT):
        self.words = words
        self.question = question_of(question, words)
        self.answer = plain(answer)
        #: The answer without a label and a repetition of the question before it.
        self.body = words.label.sub("", self.answer)
        q = self.question.text
        if q and (bare := self.body.lstrip("\"“«„"))[: 2 * len(q)].lower().startswith(q.lower()):
            self.body = bare[len(q) :].lstrip(" \"”»“.:–-")

    def is_copy(self) -> bool:
        """The answer is the question once or more, with labels at most."""
        q = self.question.strict
        a = _strict(self.answer) if q and q[0] in self.answer.lower().replace("’", "'") else ()
        if not q or len(a) < len(q):
            return False
        i, found = 0, 0
        while i < len(a):
            if a[i : i + len(q)] == q:
                found, i = found + 1, i + len(q)
            elif a[i] not in self.words.label_words:
                return False
            else:
                i += 1
        return found > 0

    def is_refusal(self) -> bool:
        low = self.body.lower()
        if self.words.signs and not any(s in low for s in self.words.signs):
            return False
        said = [s for s in re.split(r"(?<=[.!?।])\s+", self.body) if s.strip()]
        refused = [any(r.search(s) for r in self.words.refusals) for s in said]
        if not any(refused):
            return False
        return sum(len(WORD.findall(s)) for s, r in zip(said, refused) if not r and not self.words.courtesy.search(s)) <= 5

    def is_other_language(self) -> bool:
        q = self.question.language
        return bool(q and (a := language_of(self.body, self.words)) and q != a)

    def open_end(self, copied: bool) -> tuple[bool, bool]:
        """(certainly cut, the corpus' counts must decide)."""
        text = self.body
        if not text or copied:
            return False, False
        last = text.rstrip("\"'”»)]")
        cut = self.words.cut_mark.search(text)
        if not cut and last and last[-1] in END_MARK and not any(text.count(o) > text.count(c) for c, o in PAIRS.items()):
            return False, False
        words = WORD.findall(text)
        if not words:
            return False, False
        if cut and len(words) > 1:
            return True, False
        if not last:
            return False, False
        if last[-1] in OPEN_MARK or any(text.count(o) > text.count(c) for c, o in PAIRS.items()):
            return True, False
        if last[-1] in END_MARK or re.search(r"\S*(?:://|www\.|@)\S*$", text):
            return False, False
        if words[-1].lower() in self.words.dangling and len(words) > 1:
            return True, False
        return False, len(words) >= SENTENCE

    def defects(self) -> tuple[list[str], bool]:
        """(defects that the pair itself shows, its end must be judged by the corpus)."""
        if _filler(self.answer, self.words.fillers):
            return ["empty_answer"], False
        copied = self.is_copy()
        cut, asked = self.open_end(copied)
        hits = (False, copied, self.is_refusal(), self.is_other_language(), cut)
        return [d for d, hit in zip(DEFECTS, hits) if hit], asked


# ---- words and ends of sentences, by hash


def _signs(texts: pa.Array, cut: str) -> pa.Array:
    """texts in lower case, without a mark of a cut, without what closes a quote or bracket, runs of digits as one digit, full stops in one form."""
    texts = pc.utf8_lower(texts)
    for old, new in ((cut, ""), (r"\.\.\.+|…", " "), (r"[\"'“”„«»‘’()\[\]]", ""), (r"[।。]", "."), (r"[0-9]+", "0"), (r"[–—·•→]", " ")):
        texts = pc.replace_substring_regex(texts, old, new)
    return texts


def words_and_ends(texts: pa.Array, cut: str = CUT_MARK.pattern) -> dict[str, np.ndarray]:
    """Of each word: row, word (its hash), start and end in the bytes, pair (hash with the word before it in its sentence, else 0), ends (1: it ends a sentence, 0: it goes on, -1: an open end)."""
    data, bounds = raw(_signs(texts, cut))
    inside = WORD_BYTES[data]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True
    first = first[: len(data)]
    last = np.append(first[1:], True)[: len(data)]
    start = inside & (first | ~np.append(False, inside[:-1])[: len(data)])
    end = inside & (last | ~np.append(inside[1:], False)[: len(data)])
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    rolling = Rolling(BYTE_VALUES[data])
    word = mixed(rolling.of(s, e) + (e - s).astype(np.uint64))
    of = row[s] if len(s) else np.empty(0, np.int64)
    # a word ends a sentence if a full stop follows, and then a space or the text's end
    padded = np.append(data, [10, 10]).astype(np.uint8)
    stop = np.isin(padded[e], np.frombuffer(b".!?", np.uint8)) & (of == row[np.minimum(e, len(data) - 1)] if len(data) else False)
    after = e + 1
    tail = after >= bounds[of + 1] if len(of) else np.empty(0, bool)
    ends = stop & (tail | (padded[np.minimum(after, len(data))] <= 32))
    final = np.append(of[1:] != of[:-1], True) if len(of) else np.empty(0, bool)
    begins = np.append(True, (of[1:] != of[:-1]) | ends[:-1]) if len(of) else np.empty(0, bool)
    pair = np.where(begins, np.uint64(0), mixed(np.append(np.uint64(0), word[:-1])[: len(word)] * np.uint64(3) + word))
    return {"row": of, "word": word, "start": s, "end": e, "pair": pair, "ends": np.where(ends, 1, np.where(final, -1, 0)), "rolling": rolling}


def _summed(keys: list[np.ndarray], values: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every, [np.bincount(at, np.concatenate(v), len(every)).astype(np.int64) for v in zip(*values)]


def _count(cut: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, ends, goes_on, heads): counts of words and pairs by hash, and the heads of longer words."""
        for batch in batches:
            for part in slices(batch, "answer"):
                w = words_and_ends(strings(part.column("answer")), cut)
                if not len(w["word"]):
                    continue
                ends, on = (w["ends"] == 1).astype(float), (w["ends"] == 0).astype(float)
                two = w["pair"] != 0
                # each different word's heads, of all lengths in bytes
                _, once = np.unique(w["word"], return_index=True)
                s, n = w["start"][once], w["end"][once] - w["start"][once] - 1
                begin = np.repeat(s, n)
                size = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
                heads = np.unique(mixed(w["rolling"].of(begin, begin + size) + size.astype(np.uint64)))
                none, one = np.zeros(len(heads)), np.ones(len(heads))
                zero = np.zeros(len(ends))
                keys, (e, o, h) = _summed([w["word"], w["pair"][two], heads], [[ends, on, zero], [ends[two], on[two], zero[two]], [none, none, one]])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(e), pa.array(o), pa.array(np.minimum(h, 1))], names=["gram", "ends", "goes_on", "heads"])

    return task


JUDGED = "row long, faq_id long, defects array<string>, last_word long, last_pair long, words int"


def _judge(words: Words):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a number for each row, as ids may be null or repeated; the result is written before it is used
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in runs(batches, 2_000):
            defects, open_, bodies = [], [], []
            for k, (q, a) in enumerate(zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist())):
                pair = Pair(q, a, words)
                got, asked = pair.defects()
                defects.append(got)
                if asked:
                    open_.append(k)
                    bodies.append(pair.body)
            n = batch.num_rows
            word, two, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32)
            if bodies:
                w = words_and_ends(pa.array(bodies, pa.large_string()), words.cut_mark.pattern)
                of = np.array(open_)[w["row"]]
                final = np.append(of[1:] != of[:-1], True) if len(of) else np.empty(0, bool)
                word[of[final]], two[of[final]] = w["word"][final].view(np.int64), w["pair"][final].view(np.int64)
                sizes = np.bincount(of, minlength=n).astype(np.int32)
            nothing = word == 0
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + at), batch.column("faq_id"), pa.array(defects, pa.list_(pa.string())), pa.array(word, mask=nothing), pa.array(two, mask=nothing), pa.array(sizes)], names=["row", "faq_id", "defects", "last_word", "last_pair", "words"])
            at += n

    return task


def hardly_ends(ends: Column, on: Column) -> Column:
    """Seen going on three times at least, with a share of ends that the counts don't show to be above END_SHARE."""
    n, z = F.greatest(ends + on, F.lit(1)), DEVIATIONS
    share = ends / n
    low = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return (on >= 3) & ((ends == 0) | (low < END_SHARE))


def defects(faqs: DataFrame, words: Words = DEFAULT) -> DataFrame:
    """(faq_id, defects): each defective pair with every defect that its rules found, in the order of DEFECTS."""
    rows = faqs.select(F.col("id").cast("bigint").alias("faq_id"), "question", "answer")
    judged = materialize(rows.mapInArrow(_judge(words), JUDGED))
    counts = rows.select("answer").filter("answer <> ''").distinct().mapInArrow(_count(words.cut_mark.pattern), "gram long, ends long, goes_on long, heads long").groupBy("gram").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("on"), F.max("heads").alias("heads"))
    asked = judged.filter("last_word is not null")
    looked = asked.select("row", "words", F.posexplode(F.array("last_word", "last_pair")).alias("n", "gram"))

    def of(n: int, c: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}_{n}")

    seen = looked.join(counts, "gram", "left").groupBy("row", "words").agg(*(of(n, c) for n in (0, 1) for c in ("ends", "on", "heads")))
    w_ends, w_on, p_ends, p_on = (F.col(c) for c in ("ends_0", "on_0", "ends_1", "on_1"))
    goes_on = hardly_ends(w_ends, w_on) | (hardly_ends(p_ends, p_on) & (w_ends * 4 < w_on))
    torn = (w_ends == 0) & (w_on == 0) & (F.col("heads_0") > 0)
    cut = seen.filter(torn | goes_on & (F.col("words") >= LONG)).select("row", F.lit(True).alias("cut"))
    every = F.when(F.col("cut"), F.concat("defects", F.array(F.lit("truncated_answer")))).otherwise(F.col("defects"))
    return judged.join(cut, "row", "left").select("faq_id", every.alias("defects")).filter(F.size("defects") > 0)


def main_defects(found: DataFrame) -> DataFrame:
    return found.select("faq_id", F.col("defects")[0].alias("defect"))
