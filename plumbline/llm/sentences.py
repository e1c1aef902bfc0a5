"""Sentence boundaries across languages and scripts.

Nothing but the texts themselves says what an abbreviation is. One pass over all texts counts, per language (that of the text, by its
function words; the script where that tells nothing or a token is of another script), how often a word type stands with and without a period, how often with a period at the end of a paragraph, which types
follow a period after it, and which types start paragraphs or follow marks that can only be ends. From the counts, summed up in Spark:

* a *starter* is a type that is found at sure starts, more often than chance (log-likelihood ratio) or for a fair part of its uses;
* an *abbreviation* is a type that stands with a period more often than types do (log-likelihood ratio), and whose period stands at the
  end of a paragraph less often than sentence ends do (log-likelihood ratio);
* a *collocation* is an abbreviation or number and the type after it, if the pair is more frequent than starts would make it.

The second pass classifies each mark of each text with these statistics: a period after an abbreviation, an initial or a number ends a
sentence only before a starter that is no collocation of it; an ellipsis only before a starter; marks inside paired quotes and brackets
never, and after the closing one only where a start follows. Full stops of scripts without case always end; in Thai a blank does; an empty
line always does, a single line break never by itself.

Defined cases: null, blank and empty texts have no units; repeated rows count once; a quote without its partner is an ordinary character;
texts of any length are treated whole; empty tables give no rows; other columns play no part. A model is bounded: a type enters it only
if it makes up a fixed part of the starts or periods of its own language.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import cut, table

#: A type enters the model if it has at least this part of its language's starts (or periods), and at least so many.
PART, LEAST = 2e-4, 3
#: Log-likelihood ratio of one degree of freedom at 0.1 % (10.8), and of a sure difference.
SURE = 10.8

_PARAGRAPH = regex.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*| \s*")
_OUTER = " \t\r\n\f\v\u0085                 　​﻿"
#: Marks that end a sentence whatever follows, of scripts that have their own.
_HARD = "。！？｡։।॥۔؟።፧፨။៕᠃᠉"
_MARK = regex.compile(rf"(?:\.\.\.+|…|[.!?;]|[{_HARD}])(?:[.!?…{_HARD}])*")
_CLOSERS = "\"'”’»›」』）)】]］}〉》“"
_OPENERS = "\"'“‘„‚«‹「『（([【［{〈《¡¿*-–—•·"
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "‹": "›", "“": "”", "„": "“", "‚": "‘", "‘": "’"}
_BRACKETS = "([{（［【"
_QUOTING = frozenset("\"'") | frozenset(_PAIRS) | frozenset(_PAIRS.values())
_QUOTES = re.compile("[" + re.escape("".join(sorted(_QUOTING))) + "]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+(?:(?:[.,'’:/@-]|\.)[\p{L}\p{M}\p{N}_]+)*")
_IDENT = regex.compile(r"[^\W\d]\w*_\w*|\w+(?:\.\w+)*_\w*")
_NUMBER = regex.compile(r"[^\W\d_]?\p{N}[\p{N}.,:/-]*")
_NO_SPACE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_THAI = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}]")


#: Function words by which a text's language is told from others of its script; all but a few are of one language.
FUNCTION_WORDS = {
    "LATIN": {
        "en": "the of and to in it at or be must can then here per is that for are with by from this which be each not as when", "de": "der die das und ist nicht mit ein eine für von den dem wird sind im auf wenn zu",
        "fr": "le les des et est une dans pour que du sont par sur pas qui avec au ce", "es": "el los las y es una para del por con se no cuando en son su como",
        "it": "il di che è per della non con sono gli nel dei alla questo ogni ed", "pt": "os as não uma com em do da são cada quando pelo ao seu por um",
        "nl": "het een van en niet voor met zijn wordt op bij deze aan ook elke is", "pl": "i w nie się na jest do że są dla przez jako oraz każdy", "tr": "ve bir bu için ile her olarak değil olan veya en", "sv": "och att det som en är av för inte med till den varje",
        "cs": "a je se na že pro není jako nebo každý byl jsou", "vi": "và của là các một không được trong cho với", "id": "dan yang di untuk dengan tidak dari ini adalah setiap",
    },
    "CYRILLIC": {"ru": "и в не на с что для по это как из или каждый если", "uk": "і та у не на з що для як є або кожен якщо це", "bg": "и в не на с за че от са да се като всеки"},
    "ARABIC": {"ar": "في من على إلى أن هذا التي لا كل أو", "fa": "و در به از که این را با است هر", "ur": "اور کے میں کی ہے کا سے پر ہر"},
}
_LANGUAGES_OF: dict[str, set] = {}
for _script, _of in FUNCTION_WORDS.items():
    for _language, _words in _of.items():
        for _word in _words.split():
            _LANGUAGES_OF.setdefault(_word, set()).add((_script, _language))


def language_of(text: str) -> tuple[str, str]:
    """(script, language) of a text: its function words vote, a word of several languages for each; ('', '') where none is found."""
    votes: Counter = Counter()
    seen = Counter(text.lower().split())
    for w in seen.keys() & _LANGUAGES_OF.keys():
        for k in _LANGUAGES_OF[w]:
            votes[k] += seen[w]
    return min(votes, key=lambda k: (-votes[k], k)) if votes else ("", "")


@lru_cache(maxsize=1 << 17)
def script_of(word: str) -> str:
    """Script of a token's first letter, from its Unicode name."""
    for c in word:
        if c.isalpha():
            return unicodedata.name(c, "?").split(" ")[0]
    return "-"


@lru_cache(maxsize=1 << 17)
def key_of(word: str, language: tuple[str, str]) -> str:
    """What a token's counts are kept under: the language of its text; its script if that is another one, or if it is of a class (an
    identifier, a number) that is the same in all languages."""
    script = script_of(word)
    return f"{script}:{language[1]}" if script == language[0] and type_of(word)[:1] != "#" else script


@lru_cache(maxsize=1 << 17)
def type_of(word: str) -> str:
    """The type that is counted: identifiers and numbers are classes, names keep their case only as a sign of a capital."""
    if _IDENT.fullmatch(word):
        return "#id"
    if _NUMBER.fullmatch(word):
        return "#num"
    return word.lower()


def llr(k1: float, n1: float, k2: float, n2: float) -> float:
    """Dunning's log-likelihood ratio of two binomials, signed: positive if the first rate is the higher one."""
    if not n1 or not n2:
        return 0.0

    def part(k: float, n: float, p: float) -> float:
        return (k * log(p) if k else 0.0) + ((n - k) * log(1 - p) if n > k else 0.0)

    p1, p2, p = k1 / n1, k2 / n2, (k1 + k2) / (n1 + n2)
    if p in (0.0, 1.0):
        return 0.0
    ratio = 2 * (part(k1, n1, p1) + part(k2, n2, p2) - part(k1, n1, p) - part(k2, n2, p))
    return ratio if p1 > p2 else -ratio


def _closes(c: str, before: str, after: str) -> bool:
    return (c != "'" or (not before.isspace() and not after.isalnum())) and (c != "’" or not after.isalnum())


def spans(text: str) -> list[tuple[int, int]]:
    """Paired quotes and brackets of a paragraph, outermost only, as (position of the opening mark, position of the closing one). A mark
    without its partner is an ordinary character. One pass; every mark is put on the stack and taken off once."""
    pairs, stack, waiting, n = [], [], Counter(), len(text)
    for m in _QUOTES.finditer(text):
        i, c = m.start(), m.group()
        before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < n else " "
        if waiting[c] and _closes(c, before, after):
            while True:  # what was opened inside and not closed falls away
                start, closer = stack.pop()
                waiting[closer] -= 1
                if closer == c:
                    break
            pairs.append((start, i))
            continue
        closer = c if c == '"' else c if c == "'" and not waiting[c] and not before.isalnum() and not after.isspace() else _PAIRS.get(c)
        if closer and not (c == "‘" and before.isalnum()):
            stack.append((i, closer))
            waiting[closer] += 1
    out, end = [], -1
    for a, b in sorted(pairs):
        if a > end:
            out.append((a, b))
            end = b
    return out


@dataclass
class Mark:
    """A place where a sentence may end: [at, stop) is the mark with its closing marks, ``word`` stands before it, ``next`` after it."""

    at: int
    stop: int
    text: str
    word: str
    next: str
    glued: bool  # nothing but the next sentence follows, without a blank
    last: bool  # nothing follows in the paragraph
    closed: str = ""  # the opening mark of the quote or bracket that ends here
    opened: int = -1


def _next_word(text: str, at: int) -> str:
    while at < len(text) and (text[at].isspace() or text[at] in _OPENERS):
        at += 1
    m = _WORD.match(text, at)
    return m.group() if m else text[at : at + 1]


def marks(text: str) -> Iterator[Mark]:
    """Candidate ends of a paragraph."""
    if not _MARK.search(text):
        return
    inside = spans(text)
    starts = {a for a, _ in inside}
    full = len(text.rstrip(_OUTER))
    k, skip = 0, 0
    content = -1  # last place inside the span at hand that is more than closing marks
    for m in _MARK.finditer(text):
        at, stop, mark = m.start(), m.end(), m.group()
        if at < skip:
            continue
        while k < len(inside) and inside[k][1] < at:
            k, content = k + 1, -1
        closed, opened = "", -1
        if k < len(inside) and inside[k][0] < at < inside[k][1]:
            if content < 0:
                content = inside[k][1] - 1
                while content > inside[k][0] and text[content] in _OUTER + _CLOSERS:
                    content -= 1
            if content >= stop:
                continue  # speech or brackets go on
            opened, stop = inside[k][0], inside[k][1] + 1
            closed = text[opened]
            while stop < len(text) and text[stop] in ".!?…" + _HARD:
                stop += 1
            skip = stop
        else:
            while stop < len(text) and text[stop] in _CLOSERS and stop not in starts:
                stop += 1
        j = at
        while j and at - j < 200 and not text[j - 1].isspace() and text[j - 1] not in _OPENERS + _CLOSERS + "," + _HARD:
            j -= 1
        last = stop >= full
        yield Mark(at, stop, mark, text[j:at], "" if last else _next_word(text, stop), not last and not text[stop].isspace(), last, closed, opened)


def _sure(m: Mark) -> bool:
    """A mark that is an end by itself."""
    return not m.closed and not m.glued and m.text[0] in "!?" + _HARD


def observe(texts: Iterator[str]) -> Counter:
    """Counts of one batch: (what, script, type[, following type]) -> n."""
    c: Counter = Counter()
    for text in texts:
        language = language_of(text or "")
        for paragraph in _PARAGRAPH.split(text or ""):
            body = paragraph.strip(_OUTER)
            if not body:
                continue
            first = _next_word(body, 0)
            c["start", key_of(first, language), type_of(first)] += 1
            for m in marks(body):
                if m.closed or (m.glued and not m.last):
                    continue
                if _sure(m):
                    if m.next:
                        c["start", key_of(m.next, language), type_of(m.next)] += 1
                    c["end", "-", ""] += m.last
                    c["ends", "-", ""] += 1
                elif m.text == "." and m.word:
                    s, w = key_of(m.word, language), type_of(m.word)
                    c["dot", s, w] += 1
                    c["last", s, w] += m.last
                    if m.next:
                        c["pair", s, w, type_of(m.next)] += 1
            for w in _WORD.finditer(body):
                c["all", key_of(w.group(), language), type_of(w.group())] += 1
    return c


@dataclass
class Model:
    """What was learned, per language."""

    abbreviations: set = field(default_factory=set)  # (language, type)
    starters: set = field(default_factory=set)
    collocations: set = field(default_factory=set)  # (language, type, next type)
    after_number: set = field(default_factory=set)  # types that follow numbers with a period and start nothing
    known: set = field(default_factory=set)  # (language, type): seen with a period often enough to be judged in that language

    def __post_init__(self) -> None:
        self.lend()

    def lend(self) -> None:
        """A type that a language says nothing of is judged as in the other languages of its script: texts quote one another."""
        self.lent = {(s.split(":")[0], w) for s, w in self.abbreviations}
        self.lent_pairs = {(s.split(":")[0], w, f) for s, w, f in self.collocations}

    def abbreviates(self, key: str, w: str) -> bool:
        return (key, w) in self.abbreviations or ((key, w) not in self.known and (key.split(":")[0], w) in self.lent)

    def goes_on(self, key: str, w: str, following: str) -> bool:
        return (key, w, following) in self.collocations or ((key, w) not in self.known and (key.split(":")[0], w, following) in self.lent_pairs)


def learn(counts: DataFrame) -> Model:
    """counts(what, script, word, follow, n), summed up over all texts -> the model."""
    totals = counts.groupBy("what", "script").agg(F.sum("n").alias("n"))
    total: dict[tuple, int] = {(r["what"], r["script"]): r["n"] for r in totals.collect()}  # a row per language
    floors = F.broadcast(totals.withColumn("_floor", F.greatest(F.lit(LEAST), F.floor(PART * F.col("n")))).select("what", "script", "_floor"))
    floored = counts.join(floors, ["what", "script"])

    def get(what: str, least) -> dict:
        rows = floored.where((F.col("what") == what) & (F.col("n") >= least)).collect()  # at most 1 / PART types of a language, by the floor
        return {((r["script"], r["word"], r["follow"]) if what == "pair" else (r["script"], r["word"])): r["n"] for r in rows}

    start, dot = get("start", F.col("_floor")), get("dot", F.col("_floor"))
    pair = get("pair", F.greatest(F.lit(2), F.floor(F.col("_floor") / 4)))
    keys = counts.sparkSession.createDataFrame([(*k,) for k in {*start, *dot}] or [("", "")], "script string, word string")
    seen = {(r["what"], r["script"], r["word"]): r["n"] for r in counts.where(F.col("what").isin("all", "last")).join(F.broadcast(keys), ["script", "word"], "left_semi").collect()}
    model = Model()
    for (s, w), k in start.items():
        uses, n_start, n_all = max(seen.get(("all", s, w), k), k), total.get(("start", s), 0), total.get(("all", s), 0)
        if k >= 0.02 * uses or llr(k, n_start, uses - k, max(1, n_all - n_start)) > SURE:
            model.starters.add((s, w))
    ends, at_end = max(1, total.get(("ends", "-"), 0)), total.get(("end", "-"), 0)
    for (s, w), k in dot.items():
        if w in ("#id", "#num") or not w:
            continue
        n_dot, n_all, n_last = total[("dot", s)], total.get(("all", s), 0), total.get(("last", s), 0)
        rate_k, rate_n = (at_end, ends) if at_end and ends >= 20 else (n_last, max(1, n_dot))
        uses = max(seen.get(("all", s, w), k), k)
        often = llr(k, uses, n_dot - k, max(1, n_all - uses)) > SURE and k >= 0.5 * uses
        never_last = llr(seen.get(("last", s, w), 0), k, rate_k, rate_n) < -SURE and seen.get(("last", s, w), 0) <= 0.1 * k
        if often and never_last:
            model.abbreviations.add((s, w))
    of_number, starts_of = Counter(), Counter()
    for (s, w), k in start.items():
        starts_of[w] += k
    for (s, w, f), k in pair.items():
        if w == "#num":
            of_number[f] += k
    n_start = sum(n for (what, _), n in total.items() if what == "start")
    for (s, w, f), k in pair.items():
        n = dot.get((s, w), 0)
        if n and k >= 0.5 * n and llr(k, n, starts_of[f], max(1, n_start)) > SURE and ((s, w) in model.abbreviations or _short(w)):
            model.collocations.add((s, w, f))
    model.known = set(dot)
    model.lend()
    starting = {w for _, w in model.starters}
    model.after_number = {f for f, k in of_number.items() if f not in starting and k >= LEAST}
    return model


def _short(w: str) -> bool:
    """Initials and types with inner periods are abbreviations by their form."""
    return (len(w) == 1 and w.isalpha()) or ("." in w and all(len(p) <= 2 and p.isalpha() for p in w.split(".")))


def ends_here(m: Mark, model: Model, unit_start: int, language: tuple[str, str] = ("", "")) -> bool:
    """Does the sentence end at this mark?"""
    if m.last:
        return True
    nxt, t = m.next, type_of(m.next)
    begins = (key_of(nxt, language), t) in model.starters
    lower = nxt[:1].islower()
    capital = nxt[:1].isupper() or nxt[:1].istitle()
    uncased = nxt[:1].isalpha() and not lower and not capital
    if m.text[0] == ";":  # the Greek question mark
        return script_of(m.word) == "GREEK" and not m.glued and (begins or capital or not lower)
    if m.closed:
        if m.closed in _BRACKETS:
            return m.opened <= unit_start and (begins or not lower)
        if m.glued:
            return begins and not _NO_SPACE.match(nxt[:1])
        return begins or capital or uncased
    if m.text[-1] in _HARD or m.text[0] in _HARD:
        return True
    if m.glued and capital and begins and m.text == ".":
        w = m.word.rpartition(".")[2]
        return len(w) > 1 and not model.abbreviates(key_of(w, language), type_of(w))
    if m.glued:
        return bool(_NO_SPACE.match(nxt[:1])) and m.text[0] in ".!?…" and not m.word[-1:].isdigit()
    if m.text[0] in "!?":
        return begins or not lower
    if m.text.startswith(("..", "…")):
        return begins or capital or uncased
    ws, w = key_of(m.word, language), type_of(m.word)
    if w == "#num":
        if t in model.after_number:
            return False
        return begins or capital or uncased
    if model.abbreviates(ws, w) or _short(w):
        return begins and not model.goes_on(ws, w, t)
    # sentences seldom begin with a number, abbreviations often stand before one
    return begins or not (lower or nxt[:1].isdigit()) or not m.word


def units(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit in code points."""
    out, at, language = [], 0, language_of(text)
    pieces = [(m.start(), m.end()) for m in _PARAGRAPH.finditer(text)]
    for stop, following in [*pieces, (len(text), len(text))]:
        body = text[at:stop]
        begin = len(body) - len(body.lstrip(_OUTER))
        for m in marks(body):
            if m.stop <= begin:
                continue
            if ends_here(m, model, begin, language):
                _thai(body, begin, m.stop, at, out)
                begin = m.stop
                while begin < len(body) and body[begin] in _OUTER:
                    begin += 1
        if body[begin:].strip(_OUTER):
            _thai(body, begin, len(body.rstrip(_OUTER)), at, out)
        at = following
    return out


def _thai(body: str, begin: int, stop: int, offset: int, out: list) -> None:
    """Add the unit; in scripts that write no blanks between words a blank ends a sentence."""
    for m in regex.finditer(r"(?<=[\p{Thai}\p{Lao}])\s+", body, pos=begin, endpos=stop):
        out.append((begin + offset, m.start() + offset))
        begin = m.end()
    if begin < stop:
        out.append((begin + offset, stop + offset))


def split_sentences(texts: DataFrame) -> DataFrame:
    """texts(src, row_key, text) -> (src, row_key, start_pos, end_pos); the model is learned from the same texts."""
    spark = texts.sparkSession
    rows = cut(texts.where(F.col("text").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}]")).select("src", "row_key", "text").distinct())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = observe(iter(b["text"]))
            yield pd.DataFrame([(k[0], k[1], k[2], k[3] if len(k) > 3 else "", n) for k, n in c.items()], columns=["what", "script", "word", "follow", "n"])

    counted = rows.select("text").mapInPandas(count, "what string, script string, word string, follow string, n long")
    model = learn(cut(counted.groupBy("what", "script", "word", "follow").agg(F.sum("n").alias("n"))))
    shared = spark.sparkContext.broadcast(model)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(s, k, a, e) for s, k, t in zip(b["src"], b["row_key"], b["text"]) for a, e in units(t, shared.value)]
            yield pd.DataFrame(got, columns=["src", "row_key", "start_pos", "end_pos"])

    return rows.mapInPandas(split, "src string, row_key string, start_pos long, end_pos long")


def corpus_texts(corpora: DataFrame, progress: DataFrame) -> DataFrame:
    """The texts of both tables."""
    a = corpora.select(F.lit("mine_schema_corpora").alias("src"), F.col("node_id").cast("string").alias("row_key"), F.col("description").alias("text"))
    r = progress.select("model", "run", F.explode("records").alias("_r"))
    key = F.concat(F.col("model"), F.lit("|"), F.col("run"), F.lit("|"), F.col("_r.item_index").cast("string"))
    return a.unionByName(r.select(F.lit("progress").alias("src"), key.alias("row_key"), F.col("_r.claim.source_sentence").alias("text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The place of every sentence."""
    return split_sentences(corpus_texts(table(spark, d, "mine_schema_corpora"), table(spark, d, "progress"))).distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Units per source, and their lengths."""
    got = p6_found(spark, d).withColumn("n", F.col("end_pos") - F.col("start_pos"))
    return got.groupBy("src").agg(F.count("*").alias("n_units"), F.countDistinct("row_key").alias("n_texts"), F.min("n").alias("shortest"), F.max("n").alias("longest"))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
ORACLE = {}
