"""Subject areas of documents.

The document-term matrix is factored into non-negative document mixtures and subject profiles by alternating multiplicative updates of
the Kullback-Leibler objective. The components are anchored: their profiles start from hand-labelled documents and from the words of the
subjects' glosses, and labelled documents may only use the components of their labels (a small leak lets the matrix overrule a wrong
label). Each round is one pass over the matrix: a document's mixture is worked out from the profiles at hand, and the new profiles are
sums over documents, which Spark adds up per term; neither factor is ever held for all documents.

The subjects are read off the mixtures of the last round. A document's mixture is worked out from all its terms, and from there the
mixtures of its sentences: the same update over the terms of one sentence, started half from the document's mixture. A sentence bears a
subject if the mass of its terms that tell of subjects is large enough, and it treats the components of its mixture that reach half of the
largest. Common phrases, figures of speech and notices stand beside every subject, so their terms have no weight in a mixture. A listing
of columns (fenced code, a JSON object, YAML items, a select list) counts as one sentence. A document has a subject if at least ``SHARE``
of its subject-bearing sentences treat it.

Defined cases: null, empty and blank texts and null ids have none; labels of unknown subjects and null labels are left out, repeated ones
count once; without any label the glosses alone anchor the components; several rows of one document id are judged
one by one, and the id has the subjects of each; texts are read whole; empty tables give no rows; other columns play no part.
The vocabulary is bounded: a term must be in ``RARE`` of all documents, and of those that are the ``VOCABULARY`` most frequent are used.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import cut, table

SHARE = 0.25
#: A term is used if it is in at least this part of the documents (and three), and in no more than COMMON.
RARE, COMMON = 5e-5, 0.5
ROUNDS, INNER = 8, 6
#: The labelled documents together weigh so many times as much as all documents when a term's shares are worked out; without that the
#: many documents without labels draw the components towards languages.
LABEL_MASS = 2.0
#: The most terms that the factors are kept for; with their profiles they are what the driver holds (some 20 MB for eight subjects).
VOCABULARY = 1 << 18
#: A loading from here on is clear; PRIOR documents of no information are added to each term's.
CLEAR, PRIOR = 0.6, 4.0
#: The least weight of its clear terms with which a sentence bears a subject: less than one term has that is found beside its subject only.
BEARING = 0.3
#: What a labelled document may have of subjects it is not labelled with; documents that a word of a gloss counts for; the least summed weight
#: of the terms of a document that takes part without labels.
LEAK, GLOSS_DOCS, EVIDENCE = 0.02, 8.0, 0.002

_HAN = "㐀-鿿豈-﫿"
_LETTER = rf"[^\W\d_{_HAN}]"
_TOKEN = re.compile(rf"[{_HAN}]+|[^\W_{_HAN}]*(?:_[^\W_{_HAN}]*)+|{_LETTER}+(?:['’-]{_LETTER}+)*|\S")
_LISTING = re.compile(
    r"```.*?(?:```|\Z)"  # fenced code
    r"|\{[^{}]*\}"  # a JSON object
    r"|(?:^|\n)(?:[ \t]*\w+:[ \t]*\n){0,4}(?:[ \t]*-[ \t]*name:[^\n]*(?:\n[ \t]+\w+:[ \t]*(?:\[[^\]\n]*\]|(?=\n)|\Z))*(?:\n|\Z)?)+",  # YAML items
    re.S,
)
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？｡।]+|\s*\n\s*")
_INVISIBLE = dict.fromkeys([0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF])


_SELECT, _FROM, _STOP = re.compile(r"\bselect\b"), re.compile(r"\bfrom\b[^\n;]*"), re.compile(r"[.;]")


def _select_lists(text: str) -> Iterator[tuple[int, int]]:
    """Places of select lists up to the end of the line of their ``from``; no mark that ends a sentence may stand between the two. Each
    part of the text is looked at once."""
    at, source, stop, n = 0, None, -1, len(text)
    for m in _SELECT.finditer(text):
        if m.start() < at:
            continue
        if source is None or source.start() < m.end():
            source = _FROM.search(text, m.end())
            if source is None:
                return
        if stop < m.end():
            found = _STOP.search(text, m.end())
            stop = found.start() if found else n
        if source.start() < stop:
            yield m.start(), source.end()
            at = source.end()


def _prose(text: str) -> Iterator[tuple[bool, str]]:
    at = 0
    for a, b in _select_lists(text):
        yield from ((False, s) for s in _END.split(text[at:a]) if s)
        yield True, text[a:b]
        at = b
    yield from ((False, s) for s in _END.split(text[at:]) if s)


def sentences(text: str) -> Iterator[tuple[bool, str]]:
    """(is a listing, text) of every sentence or listing of a document, in one spelling."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    text = text.lower().replace("\r", "")
    at = 0
    for m in _LISTING.finditer(text):
        yield from _prose(text[at : m.start()])
        yield True, m.group()
        at = m.end()
    yield from _prose(text[at:])


class Coder(dict):
    """Tokens to terms: words and pairs of adjacent words; names with underscores count only in listings, part by part; runs without
    blanks by pairs and triples of characters. A token's entry is a tuple of word numbers, 0 for a gap that no pair spans."""

    #: Tokens and words that are remembered before the tables start anew.
    LIMIT = 300_000

    def __init__(self) -> None:
        super().__init__()
        self.number: dict[str, int] = {}
        self.listing: dict[str, tuple] = {}
        self.words, self.single, self.pairs = [""], [False], [False]
        self.hashes = np.zeros(1, np.uint64)

    def _word(self, w: str, single: bool, pairs: bool) -> int:
        k = self.number.get(w)
        if k is None:
            k = self.number[w] = len(self.words)
            self.words.append(w)
            self.single.append(single)
            self.pairs.append(pairs)
        return k

    def __missing__(self, t: str) -> tuple:
        if "㐀" <= t[0] <= "鿿":
            grams = [t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)]
            got = (0, *(self._word(g, True, False) for g in grams), 0)
        elif "_" not in t and t[0].isalpha():
            got = (self._word(t, len(t) > 1, True),)
        else:
            got = (0,)
        self[t] = got
        return got

    def in_listing(self, t: str) -> tuple:
        if "_" not in t:
            return self[t]
        got = self.listing.get(t)
        if got is None:
            got = self.listing[t] = (0, *(self._word(p, True, True) for p in t.split("_") if p), 0)
        return got

    def numbers(self, listing: bool, sentence: str) -> list[int]:
        out: list[int] = []
        for t in _TOKEN.findall(sentence):
            out += self.in_listing(t) if listing else self[t]
        return out

    def codes(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the terms of sentences that lie one after the other in ``numbers``, and how many each has."""
        if len(self.hashes) < len(self.words):
            new = pd.util.hash_array(np.array(self.words[len(self.hashes) :], dtype=object), categorize=False)
            self.hashes = np.concatenate((self.hashes, new))
        h, single, pairs = self.hashes[numbers], np.array(self.single)[numbers], np.array(self.pairs)[numbers]
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        out, keep = np.zeros((len(numbers), 2), np.uint64), np.zeros((len(numbers), 2), bool)
        out[:, 0], keep[:, 0] = h, single
        if len(numbers) > 1:
            keep[1:, 1] = pairs[1:] & pairs[:-1] & (sentence[1:] == sentence[:-1])
            z = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
            z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out[1:, 1] = z ^ (z >> np.uint64(32))
        return out[keep].view(np.int64), np.bincount(sentence, keep.sum(axis=1), len(sizes)).astype(np.int64)

    def of(self, listing: bool, sentence: str) -> np.ndarray:
        numbers = np.array(self.numbers(listing, sentence), np.int64)
        return self.codes(numbers, np.array([len(numbers)]))[0]


def coded_sentences(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, labels) -> (doc_id, labels, listing, sizes, codes): the only pass over the texts. ``sizes`` has the number of
    terms of every sentence, ``listing`` says which of them are listings, ``codes`` holds the 64-bit codes of the terms of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for b in batches:
            if len(coder.words) > Coder.LIMIT or len(coder) > Coder.LIMIT:
                coder = Coder()
            flags, sizes, numbers, per = [], [], [], []
            for t in b.column(1).to_pylist():
                before = len(sizes)
                for listing, s in sentences(t):
                    got = coder.numbers(listing, s)
                    if any(got):
                        flags.append(listing)
                        sizes.append(len(got))
                        numbers += got
                per.append(len(sizes) - before)
            codes, n_terms = coder.codes(np.array(numbers, np.int64), np.array(sizes, np.int64))
            flags, per = np.array(flags, bool), np.array(per, np.int64)
            ends = np.concatenate(([0], np.cumsum(n_terms)))
            rows = np.concatenate(([0], np.cumsum(per)))
            lists = (pa.ListArray.from_arrays(pa.array(rows, pa.int32()), x) for x in (pa.array(flags), pa.array(n_terms, pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *lists, pa.ListArray.from_arrays(pa.array(ends[rows], pa.int32()), pa.array(codes))], ["doc_id", "labels", "listing", "sizes", "codes"])

    return docs.select("doc_id", "text", "labels").mapInArrow(run, "doc_id long, labels long, listing array<boolean>, sizes array<int>, codes array<long>")


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column laid end to end, and the number of each row's."""
    offsets = np.asarray(column.offsets, np.int64)
    return np.asarray(column.flatten()).astype(dtype, copy=False), np.diff(offsets)


def _distinct(row: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place) pairs in order; places lie below ``width``."""
    key = np.unique(row * width + place)
    return key // width, key % width


def vocabulary(coded: DataFrame, n_docs: int) -> np.ndarray:
    """Codes of the corpus's terms, sorted. Document frequencies cover the prose of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags, _ = _flat(b.column(0), bool)
            sizes, _ = _flat(b.column(1), np.int64)
            codes, n_codes = _flat(b.column(2), np.int64)
            prose = ~np.repeat(flags, sizes)
            values, place = np.unique(codes[prose], return_inverse=True)
            _, place = _distinct(np.repeat(np.arange(b.num_rows), n_codes)[prose], place, max(1, len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.bincount(place, minlength=len(values)), pa.int64())], ["code", "n"])

    df = coded.select("listing", "sizes", "codes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    kept = df.where((F.col("n") >= max(3, RARE * n_docs)) & (F.col("n") <= max(10, COMMON * n_docs))).orderBy(F.desc("n"), "code").limit(VOCABULARY)
    return np.sort(kept.select("code").toPandas()["code"].to_numpy(np.int64))


def _index(known: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Place of each code in the vocabulary, -1 if it is not there."""
    i = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[i] == codes, i, -1)


def term_matrix(coded: DataFrame, words) -> DataFrame:
    """Sparse rows (labels, terms): the terms that a document has; ``labels`` is a bit mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, n = _flat(b.column(1), np.int64)
            place = _index(words.value, codes)
            doc, term = _distinct(np.repeat(np.arange(b.num_rows), n)[place >= 0], place[place >= 0], len(words.value))
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=b.num_rows))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(term, pa.int32()))], ["labels", "terms"])

    return coded.select("labels", "codes").mapInArrow(run, "labels long, terms array<int>")


def mixtures(profiles: np.ndarray, weight: np.ndarray, ids: np.ndarray, n: np.ndarray, start: np.ndarray, allowed: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows of terms (``n`` each, none empty) -> (mixtures, mass): INNER multiplicative updates of the mixtures under fixed profiles, and
    the weight of a row's terms that each component takes."""
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    some, count, mix = profiles[ids], weight[ids], start
    mass = np.zeros_like(mix)
    for _ in range(INNER):
        share = some * np.repeat(mix, n, axis=0)
        share *= (count / np.maximum(share.sum(axis=1), 1e-30))[:, None]
        mass = np.add.reduceat(share, first, axis=0)
        mix = (mass + 1e-6) * allowed
        mix = mix / mix.sum(axis=1, keepdims=True)
    return mix, mass


def _update(k: int, state):
    """One pass over the matrix: partial sums of the new profiles, labelled documents by their weight, and of the documents of a term.
    Without profiles the mixtures are the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, profiles, weight, heavy = state.value
        total = np.zeros((size, k + 1))
        for b in batches:
            ids, n = _flat(b.column(1), np.int64)
            labels = ((np.asarray(b.column(0))[:, None] >> np.arange(k)) & 1).astype(float)
            labelled = labels.any(axis=1)
            number = np.repeat(np.arange(len(n)), n)
            keep = labelled if weight is None else (np.bincount(number, weight[ids], len(n)) > EVIDENCE) | labelled
            keep = keep & (n > 0)
            ids, n, labels, labelled = ids[keep[number]], n[keep], labels[keep], labelled[keep]
            if not len(n):
                continue
            allowed = np.where(labelled[:, None], np.maximum(labels, LEAK), 1.0)
            mix = allowed / allowed.sum(axis=1, keepdims=True)
            if weight is None:
                share = np.repeat(mix, n, axis=0)
            else:
                mix, _ = mixtures(profiles, weight, ids, n, mix, allowed)
                share = profiles[ids] * np.repeat(mix, n, axis=0)
                share /= np.maximum(share.sum(axis=1), 1e-30)[:, None]
            share *= np.repeat(np.where(labelled, heavy, 1.0), n)[:, None]
            for j in range(k):
                total[:, j] += np.bincount(ids, share[:, j], size)
            total[:, k] += np.bincount(ids, minlength=size)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(total[some, j]) for j in range(k + 1))], ["term", *(f"k{j}" for j in range(k + 1))])

    return run


def _information(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loadings of the terms, and their weights in the matrix: the squared information (relative entropy to the subjects at large, less
    what chance gives a term of so few documents), 0 for a term that says nothing and 1 for one that names its subject."""
    k, n = mass.shape[1], mass.sum(axis=1, keepdims=True)
    part = np.maximum(mass.sum(axis=0) / max(1e-12, mass.sum()), 1e-3)
    part /= part.sum()
    loading = (mass + PRIOR * part) / (n + PRIOR)
    entropy = (loading * np.log(np.maximum(loading, 1e-12) / part)).sum(axis=1) - 1.5 * (k - 1) / (2 * np.maximum(n[:, 0], 1.0))
    return loading, np.clip(entropy / np.log(k) if k > 1 else entropy * 0 + 1, 0, 1) ** 2


def factor(matrix: DataFrame, subjects: list[str], anchors: np.ndarray, heavy: float = 1.0, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """matrix -> (profiles, weights, telling): the profiles (terms x subjects) and column weights of the last round, and the weights with
    which a term tells of its subject in a sentence.

    The columns of the matrix are weighted by how much their terms tell; a language's common words tell nothing of a subject, and
    without the weights the components would settle on languages.
    """
    sc, k = matrix.sparkSession.sparkContext, len(subjects)
    state = sc.broadcast((len(anchors), None, None, heavy))  # the vocabulary is bounded, see there
    schema = "term int, " + ", ".join(f"k{j} double" for j in range(k + 1))
    for step in range(rounds + 1):
        sums = matrix.mapInArrow(_update(k, state), schema).groupBy("term").agg(*(F.sum(f"k{j}").alias(f"k{j}") for j in range(k + 1))).toPandas()
        mass, n = np.zeros(anchors.shape), np.zeros(len(anchors))
        if len(sums):
            mass[sums["term"].to_numpy()] = sums[[f"k{j}" for j in range(k)]].to_numpy()
            n[sums["term"].to_numpy()] = sums[f"k{k}"].to_numpy()
        mass, n = mass + GLOSS_DOCS * anchors, n + GLOSS_DOCS * anchors.sum(axis=1)
        mass *= (n / np.maximum(mass.sum(axis=1), 1e-12))[:, None]  # shares by the weighted sums, as many documents as there are
        loading, weight = _information(mass)
        profiles = mass + 0.02 * loading + 1e-9
        profiles = profiles / profiles.sum(axis=0)
        state = sc.broadcast((len(anchors), profiles, weight, heavy))
    top = loading.max(axis=1)
    raw = (mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-12))[np.arange(len(mass)), loading.argmax(axis=1)]
    telling = np.where(top >= CLEAR, np.clip(2 * raw - 1, 0, 1) ** 2 * np.sqrt(np.clip(2 * top - 1, 0, 1)), 0.0)
    return profiles, weight, telling


def subject_sentences(coded: DataFrame, state, names: list[str]) -> DataFrame:
    """-> (doc_id, subject, n, n_bearing): sentences that treat each subject, and sentences that treat any, off the mixtures."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, profiles, weight, telling = state.value
        for b in batches:
            sizes, n_sentences = _flat(b.column(1), np.int64)
            codes, n_codes = _flat(b.column(2), np.int64)
            place = _index(known, codes)
            doc = np.repeat(np.arange(b.num_rows), n_codes)
            rows, terms = _distinct(doc[place >= 0], place[place >= 0], len(known))
            n = np.bincount(rows, minlength=b.num_rows)
            of_doc = np.full((b.num_rows, k), 1.0 / k)
            if len(terms):
                of_doc[n > 0] = mixtures(profiles, weight, terms, n[n > 0], of_doc[n > 0])[0]
            hit = place >= 0
            hit[hit] = telling[place[hit]] > 0
            inside = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[hit], minlength=len(sizes))
            home = np.repeat(np.arange(b.num_rows), n_sentences)
            mass = np.zeros((len(sizes), k))
            some = inside > 0
            if some.any():
                mass[some] = mixtures(profiles, telling, place[hit], inside[some], 0.5 * of_doc[home[some]] + 0.5 / k)[1]
            top = mass.max(axis=1, initial=0.0)
            bearing = top >= BEARING
            treats = (mass >= 0.5 * top[:, None]) & bearing[:, None]
            n_bearing = np.bincount(home, bearing, b.num_rows).astype(np.int64)
            n = np.stack([np.bincount(home, treats[:, j], b.num_rows) for j in range(k)], axis=1).astype(np.int64)
            row, j = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array([names[x] for x in j], pa.string()), pa.array(n[row, j]), pa.array(n_bearing[row])], ["doc_id", "subject", "n", "n_bearing"])

    return coded.select("doc_id", "sizes", "codes").mapInArrow(run, "doc_id long, subject string, n long, n_bearing long")


def gloss_anchors(names: list[str], gloss: dict[str, str], known: np.ndarray) -> np.ndarray:
    """Terms of the vocabulary that the name and gloss of one subject have, and those of no other."""
    coder = Coder()
    codes = [set(coder.of(False, f"{s} . {gloss.get(s, '')}".lower()).tolist()) for s in names]
    anchors = np.zeros((len(known), len(names)))
    for j, own in enumerate(codes):
        rest = set().union(*(c for i, c in enumerate(codes) if i != j))
        place = _index(known, np.array(sorted(own - rest), np.int64))
        anchors[place[place >= 0], j] = 1.0
    return anchors


def assign_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rid: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, subject, n, n_bearing) for every subject that at least SHARE of the document's subject-bearing sentences treat."""
    spark = documents.sparkSession
    names = sorted({r["subject"] for r in subjects.where(F.col("subject").isNotNull()).collect()})  # the allowed subjects, a handful
    gloss = {r["subject"]: r["gloss"] or "" for r in subjects.collect()} if "gloss" in subjects.columns else {}
    number = F.create_map(*(x for i, s in enumerate(names) for x in (F.lit(s), F.lit(1 << i)))) if names else F.create_map(F.lit(""), F.lit(0))
    marked = labels.where(F.col(rid).isNotNull() & F.col("subject").isin(names)).select(F.col(rid).cast("long").alias("doc_id"), "subject").distinct()
    masks = marked.groupBy("doc_id").agg(F.sum(F.element_at(number, F.col("subject")).cast("long")).alias("labels"))
    docs = documents.select(F.col(rid).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}\p{C}]"))
    coded = cut(coded_sentences(docs.join(masks, "doc_id", "left").withColumn("labels", F.coalesce("labels", F.lit(0).cast("long")))))
    n_docs, n_labelled = coded.agg(F.count("*"), F.count_if(F.col("labels") > 0)).first()
    known = vocabulary(coded, n_docs)
    if not len(known) or not names:
        return spark.createDataFrame([], "doc_id long, subject string, n long, n_bearing long")
    sc = spark.sparkContext
    matrix = cut(term_matrix(coded, sc.broadcast(known)))
    profiles, weight, telling = factor(matrix, names, gloss_anchors(names, gloss, known), LABEL_MASS * n_docs / n_labelled if n_labelled else 1.0)
    if not telling.any():
        return spark.createDataFrame([], "doc_id long, subject string, n long, n_bearing long")
    per = subject_sentences(coded, sc.broadcast((known, profiles, weight, telling)), names)
    return per.where(F.col("n") >= SHARE * F.col("n_bearing")).groupBy("doc_id", "subject").agg(F.max("n").alias("n"), F.max("n_bearing").alias("n_bearing"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return assign_subjects(table(spark, d, "documents"), table(spark, d, "doc_label"), table(spark, d, "subject_area"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of every document."""
    return _assigned(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents per subject; a document with several subjects counts for each."""
    return _assigned(spark, d).groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_sentences"))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition}
ORACLE = {}
