"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Pre-tokenisation works on arrays of code points: each gets a class (letter, number, blank, other), and the boundaries follow from scans
over the classes. Where a run of one class starts and ends is an associative scan (running maximum of change positions, from the left
and from the right), so a whole batch of texts is cut at once; a blank before a run goes with it if it is a plain space, and contractions
are cut out of letter runs. No regular expression takes part. The slices are merged pair by pair in rank order, through a cache, and
every token keeps its byte offset, so any id can be traced to its place and a text is decoded exactly.

Defined cases: null and empty texts have the empty list; a code point that is no letter, number or blank is 'other', unassigned ones
too; texts of any length are encoded whole; repeated rows are encoded as they come; other columns play no part.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ship, table

#: Folder of the public vocabulary files; the session setting of this name overrides it.
TOKENIZERS, SETTING = "/opt/tokenizers", "spark.plumbline.tokenizers"
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
#: Blanks as the pattern of the vocabulary means them (the property White_Space).
_BLANKS = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points that are worked on at once.
CHUNK = 1_000_000
_CACHE_SIZE = 500_000

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point, made once per process from the Unicode database."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _classes = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        _classes[_BLANKS] = BLANK
    return _classes


def boundaries(points: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """True where a pre-token starts. points: code points of texts laid end to end; text_start: true at each text's first one."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    cls = classes()[points]
    change = text_start.copy()
    change[1:] |= cls[1:] != cls[:-1]
    ends_text = np.append(text_start[1:], True)
    run_end = np.append(change[1:], True)  # last position of its run
    start = change & (cls != BLANK)
    # the start of a run moves one back onto a plain space before it
    blank = cls == BLANK
    lead = np.zeros(n, bool)
    lead[:-1] = start[1:] & blank[:-1] & (points[:-1] == 0x20) & ~text_start[1:]
    start[1:] &= ~lead[:-1]
    # blanks: the run's first one starts a token; the last one before a word does, if others come before it or it leads the word
    start |= lead | (blank & change)
    start |= blank & run_end & ~ends_text
    # contractions after an apostrophe that starts a token and stands alone in its run
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        padded = np.concatenate((points, [0, 0]))
        first_of_next = np.concatenate((text_start, [True, True]))
        one, two = padded[quote + 1], padded[quote + 2]
        inside1, inside2 = ~first_of_next[quote + 1], ~first_of_next[quote + 1] & ~first_of_next[quote + 2]
        short = inside1 & np.isin(one, [ord(c) for c in "stmd"])
        long = inside2 & np.isin(one * 0x110000 + two, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")]) & ~short
        for at, width in ((quote[short], 2), (quote[long], 3)):
            start[at + 1] = False
            if width == 3:
                start[at + 2] = False
            after = at + width
            after = after[after < n]
            # the rest of the letter run is a token of its own; another class starts one anyway
            start[after[cls[after] == LETTER]] = True
    return start


class Merger:
    """Pair merging by rank, with a cache of whole pre-tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.cache = ranks, {}

    @classmethod
    def from_file(cls, raw: bytes) -> Merger:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)})

    def ids(self, piece: bytes) -> list[int]:
        found = self.cache.get(piece)
        if found is None:
            rank = self.ranks.get(piece)
            found = [rank] if rank is not None else self._short(piece) if len(piece) < 64 else self._long(piece)
            if len(piece) < 64:
                if len(self.cache) >= _CACHE_SIZE:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def _short(self, piece: bytes) -> list[int]:
        parts, get = [piece[i : i + 1] for i in range(len(piece))], self.ranks.get
        scores = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = min((s for s in scores if s is not None), default=None)
            if best is None:
                return [self.ranks[p] for p in parts]
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1])
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i])

    def _long(self, piece: bytes) -> list[int]:
        """The same with a linked list and a heap: a run of any length in n log n."""
        n, get = len(piece), self.ranks.get
        end, nxt, prev = [i + 1 for i in range(n)], [i + 1 for i in range(n)], [i - 1 for i in range(n)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= n or end[nxt[i]] != stop:
                continue
            j = nxt[i]
            alive[j], end[i], nxt[i] = False, end[j], nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (p := prev[i]) >= 0 and (r := get(piece[p : end[i]])) is not None:
                heapq.heappush(heap, (r, p, end[i]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = nxt[i]
        return out


def encode_texts(texts: list[str], merger: Merger) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts laid end to end, and the offsets of the texts in them."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = "".join(texts)
    data = whole.encode("utf-8")
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    begin = np.cumsum(lengths) - lengths
    first = np.zeros(len(points), bool)
    first[begin[lengths > 0]] = True
    at = np.flatnonzero(boundaries(points, first))
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    byte_at = (np.cumsum(width) - width)[at]
    ids, counts = [], np.zeros(len(at), np.int64)
    cuts = [*byte_at.tolist(), len(data)]
    get = merger.ids
    for k in range(len(at)):
        got = get(data[cuts[k] : cuts[k + 1]])
        ids += got
        counts[k] = len(got)
    upto = np.concatenate(([0], np.cumsum(counts)))
    return np.array(ids, np.int32), upto[np.searchsorted(at, np.append(begin, len(points)))]


def token_offsets(ids: list[int], vocabulary: list[bytes]) -> list[int]:
    """Byte offset of each token in its text; one more for the end."""
    return np.concatenate(([0], np.cumsum([len(vocabulary[i]) for i in ids]))).astype(int).tolist()


def decode(ids: list[int], vocabulary: list[bytes]) -> str:
    """The text of ids."""
    return b"".join(vocabulary[i] for i in ids).decode("utf-8", "replace")


def vocabulary_file(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> Broadcast:
    """The rank file as a broadcast value; its size is fixed (under 1 MB) and does not depend on the data."""
    ship(spark)
    folder = spark.conf.get(SETTING, TOKENIZERS)
    with open(f"{folder}/{name}", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_mergers: dict[int, Merger] = {}


def merger_of(raw: Broadcast) -> Merger:
    """The merger of a rank file, one per process."""
    key = hash(raw.value)
    if key not in _mergers:
        _mergers[key] = Merger.from_file(raw.value)
    return _mergers[key]


def chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts (null as empty) in pieces of bounded size, with the number of rows of each piece."""
    rows, size = [], 0
    for x in column.to_pylist():
        rows.append(x or "")
        size += len(rows[-1])
        if size >= CHUNK:
            yield len(rows), rows
            rows, size = [], 0
    if rows:
        yield len(rows), rows


def encode(df: DataFrame, rid: str, text: str) -> DataFrame:
    """(doc_id, ids) of every row of df."""
    raw = vocabulary_file(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(raw)
        for b in batches:
            done = 0
            for n, texts in chunks(b.column(1)):
                ids, offsets = encode_texts(texts, merger)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, n), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])
                done += n

    return df.select(F.col(rid).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def vocabulary_of(merger: Merger) -> list[bytes]:
    """The bytes of each id."""
    out = [b""] * (max(merger.ranks.values(), default=-1) + 1)
    for b, i in merger.ranks.items():
        out[i] = b
    return out


def encode_with_offsets(df: DataFrame, rid: str, text: str) -> DataFrame:
    """(doc_id, ids, starts) of every row of df; ``starts`` is the byte offset of each token in the UTF-8 text."""
    raw = vocabulary_file(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(raw)
        width = np.array([len(b) for b in vocabulary_of(merger)], np.int64)
        for b in batches:
            done = 0
            for n, texts in chunks(b.column(1)):
                ids, offsets = encode_texts(texts, merger)
                upto = np.concatenate(([0], np.cumsum(width[ids])))
                starts = upto[:-1] - np.repeat(upto[offsets[:-1]], np.diff(offsets))
                lists = (pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (ids, starts))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, n), *lists], ["doc_id", "ids", "starts"])
                done += n

    return df.select(F.col(rid).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>")


def decode_rows(df: DataFrame) -> DataFrame:
    """df(doc_id, ids) -> (doc_id, text): the encoding undone."""
    raw = vocabulary_file(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_of(merger_of(raw))
        for b in batches:
            texts = [b"".join(map(words.__getitem__, ids or ())).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_counts(df: DataFrame, rid: str, text: str) -> DataFrame:
    """(doc_id, n_tokens) of every row of df."""
    raw = vocabulary_file(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(raw)
        for b in batches:
            counts = [np.diff(encode_texts(texts, merger)[1]) for _, texts in chunks(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())], ["doc_id", "n_tokens"])

    return df.select(F.col(rid).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document."""
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and characters per source."""
    docs = table(spark, d, "documents")
    got = token_counts(docs, "doc_id", "text").join(docs.select("doc_id", "source", F.length("text").alias("n_chars")), "doc_id")
    return got.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_chars").alias("n_chars"))


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document with the byte offset of each token."""
    return encode_with_offsets(table(spark, d, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source, and those that the encoding gives back exactly (null as empty)."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("_text"))
    back = decode_rows(encode(table(spark, d, "documents"), "doc_id", "text"))
    return docs.join(back, "doc_id").groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if(F.col("text") == F.col("_text")).alias("n_equal"))


QUERIES = {"p7_ids": p7_ids, "p7_counts": p7_counts, "p7_offsets": p7_offsets, "p7_round_trip": p7_round_trip}
ORACLE = {"p7_round_trip": "SELECT source, count(*) AS n_documents, count(*) AS n_equal FROM documents WHERE doc_id IS NOT NULL GROUP BY 1"}
