"""Licence scan through a positional rare-token index.

Words of licence texts are weighed by inverse document frequency over all documents. The index holds the
places of the rare ones in every licence text. A document's licence words of highest weight are looked up
there; postings are intersected by relative position: hits whose distance from the licence text's start
agrees vote for one placement of it. Placements that lie close together are joined, so words put in or left
out don't part a text. Where enough agree, text and document are aligned word by word in order, and the
text's mandatory key phrase must stand there.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .decontaminate import item_words
from .licence_texts import TEXTS
from .shared import mapped, sent

#: Phrases whose every place counts, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Share of a text's words that must stand in order. Placements are joined if no further apart than a text that makes up that share of its stretch allows.
LEAST_MATCH = 0.7
#: Words of a text from which a part of it counts.
LEAST_STRETCH = 20
#: Of a document's licence words those in at most this share of documents are looked up first, or so many of highest weight.
RARE, LOOKED = 0.1, 24
#: Hits that must agree on a placement.
VOTES = 2


@dataclass
class Index:
    """`words`: hashes of all words of texts and phrases, sorted. Postings of word w are [at[w], at[w + 1]) of `text_of` and `place_of`."""

    words: np.ndarray
    at: np.ndarray
    text_of: np.ndarray
    place_of: np.ndarray
    idf: np.ndarray
    rare: np.ndarray
    texts: list[tuple[str, np.ndarray, dict[int, int], int]]  # label, key phrase as word numbers, for word numbers the bits of their places, words
    base: list[tuple[np.ndarray, str]]
    needed: np.ndarray  # for word numbers: whether it is the rarest word of a phrase; documents without such words hold no phrase


def vocabulary() -> list[bytes]:
    return sorted({w for _, p, t in TEXTS for w in item_words(p) + item_words(t)} | {w for p, _ in BASE for w in item_words(p)})


def frequencies(docs: DataFrame, text: str) -> tuple[int, dict[bytes, int]]:
    """Number of rows, and for words of the licence texts the rows that hold them. One row for each word and task is shuffled."""
    words = vocabulary()
    order = np.argsort(known := bw.hash_of(words))
    known = known[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(words) + 1, dtype=np.int64), 0
        for b in batches:
            total += b.num_rows
            for numbers, rows, _, _, _ in numbered(b.column(0), known):
                hits = np.flatnonzero(numbers >= 0)
                row = np.searchsorted(rows, hits, "right") - 1
                both = np.unique(row * len(words) + numbers[hits])
                n[:-1] += np.bincount(both % len(words), minlength=len(words))
        n[-1] = total
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["w", "n"])

    counts = {r["w"]: r["n"] for r in mapped(docs.select(F.col(text).cast("string")), run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return counts.pop(len(words), 0), {words[order[i]]: n for i, n in counts.items()}


def numbered(texts: pa.Array, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """For blocks of texts: each word's number in `known` or -1, the first word of each row, the lower-cased bytes, starts, ends."""
    data, offsets = bw.utf8(texts)
    for a, b in bw.blocks(offsets):
        part = bw.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, rows = bw.spans(part, offsets[a : b + 1] - offsets[a], bw.ALNUM)
        h = bw.hashes(part, starts, ends)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        yield np.where(known[at] == h, at, -1), rows, part, starts, ends


def index(n_docs: int, having: dict[bytes, int]) -> Index:
    words = vocabulary()
    known = bw.hash_of(words)
    order = np.argsort(known)
    number = {words[i]: j for j, i in enumerate(order)}
    idf = {w: math.log((n_docs + 1) / (having.get(w, 0) + 1)) for w in words}
    ids = lambda text: np.array([number[w] for w in item_words(text)])
    postings: list[tuple[int, int, int]] = []
    texts = []
    for t, (label, phrase, text) in enumerate(TEXTS):
        ws = item_words(text)
        postings += [(number[w], t, pos) for pos, w in enumerate(ws)]
        places: dict[int, int] = defaultdict(int)
        for pos, w in enumerate(ws):
            places[number[w]] |= 1 << pos
        texts.append((label, ids(phrase), dict(places), len(ws)))
    base = [(ids(p), label) for p, label in BASE]
    word_of, text_of, place_of = np.array(sorted(postings)).T
    weights = np.array([idf[words[i]] for i in order])
    needed = np.zeros(len(words) + 1, dtype=bool)
    needed[[max(p.tolist(), key=lambda w: (weights[w], w)) for p in (*(p for p, _ in base), *(x[1] for x in texts))]] = True
    rare = np.array([having.get(words[i], 0) <= RARE * n_docs for i in order])
    return Index(known[order], np.searchsorted(word_of, np.arange(len(words) + 1)), text_of, place_of, weights, rare, texts, base, needed)


def stands(numbers: np.ndarray, phrase: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Those of `starts` where the phrase's words stand one after another."""
    starts = starts[starts + len(phrase) <= len(numbers)]
    for k, w in enumerate(phrase):
        starts = starts[numbers[starts + k] == w]
    return starts


def in_order(numbers: np.ndarray, places: dict[int, int], size: int) -> int:
    """Most words of a text of `size` words that stand in `numbers` in the text's order, others between them or not (longest common subsequence, a bit for each word)."""
    full = (1 << size) - 1
    left = full
    for w in numbers.tolist():
        if m := places.get(w):
            u = left & m
            left = ((left + u) | (left - u)) & full
    return size - left.bit_count()


def joined(offsets: np.ndarray, slack: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of sorted placements that lie no more than `slack` apart and have enough votes, each largest such run once."""
    ends = np.searchsorted(offsets, offsets + slack, "right")
    done = 0
    for i, j in enumerate(ends.tolist()):
        if j > done and j - i >= VOTES:
            done = j
            yield i, j


def placed(numbers: np.ndarray, hits: np.ndarray, ix: Index) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each licence text with enough hits: place in the document and in the text for pairs of equal words, those of one relative position next to each other."""
    w = numbers[hits]
    n = ix.at[w + 1] - ix.at[w]
    of = np.repeat(ix.at[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    text, at, place = ix.text_of[of], np.repeat(hits, n), ix.place_of[of]
    order = np.lexsort((at - place, text))
    text, at, place = text[order], at[order], place[order]
    bounds = np.concatenate([np.flatnonzero(np.diff(text, prepend=-1)), [len(text)]])
    return {int(text[a]): (at[a:b], place[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a >= VOTES}


def highest(words: np.ndarray, ix: Index) -> np.ndarray:
    """Of the licence words of a document those of highest weight: all rare ones, or LOOKED."""
    words = words[np.argsort(-ix.idf[words], kind="stable")]
    return words[ix.rare[words] | (np.arange(len(words)) < LOOKED)]


def matched(numbers: np.ndarray, text: tuple, phrases: np.ndarray, at: np.ndarray, place: np.ndarray) -> float:
    """The best share of a licence text's words that stand in order where its hits agree on a placement and its key phrase stands; 0 if they are too few.

    Enough is LEAST_MATCH of the whole text, or of a part of LEAST_STRETCH words and more between the first and the last hit.
    """
    _, phrase, places, size = text
    slack, best, offsets = int(size / LEAST_MATCH) - size, 0.0, at - place
    for i, j in joined(offsets, slack):
        a, b = max(0, int(offsets[j - 1]) - slack), min(len(numbers), int(offsets[i]) + size + slack)
        if ((phrases >= a) & (phrases + len(phrase) <= b)).any():
            share = in_order(numbers[a:b], places, size) / size
            if share >= LEAST_MATCH:
                best = max(best, share)
    if best or size <= LEAST_STRETCH:
        return best
    for i, j in joined(offsets, int(LEAST_STRETCH / LEAST_MATCH) - LEAST_STRETCH):
        p0, p1, q0, q1 = int(at[i:j].min()), int(at[i:j].max()) + 1, int(place[i:j].min()), int(place[i:j].max()) + 1
        if q1 - q0 >= LEAST_STRETCH and ((phrases >= p0 - len(phrase)) & (phrases <= p1)).any():
            part = (1 << (q1 - q0)) - 1
            n = in_order(numbers[p0:p1], {w: m for w, x in places.items() if (m := x >> q0 & part)}, q1 - q0)
            if n >= LEAST_MATCH * max(q1 - q0, p1 - p0):
                best = max(best, n / size)
    return best


def scanned(numbers: np.ndarray, ix: Index) -> tuple[int, int | None, int | None, set[str], set[str], float]:
    """Of one document: n_base, first, last, base labels, the index's labels, score.

    A text whose phrase stands there but that words of highest weight don't place is looked up once more by all words, so weights only save work.
    """
    places, base = [], set()
    for phrase, label in ix.base:
        if len(at := stands(numbers, phrase, np.flatnonzero(numbers == phrase[0]))):
            places.append(at)
            base.add(label)
    own, score = set(), 0.0
    hits = np.flatnonzero(numbers >= 0)
    found = every_hit = None
    for t, text in enumerate(ix.texts):
        phrases = stands(numbers, text[1], np.flatnonzero(numbers == text[1][0]))
        if not len(phrases):
            continue
        if found is None:
            found = placed(numbers, hits[np.isin(numbers[hits], highest(np.unique(numbers[hits]), ix))], ix)
        share = matched(numbers, text, phrases, *found[t]) if t in found else 0.0
        if not share:
            every_hit = placed(numbers, hits, ix) if every_hit is None else every_hit
            share = matched(numbers, text, phrases, *every_hit[t]) if t in every_hit else 0.0
        if share:
            own.add(text[0])
            score = max(score, share)
    every = np.concatenate(places) if places else np.zeros(0, np.int64)
    return len(every), int(every.min()) if places else None, int(every.max()) if places else None, base, own, score


def licence_scan(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each row of `docs`.

    n_base counts the places of the BASE phrases, first_word and last_word are the smallest and largest
    word number where one starts (null if none). labels adds those whose licence text stands in the
    document, or a part of it; score is the best share of such a text's words in order (0 if none). Null and empty
    texts have no words. Two passes over the texts, no shuffle but for counts of licence words.
    """
    shared = sent(docs.sparkSession, index(*frequencies(docs, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            n_words: list[int] = []
            found: list[tuple] = []
            for numbers, rows, part, starts, ends in numbered(b.column(1), ix.words):
                n_words += np.diff(rows).tolist()
                cuts = np.searchsorted(np.flatnonzero(ix.needed[numbers]), rows)
                for r in range(len(rows) - 1):
                    found.append(scanned(numbers[rows[r] : rows[r + 1]], ix) if cuts[r] < cuts[r + 1] else (0, None, None, set(), set(), 0.0))
            n, first, last, base, own, score = zip(*found, strict=True) if found else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array([",".join(sorted(x | y)) for x, y in zip(base, own, strict=True)], pa.string()), pa.array(score, pa.float64())],
                names=["k", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return mapped(rows, run, f"k {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").withColumnRenamed("k", key)
