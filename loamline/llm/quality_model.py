"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is a log-odds from a model fitted on a bounded sample of labelled rows:
logistic regression over style ratios for quality, word likelihood ratios for toxic texts. Over all
labelled rows, hosts (sources) and paths under them (source and language) have beta posteriors: a
path shrinks toward its host and a host toward the global prior, by strengths estimated from the
spread of the groups' rates. The two are combined as log-odds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .shared import cut, mapped, sent, with_text

#: Labelled rows that the document model is fitted on, those of the smallest hashed ids.
SAMPLE = 6000
#: Groups up to this number go to every executor; more are joined by shuffle.
BROADCAST_GROUPS = 100_000
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
STYLE = ("symbols", "upper", "bangs", "repeats", "word_length", "log_words")


def style(part: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A row of STYLE ratios for each text; `part` with its upper case as written, words by white space."""
    n_chars, n_words = np.maximum(np.diff(at), 1), np.maximum(np.diff(rows), 1)

    def per_row(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[cuts])

    upper = (part >= 65) & (part <= 90)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    same[rows[:-1][rows[:-1] < len(h)]] = False
    length = per_row(np.diff(np.concatenate([[0], np.cumsum(ends - starts)])), rows)
    return np.stack([per_row(_SYMBOLS[part], at) / n_chars, per_row(upper, at) / n_chars, per_row(part == 33, at) / n_words, per_row(same, rows) / n_words, np.minimum(length / n_words, 40) / 10, np.log1p(np.diff(rows)) / 5], axis=1)


def evidence(texts: pa.Array, lexicon: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """STYLE of every text, and the sum of the lexicon's log ratios over its distinct words there."""
    data, offsets = bw.utf8(texts)
    styles, sums = [np.zeros((0, len(STYLE)))], [np.zeros(0)]
    for a, b in bw.blocks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, rows = bw.spans(part, at, bw.SOLID)
        styles.append(style(part, at, starts, ends, rows, bw.hashes(part, starts, ends)))
        out = np.zeros(b - a)
        if len(lexicon):
            low = bw.LOWER[part]
            starts, ends, rows = bw.spans(low, at, bw.ALNUM)
            h = bw.hashes(low, starts, ends)
            i = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
            hit = np.flatnonzero(lexicon[i] == h)
            once = np.unique((np.searchsorted(rows, hit, "right") - 1) * len(lexicon) + i[hit])
            np.add.at(out, once // len(lexicon), ratios[once % len(lexicon)])
        sums.append(out)
    return np.concatenate(styles), np.concatenate(sums)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the intercept last; ridge on all but that."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge / 100)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-6), x.T @ (y - p) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    weights: np.ndarray  # for standardised style, the intercept last: log-odds of good quality
    mean: np.ndarray
    scale: np.ndarray
    lexicon: np.ndarray  # word hashes, sorted
    ratios: np.ndarray
    toxic_prior: float  # log-odds

    def scores(self, texts: pa.Array) -> dict[str, pa.Array]:
        styles, toxic = evidence(texts, self.lexicon, self.ratios)
        good = np.clip((styles - self.mean) / self.scale, -10, 10) @ self.weights[:-1] + self.weights[-1]
        return {"good": pa.array(good, pa.float64()), "toxic": pa.array(toxic, pa.float64())}


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, lexicon_words: int = 200, least_texts: int = 8, least_ratio: float = 4.0) -> Model:
    """The document model from at most `sample` labelled rows; copies (equal whole texts with equal labels) count once. Labels that are missing or all of one class teach nothing: log-odds of the class itself.

    The toxic lexicon holds at most `lexicon_words` words, each of at least `least_texts` toxic texts and a
    log likelihood ratio of at least `least_ratio`.
    """
    picked = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col("quality").alias("q"), F.col("toxic").alias("x")).orderBy(F.xxhash64("k"), "k", "q", "x").limit(sample)
    own = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(picked), "k")
    own = cut(own.groupBy(F.sha2("t", 256).alias("h"), F.col("q").alias("hq"), F.col("x").alias("hx")).agg(F.min_by(F.struct("k", "t", "q", "x"), F.struct("k", F.xxhash64("t"))).alias("r")).select("r.*"))
    # words: likelihood ratios for toxic texts
    n = {r["x"]: r["count"] for r in own.groupBy("x").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    lexicon, ratios = np.zeros(0, np.uint64), np.zeros(0)
    if n1 and n0:
        words = own.where("x is not null").select("x", F.explode(F.array_distinct(F.regexp_extract_all(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")))).alias("w"))
        c1, c0 = F.count(F.when(F.col("x") == 1, 1)), F.count(F.when(F.col("x") == 0, 1))
        ratio = F.log((c1 + 0.1) / (n1 + 0.2)) - F.log((c0 + 0.1) / (n0 + 0.2))
        best = words.groupBy("w").agg(ratio.alias("r"), c1.alias("c1")).where((F.col("c1") >= least_texts) & (F.col("r") >= least_ratio)).orderBy(F.desc("c1"), "w").limit(lexicon_words).collect()
        if best:
            h = bw.hash_of([r["w"].encode() for r in best])
            order = np.argsort(h)
            lexicon, ratios = h[order], np.array([r["r"] for r in best])[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            styles, _ = evidence(b.column(0), np.zeros(0, np.uint64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(map(list, styles)), pa.list_(pa.float64())), b.column(1), b.column(2)], names=["s", "q", "k"])

    seen = own.where("q is not null").select(F.coalesce("t", F.lit("")), F.col("q").cast("int"), F.col("k").cast("string"))
    rows = sorted((r["k"], r["q"], tuple(r["s"])) for r in mapped(seen, run, "s array<double>, q int, k string").collect())
    s, y = np.array([r[2] for r in rows]).reshape(-1, len(STYLE)), np.array([float(r[1] != 0) for r in rows])
    mean, scale = (s.mean(0), s.std(0) + 1e-3) if len(s) else (np.zeros(len(STYLE)), np.ones(len(STYLE)))
    if len(s) and 0 < y.sum() < len(y):
        weights = logistic(np.clip((s - mean) / scale, -10, 10), y)
    else:
        weights = np.append(np.zeros(len(STYLE)), logit((y.sum() + 1) / (len(y) + 1)))
    return Model(weights, mean, scale, lexicon, ratios, logit((n1 + 0.5) / (n1 + n0 + 1)))


def strength(n: Column, k: Column, prior: float) -> list[Column]:
    """Aggregates from which `shrinkage` estimates how alike groups are."""
    rate = k / n
    return [F.sum(n).alias("n"), F.sum(n * (rate - prior) * (rate - prior)).alias("spread"), F.count(n).alias("groups"), F.sum(n.cast("double") * n).alias("squares")]


def shrinkage(r, prior: float) -> float:
    """Pseudo-rows with which a group starts, by moments: many if the groups' rates differ no more than chance explains."""
    if not r["n"] or r["groups"] < 2:
        return 1000.0
    noise = prior * (1 - prior)
    between = (r["spread"] - noise * (r["groups"] - 1)) / max(r["n"] - r["squares"] / r["n"], 1.0)
    return float(min(max(noise / between - 1, 2.0), 1000.0)) if between > 0 else 1000.0


def levels(labelled: DataFrame, label: str) -> tuple[float, DataFrame, DataFrame]:
    """From rows (host, path, label 0/1): the global rate, for each host and for each (host, path) its shrunk rate as column `label`."""
    own = labelled.where(F.col(label).isNotNull())
    paths = cut(own.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(label) != 0).cast("long")).alias("k")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    prior = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    a = shrinkage(hosts.agg(*strength(F.col("hn"), F.col("hk"), prior)).first(), prior)
    b = shrinkage(paths.agg(*strength(F.col("n"), F.col("k"), prior)).first(), prior)
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("hk") + a * prior) / (F.col("hn") + a)).alias("hp"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    return prior, hosts.select(F.col("h").alias("host"), F.col("hp").alias(label)), joined.select("host", "path", ((F.col("k") + b * F.col("hp")) / (F.col("n") + b)).alias(label))


def posteriors(labelled: DataFrame, label: str) -> tuple[float, DataFrame]:
    """The global rate and the rates of (host, path); see levels."""
    prior, _, paths = levels(labelled, label)
    return prior, paths


def log_odds(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def scored(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", host: str = "source", path: str = "lang", **fitting: Any) -> DataFrame:
    """All rows and columns of `docs` as struct `row`, with p_good, p_toxic and kept (p_good >= 0.5 and p_toxic < 0.5).

    The model is fitted on `labelled_docs` (columns key, text, host, path) and `labels` (key, quality,
    toxic); `fitting` are options of `fit`. Null and empty texts have the style of no words; a host or path without labels has the prior
    of the level above; null hosts are a host. Group tables are aggregated before the shuffle, so a host
    with most rows is no single task's; the texts themselves are not shuffled while the groups are few.
    """
    model = fit(labelled_docs, labels, text=text, key=key, **fitting)
    model_b = sent(docs.sparkSession, model)
    known = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), "quality", "toxic")
    seen = labelled_docs.select(F.col(key).alias("k"), F.col(host).alias("host"), F.col(path).alias("path")).join(known, "k")
    good, hosts_good, by_good = levels(seen, "quality")
    toxic, hosts_toxic, by_toxic = levels(seen, "toxic")
    terms = ((log_odds(F.col("quality")) - logit(good)), (log_odds(F.col("toxic")) - logit(toxic)))
    groups = cut(by_good.alias("g").join(by_toxic.alias("t"), F.expr("g.host <=> t.host and g.path <=> t.path"), "full").select(F.coalesce("g.host", "t.host").alias("host"), F.coalesce("g.path", "t.path").alias("path"), terms[0].alias("g"), terms[1].alias("t")))
    hosts = cut(hosts_good.alias("g").join(hosts_toxic.alias("t"), F.expr("g.host <=> t.host"), "full").select(F.coalesce("g.host", "t.host").alias("above"), terms[0].alias("hg"), terms[1].alias("ht")))
    small = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    few = hosts.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    own = with_text(docs, text, lambda texts: model_b.value.scores(texts), "good double, toxic double").select("row", "good", "toxic")
    on = F.col("host").eqNullSafe(F.col(f"row.`{host}`")) & F.col("path").eqNullSafe(F.col(f"row.`{path}`"))
    met = own.join(F.broadcast(groups) if small else groups, on, "left").join(F.broadcast(hosts) if few else hosts, F.col("above").eqNullSafe(F.col(f"row.`{host}`")), "left")
    p = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    out = met.select("row", p(F.col("good") + F.coalesce("g", "hg", F.lit(0.0))).alias("p_good"), p(F.col("toxic") + model.toxic_prior + F.coalesce("t", "ht", F.lit(0.0))).alias("p_toxic"))
    return out.withColumn("kept", (F.col("p_good") >= 0.5) & (F.col("p_toxic") < 0.5))


def judged(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, p_good, p_toxic, kept), one row for each row of `docs`; see scored."""
    slim = docs.select(key, "text", "source", "lang")
    return scored(slim, slim, labels, key=key).select(F.col(f"row.`{key}`").alias(key), "p_good", "p_toxic", "kept")
