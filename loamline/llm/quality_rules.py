"""Quality rules as a learned decision list, in DataFrame functions only.

Statistics of each text are native expressions. A bounded sample of labelled rows goes to the driver,
where sequential covering grows threshold conjunctions for rejected texts (by information gain on one
part of the sample) and prunes them on the other; the accepted list becomes one ordered CASE WHEN.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, words

#: Labelled rows that the list is fitted on, those of the smallest hashed ids.
SAMPLE = 4000
SYMBOLS = "#*$%&|<>"
FEATURES = ("symbols_per_char", "chars_per_word", "dup_line_share", "repeat_share", "upper_share", "bangs_per_word", "n_words")


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def repeated_words(ws: Column, size: int = 5) -> Column:
    """Words of an array that lie in a window of `size` words found twice or more in it. Windows count as equal if their 64-bit hashes are."""
    n = F.size(ws)

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(at, j + 1) - x, F.lit(size))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def twice(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = let(pairs, lambda p: F.sort_array(F.array_compact(F.transform(p, lambda x, j: F.when((F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"]), x["i"])))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(at, covered))

    hashes = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)]))
    return F.when(n < size, F.lit(0)).otherwise(let(hashes, twice))


def statistics(text: Column) -> Column:
    """Struct of what the rules look at; null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = _without(text, " \t\n\u000b\f\r")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = {
        "word_chars": plain,
        "n_symbols": F.char_length(text) - _without(text, SYMBOLS),
        "n_upper": F.char_length(text) - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_bangs": F.char_length(text) - _without(text, "!"),
        "n_chars": F.char_length(text),
    }
    lined = let(lines, lambda ls: F.struct(F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines")))
    worded = let(words(text), lambda ws: F.struct(F.size(ws).alias("n_words"), repeated_words(ws).alias("n_repeat_words")))
    return F.struct(*[x.cast("long").alias(k) for k, x in parts.items()], lined.alias("lined"), worded.alias("worded"))


def measured(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """`keep` and the statistics as long columns."""
    s = docs.select(*keep, statistics(F.col(text).cast("string")).alias("s"))
    flat = {k: f"s.{k}" for k in ("word_chars", "n_symbols", "n_upper", "n_bangs", "n_chars")} | {k: f"s.lined.{k}" for k in ("n_lines", "n_dup_lines")} | {k: f"s.worded.{k}" for k in ("n_words", "n_repeat_words")}
    return s.select(*[c for c in s.columns if c != "s"], *[F.col(v).cast("long").alias(k) for k, v in flat.items()])


def features() -> dict[str, Column]:
    """Ratios over `measured` columns; 0 where the denominator is 0."""
    c = F.col

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(c(a).cast("double"), c(b).cast("double")), F.lit(0.0))

    return {
        "symbols_per_char": share("n_symbols", "n_chars"), "chars_per_word": share("word_chars", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "upper_share": share("n_upper", "word_chars"), "bangs_per_word": share("n_bangs", "n_words"), "n_words": c("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Rule:
    """All of the conditions (feature, "<=" or ">", threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, row: dict[str, float]) -> bool:
        return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in self.conditions)

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, op, t in self.conditions:
            out = out & (values[f] <= F.lit(t) if op == "<=" else values[f] > F.lit(t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.4g}" for f, op, t in self.conditions)


def learn(rows: list[tuple[dict[str, float], bool]], names: tuple[str, ...] = FEATURES, *, most_conditions: int = 3, least_cover: int = 5, least_precision: float = 0.9, cuts: int = 32) -> list[Rule]:
    """Ordered rules that pick rejected rows (True). Every third row prunes, the others grow. No rows, or rows of one class: no rules."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[Rule] = []

    def counts(rule: Rule, of: list) -> tuple[int, int]:
        hit = [bad for row, bad in of if rule.covers(row)]
        return sum(hit), len(hit) - sum(hit)

    def thresholds(of: list, f: str) -> list[float]:
        v = sorted({row[f] for row, _ in of})
        mids = [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]
        return [mids[i * len(mids) // cuts] for i in range(cuts)] if len(mids) > cuts else mids

    while any(bad for _, bad in grow):
        conditions: tuple = ()
        inside = grow
        while len(conditions) < most_conditions:
            p0 = sum(bad for _, bad in inside)
            if p0 in (0, len(inside)):
                break
            before, best = math.log2(p0 / len(inside)), (1e-9, None, None)
            for f in names:
                for t in thresholds(inside, f):
                    for op in ("<=", ">"):
                        p = n = 0
                        for row, bad in inside:
                            if (row[f] <= t) == (op == "<="):
                                p, n = p + bad, n + (not bad)
                        if p >= least_cover and (gain := p * (math.log2(p / (p + n)) - before)) > best[0]:
                            best = (gain, (f, op, t), None)
            if best[1] is None:
                break
            conditions += (best[1],)
            one = Rule((best[1],))
            inside = [r for r in inside if one.covers(r[0])]
        if not conditions:
            break
        tried = [Rule(conditions[:k]) for k in range(1, len(conditions) + 1)]

        def worth(rule: Rule) -> float:
            p, n = counts(rule, prune)
            return (p - n) / (p + n) if p + n else -1.0

        rule = max(tried, key=lambda r: (worth(r), -len(r.conditions)))
        (p, n), (q, m) = counts(rule, prune), counts(rule, grow)
        if p + q < least_cover or (p + q) < least_precision * (p + n + q + m):
            break
        rules.append(rule)
        grow = [r for r in grow if not rule.covers(r[0])]
        prune = [r for r in prune if not rule.covers(r[0])]
    return rules


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules for label 0. Rows with a null key or label don't count. The sample (at most `sample` rows) is broadcast and collected."""
    picked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("k"), (F.col(label) == 0).alias("bad")).orderBy(F.xxhash64("k"), "k", "bad").limit(sample)
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k")
    rows = measured(own, "t", [F.col("k"), F.col("bad")]).select("k", "bad", *[c.alias(n if n != "n_words" else "words") for n, c in features().items()]).orderBy(F.xxhash64("k"), "k", "bad", *[c for c in FEATURES[:-1]]).limit(sample).collect()
    return learn([({n: r["words" if n == "n_words" else n] for n in FEATURES}, r["bad"]) for r in rows])


def judged(docs: DataFrame, rules: list[Rule], *, text: str = "text", key: str = "doc_id", least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """One row for each row of `docs`, in one pass without shuffle.

    `base_failed`: fewer than `least_words` words, or over `most_repeated` percent of them in repeated
    windows. `kept`: false if base_failed, else whether no rule of the list applies. `rule`: the first
    one that does, from 0. Null or empty text: no words, so base_failed. Other columns are ignored.
    """
    m = measured(docs, text, [F.col(key).alias("_key")])
    base = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    values, first = features(), F.lit(None).cast("int")
    if rules:
        first = F.when(rules[0].column(values), F.lit(0))
        for i, r in enumerate(rules[1:], 1):
            first = first.when(r.column(values), F.lit(i))
    judgement = m.withColumn("base_failed", base).withColumn("rule", first)
    return judgement.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
