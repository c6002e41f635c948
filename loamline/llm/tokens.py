"""Token counts of whole texts, by the whole-token shortcut.

Which strings of the vocabulary the merge rules turn into exactly one token is proved once, on the
driver. Tasks cut texts into pre-tokens; one that is such a string counts as one token without any
merging, and only the rest goes through the merge rules. Counts of recent strings are remembered.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, sent

#: Remembered strings in a Python worker; beyond it the memory starts anew, counts stay right.
REMEMBERED = 400_000
_UNEVEN = re.compile(r"\s | \s")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: its own where it is visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """What is left of the symbols when the best-ranked neighbours have been joined again and again."""
    none = len(ranks)
    while len(symbols) > 1:
        best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: ranks.get(p, none))
        if best not in ranks:
            break
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


@functools.lru_cache(2)
def rules(path: str) -> tuple[dict[tuple[str, str], int], tuple[str, ...], dict]:
    """Merge ranks, the special strings, and the vocabulary of a byte-level file."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pairs = (tuple(m if isinstance(m, list) else m.split(" ")) for m in d["model"]["merges"])
    return {p: i for i, p in enumerate(pairs)}, tuple(t["content"] for t in d["added_tokens"]), d["model"]["vocab"]


@functools.lru_cache(2)
def proved_whole(path: str) -> frozenset[str]:
    """The vocabulary strings that encode alone as one token. Bounded by the vocabulary."""
    ranks, special, vocab = rules(path)
    return frozenset(s for s in vocab if s not in special and len(merged(list(s), ranks)) == 1)


class Counts(dict):
    """Tokens of a string that starts and ends where pre-tokens do; unknown ones are worked out on demand."""

    def __init__(self, path: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        _, special, _ = rules(path)
        tokenizer = Tokenizer.from_file(path)
        self.symbols = byte_symbols()
        self.whole, self.cut, self.merge = whole, tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def piece(self, symbols: str) -> int:
        return 1 if symbols in self.whole else len(self.merge(symbols))

    def plain(self, text: str) -> int:
        word = text[1:] if text[:1] == " " else text
        letters = word.rstrip(".,!?;:")
        if letters.isalpha() and max(letters) < "\u0250":  # one pre-token of letters, and one of the marks after it
            lead = "\u0120" if len(word) < len(text) else ""
            n = self.piece(lead + (letters if letters.isascii() else "".join(map(self.symbols.__getitem__, letters.encode()))))
            return n + (self.piece(word[len(letters) :]) if len(letters) < len(word) else 0)
        return sum(self.piece(symbols) for symbols, _ in self.cut(text)) if text else 0

    def __missing__(self, text: str) -> int:
        if self.special is not None and (found := self.special.findall(text)):
            n = len(found) + sum(map(self.plain, self.special.split(text)))
        else:
            n = self.plain(text)
        if len(text) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = n
        return n

    def of(self, text: str) -> int:
        """Every single space between two visible characters starts a new pre-token, so texts fall apart there; texts with other runs of white space are cut as a whole."""
        if _UNEVEN.search(text) or text.startswith(" ") or text.endswith(" "):
            return sum(map(self.__getitem__, self.lines(text)))
        first, *rest = text.split(" ")
        return self[first] + sum(map(self.__getitem__, [" " + x for x in rest])) if text else 0

    @staticmethod
    def lines(text: str) -> list[str]:
        """Parts of a text that begin with one space after and before a visible character."""
        return re.split(r"(?<=\S)(?= \S)", text)


_workers: dict[str, Counts] = {}


def counts_here(path: str, whole: frozenset[str]) -> Counts:
    """The counts of this Python worker, kept between its tasks."""
    if path not in _workers:
        _workers[path] = Counts(path, whole)
    return _workers[path]


def token_counts(docs: DataFrame, path: str, *, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """One row for each row of `docs`: its key, `n_bytes` (UTF-8), `n_tokens`, `over_limit` (more than `limit` tokens).

    Null or empty text: 0 bytes, 0 tokens. Repeated rows stay repeated; a null key stays null; other
    columns are ignored. No shuffle: the vocabulary (bounded by its file) is sent once, texts are read once.
    """
    whole = sent(docs.sparkSession, proved_whole(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_here(path, whole.value)
        for b in batches:
            texts = b.column(1)
            n_bytes = [0] * len(texts)
            n_tokens = [0] * len(texts)
            for i, t in enumerate(texts):
                if (t := t.as_py()) is not None:
                    n_bytes[i] = len(t.encode())
                    n_tokens[i] = counts.of(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=["k", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return mapped(rows, run, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("k", key)
