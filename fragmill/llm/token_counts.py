"""Token counts by a map-side two-tier look-up; no text is shuffled, and of its pre-tokens only bounded counts.

Tier one is a compact table of the frequent pre-tokens' lengths in tokens, broadcast to all workers.  Its size is
bounded (`TABLE` entries of at most `LONGEST` letters).  The entries are those that the whole corpus has most often: each
task counts its own within a bound and names at most `NAMED` of them, whose counts are summed.  The table only saves
work, a pre-token that it lacks is encoded: tier two encodes misses, in one call for each block of texts, into a cache
that a worker keeps within a bound.  Texts of any script take both tiers; special strings are cut out first, as the
library does.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretoken import word_cut
from .shared import in_blocks, in_use, per_text, text_or_empty, trimming

WORD_VOCABULARY = "word_bpe_49k.json"
#: Entries of the broadcast table, their longest, those that a task names, and what a worker's cache may hold.
TABLE, LONGEST, NAMED, REMEMBERED = 60_000, 40, 4_000, 300_000

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker's share of the machine is one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _ENCODERS[path] = t
    return _ENCODERS[path]


class Lengths(dict):
    """Pre-token -> tokens; a missing one counts as unknown until `learn`."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.path, self.frequent = path, frequent
        self.cut = Cutter(path)

    def learn(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self)
        if len(self) + len(new) > len(self.frequent) + REMEMBERED:
            self.clear()
            self.update(self.frequent)
            new = sorted(w for w in words if w not in self)
        self.update(zip(new, map(len, encoder(self.path).encode_batch_fast(new, add_special_tokens=False))))

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.cut(t) for t in texts]
        self.learn(set().union(*(w for w, _ in cut)))
        return [sum(map(self.__getitem__, words)) + special for words, special in cut]


class Cutter:
    """The pre-tokens of a text, and the number of special strings in it."""

    def __init__(self, path: str):
        special = sorted((t.content for t in encoder(path).get_added_tokens_decoder().values()), key=len, reverse=True)
        self.apart = re.compile("|".join(map(re.escape, special)))

    def __call__(self, text: str) -> tuple[list[str], int]:
        parts = self.apart.split(text)
        return (word_cut(text), 0) if len(parts) == 1 else (list(chain.from_iterable(map(word_cut, parts))), len(parts) - 1)


def frequent_lengths(docs: DataFrame, path: str, table: int = TABLE) -> dict[str, int]:
    """The bounded table: the pre-tokens with the greatest sums of the tasks' counts; at most `table` come to the driver."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, cut = Counter(), Cutter(path)
        for b in batches:
            texts = b.column(0).to_pylist()
            for s in in_blocks(texts):
                seen.update(chain.from_iterable(cut(t)[0] for t in texts[s]))
                if len(seen) > 50 * NAMED:  # what a task has seen but rarely is forgotten
                    seen = Counter(dict(seen.most_common(25 * NAMED)))
        most = [(w, n) for w, n in seen.most_common(2 * NAMED) if len(w) <= LONGEST][:NAMED]
        if most:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in most], pa.string()), pa.array([n for _, n in most], pa.int64())], names=["word", "n"])

    counts = docs.select(text_or_empty(docs)).mapInArrow(trimming(named), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = sorted(r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(table).collect())
    return dict(zip(words, map(len, encoder(path).encode_batch_fast(words, add_special_tokens=False))))


_LENGTHS: dict[str, Lengths] = {}


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of each text.

    Null text counts as empty: 0 bytes, 0 tokens.  Every row gives a row, repeated ones too; a null id stays null; texts
    of any length are counted whole; an empty table gives an empty one; other columns are not read.
    """
    path = vocabulary or public_tokenizers.path(WORD_VOCABULARY)
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, frequent_lengths(docs, path)))

    def run(texts: list[str]) -> dict[str, list]:
        key, frequent = sent.value
        in_use(_LENGTHS)
        if key not in _LENGTHS:
            _LENGTHS.clear()
            _LENGTHS[key] = Lengths(path, frequent)
        n = _LENGTHS[key].count(texts)
        return {"n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return per_text(docs, run, "n_bytes long, n_tokens long, over_limit boolean")
