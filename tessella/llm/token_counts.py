"""Token counts by a map-side lookup of two tiers.

A text is the sequence of its pre-tokens, each a word with the white space
before it; no piece of the vocabulary reaches from one into the next, so the
counts add up.  Misra-Gries summaries of every task's pre-tokens are summed to
the most frequent ones, whose lengths are broadcast as one compact table: joined
bytes and one number each, TABLE entries at most.  All others are encoded by
the library and remembered in a bounded worker cache.  Pre-tokens are never
shuffled; only the summaries are, a fixed number of entries for each task.

The counts don't depend on what the table holds.  Null and empty texts have no
tokens; very long ones are counted whole.  Repeated rows count alike; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import column, id_and_text, slices, strings

#: Entries of the broadcast table, of a task's summary, and of a worker's cache.
TABLE, SUMMARY, MOST_WORDS = 20_000, 8_000, 400_000

#: The piece sign in a text is white space to the library; such texts, and runs of spaces, go to it as they are.
SIGN = "▁"
RUN = re.compile("  | \\Z|\\A |" + SIGN + "|\\x00")

ENTRIES = pa.schema([("word", pa.string()), ("n", pa.int64())])
COUNTS = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def pre_tokens(text: str) -> list[str] | None:
    """Words between single spaces, or None if the text has to be encoded as it is."""
    return None if RUN.search(text) else text.split(" ") if text else []


def summary(counts: Counter, words: list[str], most: int) -> None:
    """Add words to a Misra-Gries summary; many at once, it is cut back to ``most`` entries by the next largest count."""
    counts.update(words)
    if len(counts) > 8 * most:
        bound = sorted(counts.values(), reverse=True)[most]
        for w in [w for w, n in counts.items() if n <= bound]:
            del counts[w]
        counts.subtract(dict.fromkeys(counts, bound))


def _summaries(batches):
    counts: Counter = Counter()
    for part in slices(batches):
        for text in strings(part, "text"):
            summary(counts, pre_tokens(text) or [], SUMMARY)
    if counts:
        top = counts.most_common(SUMMARY)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], schema=ENTRIES)


_OPEN: dict = {}


def _library(path: str):
    if path not in _OPEN:
        import sentencepiece

        _OPEN[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _OPEN[path]


class LengthTable:
    """Frequent pre-tokens and their lengths: one string of bytes and an array."""

    def __init__(self, words: list[str], lengths: list[int]):
        self.joined, self.lengths = " ".join(words).encode(), np.array(lengths, dtype=np.uint16)
        self._open: dict[str, int] | None = None

    def opened(self) -> dict[str, int]:
        if self._open is None:
            words = self.joined.decode().split(" ") if len(self.lengths) else []
            self._open = dict(zip(words, self.lengths.tolist()))
        return self._open

    def __getstate__(self):
        return {"joined": self.joined, "lengths": self.lengths, "_open": None}


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text", most: int = TABLE) -> LengthTable:
    """The table of the most frequent pre-tokens of all texts."""
    entries = id_and_text(docs.withColumn("__id", F.lit(0)), "__id", text_col).mapInArrow(_summaries, "word string, n long")
    top = entries.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).toArrow()["word"].to_pylist()
    top = [w for w in top if " " not in w]
    lengths = [len(x) for x in _library(path).encode(top, num_threads=1)] if top else []
    return LengthTable(*zip(*[(w, n) for w, n in zip(top, lengths) if n < 2**16])) if top else LengthTable([], [])


_REST: dict = {}


def _counted(path: str, sent):
    def run(batches):
        frequent, rest = sent.value.opened(), _REST.setdefault(path, {})
        library = _library(path)
        for part in slices(batches):
            texts = strings(part, "text")
            out: list = [0] * len(texts)
            waiting, new = [], []
            for i, text in enumerate(texts):
                words = pre_tokens(text)
                if words is None:
                    out[i] = len(library.encode(text))
                    continue
                found = list(map(frequent.get, words))
                misses = [w for w, n in zip(words, found) if n is None]
                out[i] = sum(n for n in found if n is not None) if misses else sum(found)
                if misses:
                    waiting.append((i, misses))
                    new += [w for w in misses if w not in rest]
            if new:
                fresh = list(dict.fromkeys(new))
                if len(rest) + len(fresh) > MOST_WORDS:
                    rest.clear()
                    fresh = list({w for _, words in waiting for w in words})
                rest.update(zip(fresh, map(len, library.encode(fresh, num_threads=1))))
            for i, misses in waiting:
                out[i] += sum(map(rest.__getitem__, misses))
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(sizes, pa.int64()), pa.array(out, pa.int64())], schema=COUNTS)

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_tokens, over_limit."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text_col))
    out = id_and_text(docs, id_col, text_col).mapInArrow(_counted(path, sent), "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
