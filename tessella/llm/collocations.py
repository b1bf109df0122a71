"""Phrases that occur more often than their parts suggest, counted by a multikey quicksort of suffix pointers.

Words are counted first, by language.  A phrase that is frequent enough has
frequent words only, so the others end a suffix as a piece's end does; what
stands at a place is a window of up to ``longest`` words.  Tasks gather windows,
add up equal ones and send them in blocks to the share that their leading words
name.  A share partitions its pointers into windows by the words at one depth,
three ways: below, at and above a pivot.  Those at the pivot have one more word
in common, and the number of windows behind them is that phrase's count; a
partition with fewer windows than the least count is abandoned.

A window goes by its first word.  Where a sample of texts shows that a word
leads more windows than a share should hold, by its first two, and so on; the
count of such a hot leading phrase, whose windows are in several shares, is
sent to one share as a window of its own, added up in each task.  Equal windows
are one row of a block, so repeated passages weigh nothing.  The sample only
places windows and never changes a count.

While frequent words are MOST_WORDS at most, they are numbered by frequency and
sent to all tasks.  Beyond, windows run over all words as hashes of 64 bits, by
a seed for which no other word has the hash of a frequent one.

Null and empty texts have no words; a null language is ``und``; very long texts
are read whole; repeated rows count as often as they occur; ties are settled by
the phrase's bytes; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import column, if_small, kept, slices, strings, written

#: Frequent words that are sent to all tasks at most.
MOST_WORDS = 1_000_000
#: Windows of a share, about, before equal ones are added up; more where that makes over 2^20 shares.
SHARE = 1 << 20
#: Words of the sample that places windows, about.
SAMPLE_WORDS = 4_000_000
#: Windows, and different words, that a task gathers before it sends them on.
FLUSH_WINDOWS, FLUSH_WORDS = 500_000, 300_000

#: Text bytes that end a piece become one that no UTF-8 has, and tabs spaces.
_BREAK = b"\xff"
_SIGNS = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words (A-Z only) with a mark at each end of a piece."""
    return text.lower().translate(_SIGNS).replace(_BREAK, b" \xff ").split()


def _texts(batch: pa.RecordBatch):
    """Languages and texts, as bytes."""
    return zip(strings(batch, "lang"), batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist())


WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _counted(batches):
    """Words of each language, added up in the task; the number of all of them under a null word."""
    kept("collocations")
    counts: dict[str, Counter] = {}

    def flushed():
        for lang, found in counts.items():
            found.pop(_BREAK, None)
            total = sum(found.values())
            words = [w.decode() for w in found]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(words) + 1)), pa.array([*words, None], pa.string()), pa.array([*found.values(), total], pa.int64())], schema=WORDS)
        counts.clear()

    for part in slices(batches):
        for lang, text in _texts(part):
            counts.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, counts.values())) > FLUSH_WORDS:
            yield from flushed()
    yield from flushed()


def word_hash(lang: str, word: bytes, seed: int) -> int:
    """Never 0, which ends a window."""
    return xxhash.xxh64_intdigest(lang.encode() + b"\xff" + word, seed) or 1


class Speller:
    """Words to numbers over 0: frequent ones as they were numbered beforehand and others 0, or all of them by a hash."""

    def __init__(self, frequent: dict[str, dict[bytes, int]] | None, seed: int):
        self.frequent, self.seed = frequent, seed

    def numbers(self, lang: str, words: list[bytes]) -> np.ndarray:
        if self.frequent is not None:
            get = self.frequent.get(lang, {}).get
            return np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        known = {w: word_hash(lang, w, self.seed) for w in set(words)}
        known[_BREAK] = 0
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(h: np.ndarray, longest: int) -> np.ndarray:
    """A row for each place with two words at least: the words from there on, 0 behind the end."""
    padded = np.concatenate((h, np.zeros(longest, dtype=np.uint64)))
    start = np.flatnonzero((h != 0) & (padded[1 : len(h) + 1] != 0))
    out = np.zeros((len(start), longest), dtype=np.uint64)
    alive = np.ones(len(start), dtype=bool)
    for d in range(longest):
        out[:, d] = np.where(alive, padded[start + d], 0)
        alive &= out[:, d] != 0
    return out


def leads(w: np.ndarray) -> np.ndarray:
    """Of each window and depth: a hash of the words up to there."""
    out = np.zeros_like(w)
    state = np.zeros(len(w), dtype=np.uint64)
    for d in range(w.shape[1]):
        state = (state ^ w[:, d]) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(29)
        state *= np.uint64(0xBF58476D1CE4E5B9)
        state ^= state >> np.uint64(32)
        out[:, d] = state
    return out


def added_up(w: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows once, in order, with their weights' sum."""
    if not len(w):
        return w, weight
    order = np.lexsort(w.T[::-1])
    w, weight = w[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]).any(axis=1))))
    return w[first], np.add.reduceat(weight, first)


def _planes(a: np.ndarray) -> bytes:
    """Numbers with their equal bytes side by side, which compress far better so."""
    return np.moveaxis(a.view(np.uint8).reshape(*a.shape, a.itemsize), -1, -2).tobytes()


def _numbers(raw: bytes, kind: str, *shape: int) -> np.ndarray:
    item = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(*shape[:-1], item, shape[-1])
    return np.ascontiguousarray(np.moveaxis(planes, -2, -1)).view(kind).reshape(shape)


def pack(w: np.ndarray, weight: np.ndarray, chain: np.ndarray) -> bytes:
    """Windows of one share, compressed: different words as steps from one to the next, then each window's places among them, weights and depths."""
    words, at = np.unique(w, return_inverse=True)
    kind = "<u2" if len(words) <= 1 << 16 else "<u4"
    at = np.ascontiguousarray(at.reshape(w.shape).T.astype(kind))
    head = np.array([len(words), len(w), w.shape[1], at.itemsize], dtype="<u4")
    rest = _planes(np.diff(words, prepend=np.uint64(0)).astype("<u8")) + _planes(at) + _planes(weight.astype("<u4")) + chain.astype(np.uint8).tobytes()
    return head.tobytes() + pa.compress(rest, "zstd", asbytes=True)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n_words, n, longest, item = np.frombuffer(raw, dtype="<u4", count=4).tolist()
    ends = np.cumsum([8 * n_words, n * longest * item, 4 * n, n]).tolist()
    rest = pa.decompress(raw[16:], ends[-1], "zstd", asbytes=True)
    words, at, weight, chain = (rest[a:z] for a, z in zip([0, *ends], ends))
    return np.cumsum(_numbers(words, "<u8", n_words), dtype=np.uint64), _numbers(at, f"<u{item}", longest, n), _numbers(weight, "<u4", n), np.frombuffer(chain, dtype=np.uint8)


BLOCKS = pa.schema([("share", pa.int32()), ("block", pa.binary())])


def routed(w: np.ndarray, weight: np.ndarray, hot: list[np.ndarray], shares: int):
    """Shares and blocks of windows: by the words up to the first that no hot phrase leads with."""
    w, weight = added_up(w, weight)
    by = leads(w)
    chain = np.zeros(len(w), dtype=np.int64)  # how many leading words are hot
    more: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    alive = np.ones(len(w), dtype=bool)
    for d, known in enumerate(hot):
        alive &= np.isin(by[:, d], known) & (w[:, d] != 0)
        if not alive.any():
            break
        chain[alive] = d + 1
        if d:  # a hot phrase's count goes to one share
            heads = w[alive].copy()
            heads[:, d + 1 :] = 0
            heads, sums = added_up(heads, weight[alive])
            more.append((heads, sums, np.full(len(heads), d), leads(heads)[:, d]))
    chain = np.minimum(chain, w.shape[1] - 1)
    key = by[np.arange(len(w)), chain]
    w, weight, chain, key = (np.concatenate(x) for x in zip((w, weight, chain, key), *more))
    share = (key % np.uint64(shares)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    edges = np.flatnonzero(np.diff(share[order], prepend=-1, append=-1))
    for a, z in zip(edges, edges[1:]):
        mine = order[a:z]
        yield int(share[mine[0]]), pack(w[mine], weight[mine], chain[mine])


def multikey_quicksort(columns: list[np.ndarray], weight: np.ndarray, least: int, from_depth: int = 0):
    """Words and weights of all phrases of two words and more that weigh enough; depths up to ``from_depth`` aren't told.

    Pointers are partitioned three ways at one depth after another.  The end of
    a window (0) is no word.
    """
    waiting = [(np.arange(len(weight)), 0, ())]
    while waiting:
        pointers, depth, phrase = waiting.pop()
        values = columns[depth][pointers]
        some = np.sort(values[[0, len(values) // 2, -1]])
        pivot = some[1]
        below, above = values < pivot, values > pivot
        for side in (below, above):
            part = pointers[side]
            if len(part) and weight[part].sum() >= least:
                waiting.append((part, depth, phrase))
        if not pivot:
            continue
        part = pointers[~(below | above)]
        total = int(weight[part].sum())
        if total < least:
            continue
        longer = (*phrase, int(pivot))
        if depth >= max(1, from_depth):
            yield longer, total
        if depth + 1 < len(columns):
            waiting.append((part, depth + 1, longer))


PHRASES = pa.schema([("words", pa.list_(pa.int64())), ("n", pa.int64())])


def _sorted_share(least: int):
    def run(table: pa.Table) -> pa.Table:
        kept("collocations")
        blocks = [unpack(b) for b in table["block"].to_pylist()]
        words = np.unique(np.concatenate([b[0] for b in blocks]))
        if words[0]:
            words = np.concatenate((np.zeros(1, dtype=np.uint64), words))  # place 0 is the end
        places = np.concatenate([np.searchsorted(words, b[0])[b[1]].astype(np.int32) for b in blocks], axis=1)
        weight = np.concatenate([b[2] for b in blocks]).astype(np.int64)
        chain = np.concatenate([b[3] for b in blocks])
        spelt = words.view(np.int64).tolist()
        found, sums = [], []
        for depth in np.unique(chain):
            mine = np.flatnonzero(chain == depth)
            for phrase, n in multikey_quicksort([c[mine] for c in places], weight[mine], least, int(depth)):
                found.append([spelt[k] for k in phrase])
                sums.append(n)
        return pa.table([pa.array(found, pa.list_(pa.int64())), pa.array(sums, pa.int64())], schema=PHRASES)

    return run


def _blocks(speller, hot, shares: int, longest: int):
    """``speller``, ``hot``: broadcast variables."""

    def run(batches):
        kept("collocations")
        spell, held, n = speller.value, [], 0

        def flushed():
            w = np.concatenate(held)
            held.clear()
            rows = list(routed(w, np.ones(len(w), dtype=np.int64), hot.value, shares))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), BLOCKS)], schema=BLOCKS)

        for part in slices(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in _texts(part):
                by_lang.setdefault(lang, []).extend([*words_of(text), _BREAK])
            for lang, words in by_lang.items():
                held.append(windows(spell.numbers(lang, words), longest))
                n += len(held[-1])
            if n >= FLUSH_WINDOWS:
                yield from flushed()
                n = 0
        if held:
            yield from flushed()

    return run


LEADS = pa.schema([("depth", pa.int32()), ("lead", pa.int64()), ("n", pa.int64())])


def _sampled_leads(speller, longest: int):
    """Leading phrases of a sample and how often each leads a window, added up by slices."""

    def run(batches):
        kept("collocations")
        for part in slices(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in _texts(part):
                by_lang.setdefault(lang, []).extend([*words_of(text), _BREAK])
            for lang, words in by_lang.items():
                w, weight = added_up(*(lambda x: (x, np.ones(len(x), dtype=np.int64)))(windows(speller.value.numbers(lang, words), longest)))
                by = leads(w)
                for d in range(longest - 1):
                    lead, at = np.unique(by[w[:, d] != 0, d], return_inverse=True)
                    n = np.bincount(at, weights=weight[w[:, d] != 0], minlength=len(lead)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lead), d, dtype=np.int32)), pa.array(lead.view(np.int64)), pa.array(n)], schema=LEADS)

    return run


def _speller(docs: DataFrame, words: DataFrame, least: int) -> Speller:
    """Frequent words numbered by frequency if they are few; else a seed for which no other word has a frequent one's hash."""
    frequent = words.filter(F.col("word").isNotNull())
    if frequent.count() <= MOST_WORDS:
        known: dict[str, dict[bytes, int]] = {}
        for k, r in enumerate(frequent.sort(F.desc("n"), "lang", "word").select("lang", "word").toLocalIterator()):
            known.setdefault(r.lang, {})[r.word.encode()] = k + 1
        return Speller(known, 0)
    for seed in range(100):
        spelt = _word_counts(docs).filter(F.col("word").isNotNull()).withColumn("h", F.pandas_udf(_hashed(seed), "long")("lang", "word"))
        if not spelt.groupBy("h").agg(F.count("*").alias("k"), F.max("n").alias("most")).filter((F.col("k") > 1) & (F.col("most") >= least)).head(1):
            return Speller(None, seed)
    raise RuntimeError("no seed tells all words apart")


def _hashed(seed: int):
    def run(lang: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series(np.array([word_hash(a, b.encode(), seed) for a, b in zip(lang, word)], dtype=np.uint64).view(np.int64))

    return run


def _spelt(speller):
    """The numbers of the table of frequent words; ``speller``: a broadcast variable."""

    def run(lang: pd.Series, word: pd.Series) -> pd.Series:
        of = speller.value
        return pd.Series([int(of.numbers(a, [b.encode()]).view(np.int64)[0]) if b is not None else None for a, b in zip(lang, word)], dtype="Int64")

    return run


def _word_counts(docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Counts of words, and of phrases of two words to ``longest`` that occur ``least`` times or more.

    The first: lang, h (the word's number), word, n, with a null word for the
    number of all words of a language.  The second: words (array of numbers), n.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = written(_word_counts(docs).filter((F.col("n") >= least) | F.col("word").isNull()), "words")
    total = words.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0
    size = max(SHARE, total >> 20)
    speller = spark.sparkContext.broadcast(_speller(docs, words, least))
    share_of = min(1.0, SAMPLE_WORDS / max(1, total))
    some = docs.sample(share_of, seed=1) if share_of < 1 else docs
    seen = some.mapInArrow(_sampled_leads(speller, longest), "depth int, lead long, n long").groupBy("depth", "lead").agg(F.sum("n").alias("n"))
    # at most total / size leads of a depth are hot, 2^20 at any size
    hot_rows = seen.filter(F.col("n") > max(1.0, size * share_of)).select("depth", "lead").collect() if total > size else []
    hot = [np.array([r.lead for r in hot_rows if r.depth == d], dtype=np.int64).view(np.uint64) for d in range(longest - 1)]
    shares = max(12, -(-2 * total // size))
    blocks = docs.mapInArrow(_blocks(speller, spark.sparkContext.broadcast(hot), shares, longest), "share int, block binary")
    found = blocks.groupBy("share").applyInArrow(_sorted_share(least), "words array<long>, n long")
    words = words.withColumn("h", F.pandas_udf(_spelt(speller), "long")("lang", "word"))
    return words, written(found, "phrases")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase is as good as its worst cut: floor(1000 a n / (l r)) of its count
    a, the counts l and r of the cut's two sides and the number n of the
    language's words, in exact numbers.  Phrases inside a longer one that
    occurs ``percent`` hundredths as often or more are dropped; it is enough
    to ask those longer by a word, as counts only fall with length.
    """
    words, phrases = phrase_counts(docs, least, longest, lang_col, text_col)
    spelt = if_small(words.filter("word IS NOT NULL").select("h", "lang", "word", F.col("n").alias("wn")))
    totals = words.filter("word IS NULL").groupBy("lang").agg(F.sum("n").alias("total"))
    side = lambda name, start, size: F.slice("words", start, size).alias(name)
    longer = phrases.filter(F.size("words") > 2)
    over = longer.select(side("words", F.lit(1), F.size("words") - 1), "n").unionAll(longer.select(side("words", F.lit(2), F.size("words") - 1), "n"))
    over = over.groupBy("words").agg(F.max("n").alias("over"))
    stay = phrases.join(over, "words", "left").filter(F.col("over").isNull() | (100 * F.col("over") < percent * F.col("n"))).select("words", F.col("n").alias("a"))
    parts = phrases.unionAll(words.filter("word IS NOT NULL").select(F.array("h").alias("words"), "n"))
    cuts = stay.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, F.size("words")).alias("right"))
    cuts = cuts.join(parts.select(F.col("words").alias("left"), F.col("n").alias("l")), "left").join(parts.select(F.col("words").alias("right"), F.col("n").alias("r")), "right")
    lang = spelt.select(F.col("h").alias("first"), "lang")
    cuts = cuts.withColumn("first", F.element_at("words", 1)).join(lang, "first").join(F.broadcast(totals), "lang")
    exact = lambda *names: " * ".join(f"cast({n} as decimal(19, 0))" for n in names)
    cuts = cuts.withColumn("score", F.expr(f"({exact('1000 * a', 'total')}) div ({exact('l', 'r')})"))
    best = cuts.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r", "total")).alias("cut")).select("lang", "words", "cut.*")
    # scores and counts settle nearly all; the few with equal ones are spelt before the last ranking
    bound = Window.partitionBy("lang", F.pmod(F.xxhash64("words"), F.lit(64))).orderBy(F.desc("score"), F.desc("a"))
    best = best.withColumn("near", F.rank().over(bound)).filter(F.col("near") <= top).drop("near")
    named = best.select("*", F.posexplode("words").alias("at", "h")).join(spelt.select("h", "word"), "h")
    named = named.groupBy("lang", "words", "score", "a", "l", "r", "total").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    local = Window.partitionBy("lang", F.pmod(F.xxhash64("words"), F.lit(64))).orderBy(*order)
    named = named.withColumn("near", F.row_number().over(local)).filter(F.col("near") <= top).drop("near")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


ORACLE = """
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs)
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, w[i:i + k - 1] AS g FROM places, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, array_to_string(g, ' ') AS g, len(g) AS k, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), lists AS (
  SELECT lang, string_split(g, ' ') AS w, g, k, n FROM f
), over AS (
  SELECT lang, g, max(n) AS n FROM (
    SELECT lang, array_to_string(w[1:k - 1], ' ') AS g, n FROM lists WHERE k > 2 UNION ALL
    SELECT lang, array_to_string(w[2:k], ' ') AS g, n FROM lists WHERE k > 2
  ) GROUP BY ALL
), stay AS (
  SELECT lists.* FROM lists LEFT JOIN over USING (lang, g) WHERE lists.k >= 2 AND (over.n IS NULL OR 100 * over.n < 100 * lists.n)
), cuts AS (
  SELECT lang, g, w, n AS a, k, unnest(range(1, k)) AS c FROM stay
), scored AS (
  SELECT cuts.lang, cuts.g AS phrase, a, c, x.n AS l, y.n AS r, total.n AS n, ((1000::HUGEINT * a * total.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts
  JOIN f AS x ON x.lang = cuts.lang AND x.g = array_to_string(cuts.w[1:cuts.c], ' ')
  JOIN f AS y ON y.lang = cuts.lang AND y.g = array_to_string(cuts.w[cuts.c + 1:cuts.k], ' ')
  JOIN total ON total.lang = cuts.lang
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
