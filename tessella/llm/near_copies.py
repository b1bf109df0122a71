"""Near copies: documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

First come the pairs that the vantage-point trees of ``simhash`` link, by
fingerprints of the same shingles; each is verified on the whole sets, so that
like fingerprints alone never remove a document.  A pair's sets are only read if
their parities allow it: shingles are dealt to 512 bits, and a bit tells whether a
set has an odd number of its own, so two sets differ in at least as many shingles
as their parities in bits.  No fingerprint radius finds
every pair of that similarity, so what the trees leave apart is completed by
prefix filtering: with all shingles in one order, two sets that reach the
similarity share one among the first ``n - ceil(0.8 n) + 1`` shingles of each.
Any order is right; frequent shingles, counted in a sample, come last, so that a
common line is seldom a candidate.  A sample of bounded size can't tell shingles
that a small share of all rows have, so the lists of the first prefixes are
counted exactly, and where they are long, their shingles and others of the same
passages come late as well; the prefixes of rows that have any are made anew.
Both shape the order, never the result.

Members of a shingle's list that aren't in one group yet are compared with the
list's least row, and, while many pairs of different groups are left, with a few
others, picked by how much of them the lists share and by a hash.  So a large group of near copies grows together by a
few comparisons for each member and not for each pair.  In the end all pairs of
a list whose groups still differ are compared, and nothing is capped.

A text of fewer words is one shingle, as in ``simhash``; null and empty texts
are equal.  Shingles are compared by 64-bit hashes.  Very long texts are sets as
any others; an empty table gives no rows; other columns are handed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import binary, column, fresh, if_small, kept, let_go, numbered, remove, slices, written
from tessella.llm.components import connected_components
from tessella.llm.simhash import fingerprints, linked

#: Tenths of similarity that make a near copy; differing bits at which the trees link two fingerprints.
TENTHS, BITS = 8, 3
#: Rows that are counted for the order, about, at any size; rows of the sample that make a shingle frequent; frequent shingles, at most.
SAMPLE, FREQUENT, MOST = 20_000, 3, 500_000
#: Rows of a list of first prefixes from which its shingle comes late; rows of each such list whose sets are looked at for others of its passage.
LONG, LOOKED = 12, 8
#: The share of the sample's rows from which a shingle is hot, and the parts of its list.
HOT, PARTS = 0.01, 64
#: Members of a list, about, that are compared with as many others in one group of the last join.
BLOCK = 1000


#: Members of a list that the others meet in one turn; turns at most; pairs that are left for each entry of a list, before all are compared.
LEADERS, TURNS, MANY = 8, 6, 1 / 4

#: Longs of a set's parities.
LONGS = 8

SETS = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("odd", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64()))])


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Distinct hashes of a text's word shingles, ascending."""
    found = text.lower().split()
    joined = b" ".join(found)
    hashed = xxhash.xxh64_intdigest
    if len(found) < words:
        return np.array([hashed(joined, 42)], dtype=np.uint64).view(np.int64)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([hashed(joined[a:b], 42) for a, b in zip(begins.tolist(), ends[words - 1 :].tolist())], dtype=np.uint64).view(np.int64))


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of shingles falls to it, as LONGS numbers."""
    counts = np.bincount(shingles & (64 * LONGS - 1), minlength=64 * LONGS)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view("<i8")


def shingle_sets(rows: DataFrame, words: int, last=None) -> DataFrame:
    """Columns row, text to row, n, odd, grams: the parities of the set, and all shingles, or with ``last`` (a broadcast of
    frequent shingles and their ranks) the prefix that a similar set must meet, in order."""

    def run(batches):
        kept("near_copies")
        for part in slices(batches):
            sets = [shingles(t, words) for t in binary(part, "text")]
            sizes = [len(s) for s in sets]
            odd = np.concatenate([parities(s) for s in sets])
            if last is not None:
                keys, ranks = last.value
                flat = np.concatenate(sets)
                at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
                rank = np.where(keys[at] == flat, ranks[at], 0) if len(keys) else np.zeros(len(flat), dtype=np.int64)
                for k, (s, end) in enumerate(zip(sets, np.cumsum(sizes).tolist())):
                    n = len(s)
                    sets[k] = s[np.argsort(rank[end - n : end], kind="stable")][: n - -(-TENTHS * n // 10) + 1]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
            odds = pa.ListArray.from_arrays(pa.array(np.arange(0, len(odd) + 1, LONGS, dtype=np.int32)), pa.array(odd))
            yield pa.RecordBatch.from_arrays([column(part, "row"), pa.array(sizes, pa.int32()), odds, grams], schema=SETS)

    return rows.select("row", "text").mapInArrow(run, "row long, n int, odd array<long>, grams array<long>")


def _frequent(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that several rows of the sample have, ascending, their ranks from 1, the most frequent last, and those of a HOT share of rows."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = shingle_sets(sample, words).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= FREQUENT)
    found = counts.orderBy(F.desc("c"), "gram").limit(MOST).toArrow()
    keys = found["gram"].to_numpy()
    by = np.argsort(keys)
    return keys[by], len(keys) - by, keys[found["c"].to_numpy() >= max(FREQUENT, HOT * share * n)]


def _having(prefixes: DataFrame, some) -> DataFrame:
    """Columns row, gram: the entries of prefixes that are among ``some``, a broadcast of ascending shingles."""

    def run(batches):
        keys = some.value
        for batch in batches:
            grams = column(batch, "grams")
            flat, of = grams.flatten().to_numpy(), np.repeat(column(batch, "row").to_numpy(), pc.list_value_length(grams).to_numpy())
            hit = keys[np.minimum(np.searchsorted(keys, flat), len(keys) - 1)] == flat
            yield pa.RecordBatch.from_arrays([pa.array(of[hit]), pa.array(flat[hit])], names=["row", "gram"])

    return prefixes.select("row", "grams").mapInArrow(run, "row long, gram long")


def _late(prefixes: DataFrame, rows: DataFrame, words: int, keys: np.ndarray, paths: list[str]) -> np.ndarray:
    """Shingles, ascending and not among ``keys``, that long lists of the prefixes have, or that some of those lists' rows share."""
    most = lambda counts, least: counts.filter(F.col("c") >= least).orderBy(F.desc("c"), "gram").limit(MOST).select("gram").toArrow()["gram"].to_numpy()
    counted = lambda grams: grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    long = np.setdiff1d(most(counted(prefixes.select(F.explode("grams").alias("gram"))), LONG), keys)
    if not len(long):
        return long
    some = _having(prefixes, rows.sparkSession.sparkContext.broadcast(long))
    looked = some.groupBy("gram").agg(F.array(*[F.min_by("row", F.xxhash64(F.lit(k), "row")) for k in range(LOOKED)]).alias("rows"))
    looked = written(looked.select(F.explode("rows").alias("row")).distinct(), "looked", paths)
    sets = shingle_sets(rows.join(if_small(looked), "row", "left_semi"), words)
    return np.setdiff1d(np.union1d(long, most(counted(sets.select(F.explode("grams").alias("gram"))), FREQUENT)), keys)


def _prefixes(rows: DataFrame, words: int, paths: list[str]) -> tuple[DataFrame, np.ndarray]:
    """``shingle_sets`` with the prefix of every row, written, and the hot shingles."""
    keys, ranks, often = _frequent(rows, words)
    context = rows.sparkSession.sparkContext
    first = written(shingle_sets(rows, words, context.broadcast((keys, ranks))), "begun", paths)  # MOST shingles at most
    late = _late(first, rows, words, keys, paths)
    if not len(late):
        return first, often
    # late ones go between the rare and the frequent, so that a prefix without any of them is as it was
    both, ranked = np.concatenate((keys, late)), np.concatenate((ranks + 1, np.ones(len(late), dtype=ranks.dtype)))
    by = np.argsort(both)
    changed = written(_having(first, context.broadcast(late)).select("row").distinct(), "changed", paths)
    again = shingle_sets(rows.join(if_small(changed), "row", "left_semi"), words, context.broadcast((both[by], ranked[by])))
    return first.join(if_small(changed), "row", "left_anti").unionByName(written(again, "again", paths)), often


def _enough(shared: Column, na: Column, nb: Column) -> Column:
    """shared / (na + nb - shared) >= TENTHS / 10, in whole numbers."""
    return (10 + TENTHS) * shared.cast("long") >= TENTHS * (na.cast("long") + nb)


def _similar(pairs: DataFrame, rows: DataFrame, words: int, paths: list[str]) -> DataFrame:
    """Those pairs of rows (a, b) that are near copies, found from their whole sets."""
    named = written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "named", paths)
    sets = written(shingle_sets(rows.join(if_small(named), "row", "left_semi"), words), "sets", paths)
    side = lambda k: sets.select(F.col("row").alias(k), F.col("n").alias(f"n{k}"), F.col("grams").alias(f"g{k}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.filter(_enough(shared, F.col("na"), F.col("nb"))).select("a", "b")


def _possible(pairs: DataFrame, odds: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose parities leave room for the similarity; no near copies are lost."""
    side = lambda k: odds.select(F.col("row").alias(k), F.col("n").alias(f"n{k}"), *[F.col("odd")[i].alias(f"{k}{i}") for i in range(LONGS)])
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(LONGS)), F.lit(0))
    total = F.col("na").cast("long") + F.col("nb")
    return both.filter((10 + TENTHS) * (total - differ) >= 2 * TENTHS * total).select("a", "b")


def _verified(pairs: DataFrame, odds: DataFrame, rows: DataFrame, words: int, paths: list[str]) -> DataFrame:
    """``_similar`` of what is possible, written; the sets go at once."""
    own: list[str] = []
    out = written(_similar(written(_possible(pairs, odds), "pairs", own), rows, words, own), "links", paths)
    remove(rows.sparkSession, *own)
    return out


def fingerprint_pairs(rows: DataFrame, words: int, paths: list[str], most: int = BITS) -> DataFrame:
    """Columns a, b: pairs of rows whose fingerprints the vantage-point trees link, or who share one."""
    prints = written(fingerprints(rows.select("row", F.col("row").alias("id"), "text"), words), "prints", paths)
    points = written(prints.groupBy("fp").agg(F.min("row").alias("first")), "points", paths)
    same = prints.join(points, "fp").filter("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    end = lambda k: points.select(F.col("fp").alias(k), F.col("first").alias(f"of_{k}"))
    near = linked(points, most).join(end("a"), "a").join(end("b"), "b")
    return same.unionByName(near.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct())


def _left(apart: DataFrame) -> int:
    """Pairs that share a list but no group, counted in each list."""
    sizes = apart.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("k"))
    pairs = sizes.groupBy("gram").agg((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))).alias("twice"))
    return (pairs.agg(F.sum("twice")).first()[0] or 0) // 2


def near_links(rows: DataFrame, words: int, paths: list[str]) -> DataFrame:
    """Columns a, b: links that connect exactly the rows that pairs of near copies connect.

    ``rows`` has row (long, unique) and text, and should be a written table;
    ``paths`` gets the folders of the tables that are written on the way.
    """
    begun: list[str] = []
    prefixes, often = _prefixes(rows, words, begun)
    odds = written(prefixes.select("row", "n", "odd"), "odds", paths)
    sure = _verified(fingerprint_pairs(rows, words, paths), odds, rows, words, paths)
    groups = written(connected_components(sure), "groups", paths)
    let_go(rows.sparkSession)
    root = lambda df, k: df.join(if_small(groups.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))), k, "left").withColumn(f"root_{k}", F.coalesce(f"root_{k}", k))
    listed = prefixes.select("row", "n", F.posexplode("grams").alias("at", "gram"))
    # a hot shingle's list is dealt to parts, each with a first row of its own; what parts leave apart is compared below
    hot = F.broadcast(rows.sparkSession.createDataFrame([(int(k),) for k in often], "gram long").withColumn("hot", F.lit(True)))
    listed = listed.join(hot, "gram", "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(PARTS))).otherwise(0))
    of = Window.partitionBy("gram", "part")
    led = F.min(F.struct("row", "n", "at")).over(of)
    listed = listed.select("row", "n", "at", "gram", "hot", led.alias("first"), F.count(F.lit(1)).over(of).alias("c")).filter("c > 1 OR hot")
    listed = written(listed.select("row", "n", "at", "gram", "first"), "listed", paths)
    remove(rows.sparkSession, *begun)
    let_go(rows.sparkSession)
    # what follows a shared shingle bounds what two sets can share, if it is their first; at their first it always passes
    fits = lambda na, ia, nb, ib: _enough(F.least(na - ia, nb - ib), na, nb)
    c = F.col
    stars = listed.filter((c("row") != c("first.row")) & fits(c("first.n"), c("first.at"), c("n"), c("at")))
    stars = root(root(stars.select(c("first.row").alias("a"), c("row").alias("b")).distinct(), "a"), "b")
    stars = written(stars.filter("root_a <> root_b").select("a", "b"), "stars", paths)
    links = sure.unionByName(_verified(stars, odds, rows, words, paths))
    # the more of a set's prefix others share, the nearer it is to what a group of copies comes from
    share = written(listed.groupBy("row").agg((F.count(F.lit(1)) / F.first("n")).alias("share")), "share", paths)
    most, before, gone = MANY * listed.count(), None, []
    for turn in range(TURNS + 1):
        of = share.join(connected_components(links).withColumnRenamed("node", "row"), "row", "left").select("row", "share", F.coalesce("root", "row").alias("root"))
        remove(rows.sparkSession, *gone)
        let_go(rows.sparkSession)
        gone = []
        apart = written(listed.join(if_small(written(of, "roots", paths)), "row").select("gram", "row", "n", "at", "share", "root"), "apart", gone)
        left = _left(apart)
        if left <= most or turn == TURNS or before is not None and left > before * 0.9:
            break
        before = left
        picked = lambda k: c("share") * (1 - F.pmod(F.xxhash64(F.lit(k), "row"), F.lit(1000)) / 4000)
        picks = [F.max_by(F.struct("row", "n", "at", "root"), F.struct(picked(turn * LEADERS + k), "row")) for k in range(LEADERS)]
        led = apart.groupBy("gram").agg(F.array_distinct(F.array(*picks)).alias("led"), (F.min("root") != F.max("root")).alias("several")).filter("several")
        met = F.filter("led", lambda x: (x["root"] != c("root")) & fits(x["n"], x["at"], c("n"), c("at")))
        met = apart.join(led, "gram").select("row", F.explode(met).alias("x")).select(F.least("row", "x.row").alias("a"), F.greatest("row", "x.row").alias("b"))
        links = links.unionByName(_verified(met.distinct(), odds, rows, words, paths))
    paths += gone
    let_go(rows.sparkSession)
    pairs = written(_apart_pairs(apart, fits).distinct(), "open", paths)
    return links.unionByName(_verified(pairs.join(stars, ["a", "b"], "left_anti"), odds, rows, words, paths))


def _apart_pairs(apart: DataFrame, fits) -> DataFrame:
    """Pairs of rows of different groups that share a list and may be similar.

    A long list is dealt to blocks, and each two blocks of it meet in a group of their own.
    """
    long = apart.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = apart.join(long, "gram", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("gram", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "row", "n", "at", "root")
    x, y = dealt.alias("x"), dealt.alias("y")
    c = F.col
    same = (c("x.gram") == c("y.gram")) & (c("x.low") == c("y.low")) & (c("x.high") == c("y.high"))
    once = (c("x.row") < c("y.row")) & ((c("x.low") == c("x.high")) | (c("x.mine") != c("y.mine")))
    pairs = x.join(y, same & once & (c("x.root") != c("y.root")) & fits(c("x.n"), c("x.at"), c("y.n"), c("y.at")))
    return pairs.select(c("x.row").alias("a"), c("y.row").alias("b"))


def without_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of linked near copies: that with the least id, of equal ids the
    first one written; null ids only where all are null.
    """
    row = fresh(docs, "__row")
    all_rows = numbered(docs, row)
    rows = all_rows.select(F.col(row).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    paths: list[str] = []
    groups = written(connected_components(near_links(rows, words, paths)), "groups")
    remove(docs.sparkSession, *paths)
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    ids = all_rows.select(F.col(row).alias("node"), F.col(id_col).cast("long").alias("id"))
    members = written(members.join(ids, "node"), "members")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("node"))
    stays = members.groupBy("root").agg(F.min_by("node", order).alias("node")).select("node")
    goes = written(members.join(stays, "node", "left_anti").select(F.col("node").alias(row)), "goes")
    return all_rows.join(if_small(goes), row, "left_anti").select(*docs.columns)
