"""Samples and batches in seeded orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranking import ranked
from tessella.operators.splits import hash_order
from tessella.session import can_checkpoint


def stratified_subsample(df: DataFrame, limit: int, seed: int, key: str, y: str = "y") -> DataFrame:
    """Exactly ``limit`` rows (or all) at about the table's rate, one of each class at least."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(y), F.lit(0)).alias("p")).withColumn("q", F.col("n") - F.col("p"))
    want = F.least(F.col("p"), F.greatest(F.lit(1), F.bround(limit * F.col("p") / F.nullif(F.col("n"), F.lit(0))).cast("long")))
    want = F.when(F.col("q") > 0, F.least(want, F.lit(limit - 1))).otherwise(want)
    n = n.withColumn("np", want).withColumn("nn", F.least(F.col("q"), limit - F.col("np"))).withColumn("np", F.least(F.col("p"), limit - F.col("nn")))
    dealt = ranked(df, [hash_order(seed, F.col(key)), F.col(key)], [y], "__k")
    return dealt.crossJoin(F.broadcast(n)).filter(F.col("__k") <= F.when(F.col(y) == 1, F.col("np")).otherwise(F.col("nn"))).select(*df.columns)  # one row


def hard_pool(df: DataFrame, score: str, key: str, fraction: float) -> DataFrame:
    """The ceil(n * fraction) rows of highest score, one at least, by key among equals; a null score is the lowest."""
    if not 0 < fraction <= 1:
        raise ValueError("a pool is a share in (0, 1]")
    total = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.lit(fraction))).cast("long").alias("__want"))
    down = F.coalesce(-F.col(score).cast("double"), F.lit(float("inf")))
    return ranked(df, [down, F.col(key)], name="__k").crossJoin(F.broadcast(total)).filter(F.col("__k") <= F.col("__want")).select(*df.columns)  # one row


#: Candidates that a gap in a batch is offered at a time.
OFFERS = 16


def _dealt(rows: DataFrame, size: int, quota: int, batches: int, seed: int, key: str, first: int = 0) -> DataFrame:
    """``rows`` dealt in cycles, each in its own seeded order: columns key, place.  ``first``: the first cycle."""
    cycles = -(-quota * batches // size)
    copies = rows.select(key, F.explode(F.sequence(F.lit(first), F.lit(first + cycles - 1))).alias("__cycle"))
    order = hash_order(seed, F.concat_ws(":", F.col("__cycle").cast("string"), F.col(key).cast("string")))
    out = ranked(copies, [order, F.col(key)], ["__cycle"], "__k")
    return out.select(key, ((F.col("__cycle") - first) * size + F.col("__k") - 1).alias("place")).filter(F.col("place") < quota * batches)


def _stream(rows: DataFrame, size: int, quota: int, batches: int, seed: int, key: str, taken: DataFrame | None) -> DataFrame:
    """Columns batch, key: ``quota`` different rows for each batch, none of which is in ``taken`` (batch, key).

    What comes twice in a batch that spans two cycles, or is taken, leaves a
    gap.  Gaps are offered the rows of one more seeded order in
    turn, OFFERS at a time, until all are filled: as a batch never asks for
    more rows than there are, some row fits.
    """
    at = _dealt(rows, size, quota, batches, seed, key).withColumn("batch", F.floor(F.col("place") / quota))
    again = F.row_number().over(Window.partitionBy("batch", key).orderBy("place"))  # a row and a batch: two at most
    at = at.withColumn("__again", again)
    if taken is not None:
        at = at.join(taken.select("batch", key, F.lit(True).alias("__taken")), ["batch", key], "left")
    else:
        at = at.withColumn("__taken", F.lit(None).cast("boolean"))
    at = at.checkpoint()
    out = at.filter("__again = 1 AND __taken IS NULL").select("batch", key)
    gaps = at.filter("__again > 1 OR __taken").select("batch", F.col("place").alias("__g"))
    if gaps.isEmpty():
        return out
    spare = ranked(rows.select(key), [hash_order(seed + 1, F.col(key)), F.col(key)], name="__k").select(key, (F.col("__k") - 1).alias("__k")).checkpoint()
    turn = 0
    while not gaps.isEmpty():
        offered = gaps.select("batch", "__g", F.explode(F.sequence(F.lit(0), F.lit(min(OFFERS, size) - 1))).alias("__o"))
        offered = offered.withColumn("__k", F.pmod(F.col("__g") * OFFERS + turn * OFFERS + F.col("__o"), F.lit(size))).join(spare, "__k")
        for there in (out, taken):
            if there is not None:
                offered = offered.join(there.select("batch", key), ["batch", key], "left_anti")
        # one gap of a batch gets a row, and a gap one row
        mine = offered.groupBy("batch", key).agg(F.min(F.struct("__g", "__o")).alias("m")).select("batch", key, "m.*")
        mine = mine.groupBy("batch", "__g").agg(F.min_by(key, F.struct("__o", key)).alias(key)).checkpoint()
        out = out.unionByName(mine.select("batch", key))
        gaps = gaps.join(mine.select("__g"), "__g", "left_anti").select("batch", "__g").checkpoint()
        turn += 1
    return out


def batch_quotas(batch_size: int, fraction: float, share: float = 0.0) -> tuple[int, int, int]:
    """Positives, hard negatives and uniform negatives of a batch; halves are rounded to even numbers."""
    if batch_size <= 0:
        raise ValueError("a batch has one row at least")
    if not 0 < fraction < 1:
        raise ValueError("the share of positives lies between 0 and 1")
    if not 0 <= share <= 1:
        raise ValueError("the share of hard negatives lies in [0, 1]")
    n_pos = round(batch_size * fraction)
    if not 0 < n_pos < batch_size:
        raise ValueError("a batch needs both classes")
    hard = round((batch_size - n_pos) * share)
    return n_pos, hard, batch_size - n_pos - hard


def epoch_length(n_negative: int, n_hard: int, hard: int, uniform: int) -> int:
    """Batches of an epoch: one pass of the uniform stream over all negatives, or over the hard pool if no row is uniform."""
    return max(1, n_negative // uniform if uniform > 0 else n_hard // hard)


def ratio_batches(df: DataFrame, batch_size: int, fraction: float, batches: int | None, seed: int, key: str, y: str = "y", hard: DataFrame | None = None, share: float = 0.0) -> DataFrame:
    """Batches with round(batch_size * fraction) positives: columns batch, key, y, source (positive, hard or uniform).

    Positives, the hard pool (``hard``: keys of negatives; round(negatives *
    share) of a batch) and all negatives are dealt as three streams, each in
    cycles with a seeded order of its own.  No row comes twice in a batch: a
    uniform negative that is in the batch as a hard one gives way to another.
    ``batches`` of None is the length of an epoch.  A pool with fewer different
    rows than its share of a batch is an error, as is a row of both classes.
    """
    mining = hard is not None and share > 0
    n_pos, n_hard, n_uniform = batch_quotas(batch_size, fraction, share if mining else 0.0)
    can_checkpoint(df.sparkSession)
    rows = df.select(key, F.col(y).alias("__y"))
    if rows.groupBy(key).agg(F.countDistinct("__y").alias("n")).filter("n > 1").head(1):
        raise ValueError("a row can't be of both classes")
    pos, neg = (rows.filter(F.col("__y") == k).select(key).distinct() for k in (1, 0))
    pool = hard.select(key).distinct() if mining else None
    sizes = [x.count() if x is not None else 0 for x in (pos, pool, neg)]
    for n, quota, what in zip(sizes, (n_pos, n_hard, n_hard + n_uniform), ("positives", "hard negatives", "negatives")):
        if n < quota:
            raise ValueError(f"{n} different {what} can't fill {quota} places of a batch")
    if mining and pool.join(neg, key, "left_anti").head(1):
        raise ValueError("the hard pool has rows that aren't negatives")
    if batches is None:
        batches = epoch_length(sizes[2], sizes[1], n_hard, n_uniform)
    elif batches < 1:
        raise ValueError("an epoch has one batch at least")
    parts = [_stream(pos, sizes[0], n_pos, batches, seed, key, None).withColumns({y: F.lit(1), "source": F.lit("positive")})]
    taken = None
    if n_hard:
        taken = _stream(pool, sizes[1], n_hard, batches, seed + 2, key, None).checkpoint()
        parts.append(taken.withColumns({y: F.lit(0), "source": F.lit("hard")}))
    if n_uniform:
        parts.append(_stream(neg, sizes[2], n_uniform, batches, seed + 4, key, taken).withColumns({y: F.lit(0), "source": F.lit("uniform")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def composition(batches: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """The log of batches: rows, positives and negatives of each, and how many of these are hard where the source is known."""
    counts = {"batch_size": F.count(F.lit(1)), "n_positive": F.count_if(F.col(y) == 1), "n_negative": F.count_if(F.col(y) == 0)}
    if "source" in batches.columns:
        counts["n_hard_negative"] = F.count_if(F.col("source") == "hard")
    return batches.groupBy(*by).agg(*[c.alias(k) for k, c in counts.items()])


def display_order(tiles: DataFrame, key: str, size: str, label: str, tries: int = 512, session: str = "session", twice: bool = False) -> DataFrame:
    """Of ``tries`` seeded orders of each session the one with fewest neighbours of equal size or label: columns session, key, position, conflicts.

    A session is what one reviewer is shown.  Two neighbours equal in both are
    one conflict, with ``twice`` two.
    """
    at = tiles.select(session, key, size, label, F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
    at = at.repartition(session, "try")  # before the order's hashes are made, which would be most of what is exchanged
    seeded = [F.md5(F.concat_ws(":", F.col("try").cast("string"), F.col(key).cast("string"))), F.col(key)]
    order = Window.partitionBy(session, "try").orderBy(*seeded)
    if twice:
        clash = F.coalesce(sum((F.col(c) == F.lag(c).over(order)).cast("int") for c in (size, label)), F.lit(0))
    else:
        same = [F.col(c).eqNullSafe(F.lag(c).over(order)) for c in (size, label)]
        clash = ((F.row_number().over(order) > 1) & (same[0] | same[1])).cast("int")
    at = at.withColumn("clash", clash)
    best = at.groupBy(session, "try").agg(F.sum("clash").alias("conflicts")).groupBy(session).agg(F.min(F.struct("conflicts", "try")).alias("b"))
    best = best.select(session, F.col("b.try").alias("try"), F.col("b.conflicts").alias("conflicts"))
    # only the order that was found is made again
    chosen = tiles.select(session, key).join(best, session)
    return chosen.select(session, key, F.row_number().over(Window.partitionBy(session).orderBy(*seeded)).alias("position"), "conflicts")


def paired_sample(df: DataFrame, by: str, flag: str, most: int, seed: int, key: str) -> DataFrame:
    """As many rows with the flag as without for each group, up to ``most``."""
    sizes = df.groupBy(by).agg(F.least(F.lit(most).cast("long"), F.count_if(F.col(flag)), F.count_if(~F.col(flag))).alias("__m"))
    w = Window.partitionBy(by, flag).orderBy(hash_order(seed, F.col(key)), key)
    return df.withColumn("__k", F.row_number().over(w)).join(sizes, by).filter(F.col("__k") <= F.col("__m")).drop("__k", "__m")
