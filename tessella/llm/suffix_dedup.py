"""Removal of strings that an earlier document has, by a distributed sort of sampled suffixes.

Suffixes are sampled so that equal strings of 50 bytes sample equal places
(see ``suffixes``).  Only those matter whose 24-byte prefix another document
also samples: the prefixes' hashes are exchanged in sorted blocks, and each
bucket of documents hears which of its own are shared.  Of these, each bucket
sorts suffixes into front-coded runs, settles those with equal surroundings
among themselves, and sends the runs to the task that merges a share of the
prefixes.  Loser trees merge the runs without comparing known prefixes again;
the lengths shared by neighbours then tell, byte for byte and not by hash,
which strings belong together and which document has them first.

A bucket is a number of neighbouring rows of one file, or one long text, so a
lost task gives the same rows again; whole texts are shuffled once.  Shares and
the rows of a bucket grow with the input, up to MOST_SHARES shares.  All
suffixes of one prefix meet in one share; a bucket sends few of a passage that
many documents have, as it settles equal surroundings itself, but where the
surroundings differ, near a passage's ends, every document sends one.

Strings are judged on the input, never on what is left.  Documents of equal id
don't remove from each other; null ids come before all others.  Null and empty
texts have nothing to remove, and a null comes back as empty.  Very long texts
are treated whole.  An empty table gives no rows.  Other columns are handed
through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import binary, column, fresh, kept, numbered, slices, written
from tessella.llm.suffixes import LENGTH, Suffixes, cut_out, merge, open_run, pack_run, repeats, sampled, settle_copies, unfold

#: Rows of a bucket, times 16 at most where there are many shares; bytes of a text that is a bucket of its own.
ROWS, LONG_BYTES = 400, 250_000
#: Bytes of text for which there is one share of the prefixes; shares at least and at most.
SHARE_BYTES, LEAST_SHARES, MOST_SHARES = 8_000_000, 12, 1 << 17

SHARED = pa.schema([("share", pa.int32()), ("bucket", pa.int64()), ("block", pa.binary())])
RUNS = pa.schema([("share", pa.int32()), ("bucket", pa.int64()), ("run", pa.bool_()), ("block", pa.binary())])
SPANS = pa.schema([("bucket", pa.int64()), ("block", pa.binary())])

_FIRST = -(2**63)
#: The order of a bucket's rows.
PLACE = [("__sd_file", "ascending"), ("__sd_row", "ascending")]


def _narrow(h: np.ndarray) -> bytes:
    """Sorted 56-bit numbers as differences, equal bytes together, so that compression finds the zeros."""
    return np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _wide(block: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(block, dtype=np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _share(h: np.ndarray, shares: int) -> np.ndarray:
    return ((h >> np.uint64(24)) * np.uint64(shares) >> np.uint64(32)).astype(np.int32)


def _by_share(h: np.ndarray, shares: int):
    """The shares of sorted hashes, and where each begins and ends."""
    of = _share(h, shares)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return zip(of[first].tolist(), first.tolist(), [*first[1:].tolist(), len(h)])


def _lay(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return b"".join(texts), np.cumsum(sizes) - sizes


def _doc(starts: np.ndarray, total: int, at: np.ndarray) -> np.ndarray:
    """The document that holds each position; empty documents hold none."""
    ends = np.append(starts[1:], total)
    return np.searchsorted(ends, at, side="right")


def _prefixes(shares: int):
    """Each bucket's distinct prefix hashes, by share; the lowest bit is set if two of its documents have it."""

    def blocks(bucket: int, h: np.ndarray, doc: np.ndarray):
        by = np.lexsort((doc, h))
        h, doc = h[by], doc[by]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        last = np.append(first[1:], len(h)) - 1
        marked = (h[first] << np.uint64(1)) | (doc[first] != doc[last])
        for k, a, z in _by_share(h[first], shares):
            yield k, bucket, _narrow(marked[a:z])

    def run(batches):
        kept("suffix_dedup")
        open_: dict[int, list] = {}

        def closed(but=None):
            rows = [x for b in [b for b in open_ if b != but] for x in blocks(b, *map(np.concatenate, zip(*open_.pop(b))))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), SHARED)], schema=SHARED)

        for part in slices(batches):
            buckets, rows = column(part, "bucket").to_numpy(), column(part, "row").to_numpy()
            buffer, starts = _lay(binary(part, "text"))
            at, h = sampled(buffer, starts)
            doc = _doc(starts, len(buffer), at)
            for b in np.unique(buckets):
                mine = buckets[doc] == b
                if mine.any():
                    open_.setdefault(int(b), []).append((h[mine], rows[doc[mine]]))
            yield from closed(int(buckets[-1]))
        yield from closed()

    return run


def _shared_prefixes(table: pa.Table) -> pa.Table:
    """Tell each bucket which of its prefix hashes another document has."""
    kept("suffix_dedup")
    hashes = [_wide(b) for b in table["block"].to_pylist()]
    sizes = [len(h) for h in hashes]
    h = np.concatenate(hashes)
    bucket = np.repeat(np.arange(len(hashes)), sizes)
    twice = (h & np.uint64(1)).astype(bool)
    h >>= np.uint64(1)
    by = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], h[by][1:] != h[by][:-1])))
    wanted = np.zeros(len(h), dtype=bool)
    count = np.diff(np.append(first, len(h)))
    wanted[by] = np.repeat((count > 1) | np.maximum.reduceat(twice[by], first), count)
    rows = [(b, _narrow(h[a:z][wanted[a:z]])) for b, a, z in zip(table["bucket"].to_pylist(), np.cumsum(sizes) - sizes, np.cumsum(sizes)) if wanted[a:z].any()]
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), SPANS)], schema=SPANS) if rows else SPANS.empty_table()


def _pack_spans(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    """Spans of one bucket, overlapping ones joined."""
    by = np.lexsort((begin, doc))
    doc, begin, end = doc[by].astype(np.int64), begin[by].astype(np.int64), end[by].astype(np.int64)
    reach = np.maximum.accumulate(end + (doc << 40)) - (doc << 40)  # documents lie apart
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (begin[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    return np.stack((doc[first], begin[first], np.maximum.reduceat(end, first))).astype(np.int32).tobytes()


def _spans_of(s: Suffixes, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return s.doc, s.at - most, s.at - least + LENGTH


def _runs(shares: int):
    """A bucket's front-coded runs by share, and what it settles itself."""

    def run(key, docs: pa.Table, shared: pa.Table) -> pa.Table:
        kept("suffix_dedup")
        bucket = key[0].as_py()
        if not docs.num_rows or not shared.num_rows:
            return RUNS.empty_table()
        wanted = np.sort(np.concatenate([_wide(b) for b in shared["block"].to_pylist()]))
        held: dict[int, list] = {}
        rows: list[tuple] = []
        done = 0
        ordered = docs.sort_by(PLACE).combine_chunks()
        orders = np.array([_FIRST if x is None else x for x in ordered["__sd_id"].to_pylist()], dtype=np.int64)
        for batch in ordered.to_batches():
            for part in slices([batch], "__sd_text"):
                buffer, starts = _lay(binary(part, "__sd_text"))
                at, h = sampled(buffer, starts)
                i = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                keep = wanted[i] == h
                at, h = at[keep], h[keep]
                s = cut_out(buffer, starts, orders[done : done + part.num_rows], at)
                s.doc = s.doc + np.int32(done)
                done += part.num_rows
                by = np.argsort(h, kind="stable")
                for k, a, z in _by_share(h[by], shares):
                    held.setdefault(k, []).append(s.take(by[a:z]))
        settled = []
        for k in sorted(held):
            stay, gone = settle_copies(Suffixes(*map(np.concatenate, zip(*(vars(p).values() for p in held.pop(k))))))
            rows.append((k, bucket, True, pack_run(stay)))
            if len(gone):
                settled.append(_spans_of(gone, gone.low, gone.high))
        if settled:
            doc, begin, end = (np.concatenate(x) for x in zip(*settled))
            rows.append((bucket % shares, bucket, False, _pack_spans(doc, begin, end)))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), RUNS)], schema=RUNS) if rows else RUNS.empty_table()

    return run


def _merged(table: pa.Table) -> pa.Table:
    """Merge a share's runs, and give each bucket the spans that repeat an earlier document."""
    kept("suffix_dedup")
    is_run, buckets, blocks = (table[c].to_pylist() for c in ("run", "bucket", "block"))
    rows = [(b, x) for r, b, x in zip(is_run, buckets, blocks) if not r]
    opened = [(b, *open_run(x)) for r, b, x in zip(is_run, buckets, blocks) if r]
    if opened:
        order, shared = merge([(n.tolist(), unfold(n, tail)) for _, n, tail, _ in opened])
        order, shared = np.array(order), np.array(shared, dtype=np.int16)
        sizes = np.array([len(s) for *_, s in opened])
        at = np.empty(len(order), dtype=np.int64)
        at[np.argsort(order, kind="stable")] = np.arange(len(order))  # a run's suffixes come in its own order
        s = Suffixes(*map(np.concatenate, zip(*(vars(x).values() for *_, x in opened)))).take(at)
        least, most = repeats(s, shared)
        found = np.flatnonzero(most >= 0)
        found = found[np.argsort(order[found], kind="stable")]
        edges = np.searchsorted(order[found], np.arange(len(sizes) + 1))
        for k in np.flatnonzero(np.diff(edges)):
            mine = found[edges[k] : edges[k + 1]]
            rows.append((opened[k][0], _pack_spans(*_spans_of(s.take(mine), least[mine], most[mine]))))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), SPANS)], schema=SPANS) if rows else SPANS.empty_table()


def _cut(names: list[str], schema: pa.Schema, as_text: bool):
    """Take a bucket's spans out of its texts."""

    def run(key, docs: pa.Table, spans: pa.Table) -> pa.Table:
        kept("suffix_dedup")
        if not docs.num_rows:
            return schema.empty_table()
        docs = docs.sort_by(PLACE).combine_chunks()
        cuts: dict[int, np.ndarray] = {}
        if spans.num_rows:
            parts = [np.frombuffer(b, dtype=np.int32).reshape(3, -1) for b in spans["block"].to_pylist()]
            all_ = np.frombuffer(_pack_spans(*np.concatenate(parts, axis=1)), dtype=np.int32).reshape(3, -1)
            edges = np.searchsorted(all_[0], np.arange(docs.num_rows + 1))
            cuts = {int(d): all_[1:, edges[d] : edges[d + 1]].T.tolist() for d in np.unique(all_[0])}
        sizes, removed, left = [], [], []
        for i, text in enumerate(x or b"" for x in docs["__sd_text"].cast(pa.binary()).to_pylist()):
            here, parts = 0, []
            for begin, end in cuts.get(i, ()):
                parts.append(text[here:begin])
                here = end
            parts.append(text[here:])
            sizes.append(len(text))
            removed.append(len(text) - sum(map(len, parts)))
            # each part by itself: bytes from two sides of a cut never make a character
            left.append("".join(p.decode("utf-8", "ignore") for p in parts) if as_text else b"".join(parts))
        new = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(cuts.get(i, ())) for i in range(docs.num_rows)], pa.int64()), pa.array(left, pa.string() if as_text else pa.binary())]
        return pa.table([docs[c].cast(schema.field(c).type) for c in names] + new, schema=schema)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, plain_scan: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text, and four more: __n_bytes, __n_removed, __n_spans, __kept (what is left, as bytes or
    text); with more underscores where ``docs`` has such a column.

    As text, a character of which a byte is gone goes altogether.  ``docs`` is
    written with row numbers first; with ``plain_scan``, which says that it
    has each row of some files at most once, the files' own row numbers serve.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    others = [c for c in docs.columns if c != text_col]
    inner = {c: f"c{i}" for i, c in enumerate(others)}  # no outer name meets an inner one
    given = [F.col(c).alias(n) for c, n in inner.items()] + [F.col(id_col).cast("long").alias("__sd_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__sd_text")]
    if plain_scan:
        rows = docs.select(*given, F.xxhash64("_metadata.file_path").alias("__sd_file"), F.col("_metadata.row_index").alias("__sd_row"))
    else:
        rows = numbered(docs.select(*given), "__sd_row").withColumn("__sd_file", F.shiftright("__sd_row", 33))
    total = rows.agg(F.sum(F.octet_length("__sd_text").cast("long"))).first()[0] or 0
    shares = min(MOST_SHARES, max(LEAST_SHARES, -(-total // SHARE_BYTES)))
    near = F.floor(F.col("__sd_row") / (ROWS * max(1, min(16, shares // 1024))))
    alone = F.when(F.octet_length("__sd_text") > LONG_BYTES, F.col("__sd_row"))
    rows = rows.withColumn("__sd_bucket", F.xxhash64("__sd_file", near, alone))
    plain = rows.select(F.col("__sd_bucket").alias("bucket"), F.xxhash64("__sd_file", "__sd_row").alias("row"), F.col("__sd_text").alias("text"))
    prefixes = plain.mapInArrow(_prefixes(shares), "share int, bucket long, block binary")
    shared = written(prefixes.groupBy("share").applyInArrow(_shared_prefixes, "bucket long, block binary"), "prefixes")
    named = shared.withColumnRenamed("bucket", "__sd_bucket").groupBy("__sd_bucket")
    runs = rows.groupBy("__sd_bucket").cogroup(named).applyInArrow(_runs(shares), "share int, bucket long, run boolean, block binary")
    spans = runs.groupBy("share").applyInArrow(_merged, "bucket long, block binary")
    results = [(fresh(docs, n), t) for n, t in (("__n_bytes", T.LongType()), ("__n_removed", T.LongType()), ("__n_spans", T.LongType()), ("__kept", T.StringType() if as_text else T.BinaryType()))]
    out = T.StructType([T.StructField(n, docs.schema[c].dataType) for c, n in inner.items()] + [T.StructField(f"r{i}", t) for i, (_, t) in enumerate(results)])
    named = spans.withColumnRenamed("bucket", "__sd_bucket").groupBy("__sd_bucket")
    done = rows.groupBy("__sd_bucket").cogroup(named).applyInArrow(_cut(list(inner.values()), to_arrow_schema(out), as_text), out)
    return done.toDF(*others, *[n for n, _ in results])


def removal_report(docs: DataFrame, plain_scan: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``plain_scan`` as in ``suffix_dedup``."""
    out = suffix_dedup(docs.select("doc_id", "text"), plain_scan=plain_scan)
    size, removed, spans, kept = out.columns[-4:]
    return out.select("doc_id", F.col(size).alias("n_bytes"), F.col(removed).alias("n_removed"), F.col(spans).alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"))
