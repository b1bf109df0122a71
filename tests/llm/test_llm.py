"""Each operator against a brute-force version, and on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import components, encoding, exact_dedup, fingerprint, packing, prefix_bpe, simhash, suffix_dedup, suffixes, token_counts, toxicity, url_filter, wavelet

WORD, BYTE, MULTI, PIECE = (P.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"))

#: Column names that the operators use inside.
EXTRA = "row string, bucket string, id string, __row int, fp int, digest string, n int, kind string"
SHARED = "a passage that stands in several of these documents and is longer than fifty bytes, word for word. "


def texts() -> list[tuple]:
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "x", "42", "the", "of", "don't", "naïve,", "(see", "end.\n"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = prose(30_000)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, prose(200)), (5, SHARED + prose(50)), (6, prose(40) + SHARED + SHARED + prose(30)), (7, "x" * 500), (8, "x" * 700), (9, long), (10, long.upper()), (11, long[:-4]), (11, long[:-4]), (12, prose(200)), (None, prose(60)), (None, SHARED), (13, "ﬁne  cafe\u0301 \u2028\U0001f389 你好 <|endoftext|> ▁a  b "), (14, "fine café"), (15, "A\0B" * 40)]
    out += [(20 + i, "copied many times over and over again in this very table, more than fifty bytes") for i in range(60)]
    return out


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, *["clash"] * 3, 1, 2, "d", 3, "k") for i, t in texts()]  # columns that clash with inner ones
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "t")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    return spark.read.parquet(path)


def body(df) -> list[tuple]:
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def hf_ids(path, text, end):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [end]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# 1 packing


def test_packing_places_each_id_once(docs):
    rows = packing.packed_pieces(docs, WORD, 1).collect()
    ids = {i: hf_ids(WORD, t, 1) for i, t in body(docs)}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, x in ids.items():
        if i not in (None, 11):  # these ids stand for two documents
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == crc(x[at : at + r.length]) and r.doc_tokens == len(x)
                at += r.length
            assert at == len(x)
    assert sum(r.length for r in rows) == sum(len(hf_ids(WORD, t, 1)) for _, t in body(docs))
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_packing_keeps_all_limits():
    rng = np.random.default_rng(2)
    limits = packing.Limits(100, 4, 60)
    packer = packing.Packer(limits, waiting=16)
    examples = [packing.Example(i, np.arange(n), np.concatenate(([0], np.cumsum(rng.random(n) < 0.7)))) for i, n in enumerate(rng.integers(1, 250, 200))]
    out = [s for e in examples for s in packer.add(e)] + list(packer.finish())
    seen = collections.Counter()
    for s in out:
        assert sum(b - a for _, a, b in s) <= 100 and len(s) <= 4 and sum(int(e.losses[b] - e.losses[a]) for e, a, b in s) <= 60
        for e, a, b in s:
            seen.update((e.doc, k) for k in range(a, b))
    assert len(seen) == sum(e.n for e in examples) and max(seen.values()) == 1


def test_packing_of_instruction_data(spark):
    df = spark.createDataFrame([(1, [5, 6, 7], [False, True, True]), (2, [8], None), (3, None, None), (4, [1, 2], [True])], "id long, ids array<int>, loss array<boolean>")
    rows = packing.pack_examples(df, packing.Limits(4, 2, 3)).collect()
    assert {(r.id, sum(x.length for x in rows if x.id == r.id), sum(x.loss_tokens for x in rows if x.id == r.id)) for r in rows} == {(1, 3, 2), (2, 1, 1), (4, 2, 2)}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    assert all(sum(r.length for r in x) <= 4 and len(x) <= 2 and sum(r.loss_tokens for r in x) <= 3 for x in by.values())


# 2 SimHash


def plain_simhash(text: str) -> int:
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate(dict.fromkeys(range(9, 14), " ")).split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ([" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)])]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def plain_components(points: list[int], most: int) -> list[int]:
    of = list(range(len(points)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= most:
                a, b = root(i), root(j)
                of[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(points))]


def test_simhash(docs, monkeypatch):
    rows = simhash.simhash_components(docs).collect()
    assert len(rows) == docs.count()
    want = [(i, plain_simhash(t)) for i, t in body(docs)]
    assert collections.Counter((r.doc_id, r.fingerprint) for r in rows) == collections.Counter((i, f"{h:016x}") for i, h in want)
    of = plain_components([h for _, h in want], 3)
    least = {k: min((want[j][0] for j in range(len(of)) if of[j] == k and want[j][0] is not None), default=None) for k in set(of)}
    assert collections.Counter((r.doc_id, r.component_id) for r in rows) == collections.Counter((want[j][0], least[of[j]]) for j in range(len(of)))


@pytest.mark.parametrize("seed", range(3))
def test_vantage_points_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, int(k))).astype(np.uint64), axis=1) for c, k in zip(centres, rng.integers(1, 9, 12))]))
    want = plain_components([int(x) for x in fps], 3)
    edges = set()
    for k in (0, 1):
        halves = simhash.half(fps, k)
        tree, leaves = simhash.number(simhash.grow(halves, 40))
        assert leaves > 2
        out: list = []
        simhash.place(tree, np.arange(len(fps)), halves, np.ones(len(fps), dtype=bool), 1, out)
        for leaf in range(leaves):
            parts = [(at, home) for n, at, home in out if n == leaf]
            at = np.concatenate([a for a, _ in parts]) if parts else np.zeros(0, dtype=int)
            home = np.concatenate([h for _, h in parts]) if parts else np.zeros(0, dtype=bool)
            links: list = []
            simhash.link(fps[at], halves[at], np.flatnonzero(home), np.flatnonzero(~home), 3, simhash.Groups(len(at)), links)
            assert all(int(fps[at[i]] ^ fps[at[j]]).bit_count() <= 3 for i, j in links)
            edges |= {(int(at[i]), int(at[j])) for i, j in links}
    of = list(range(len(fps)))
    for _ in range(len(fps)):
        before = list(of)
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
        if of == before:
            break
    classes = lambda x: {frozenset(j for j in range(len(x)) if x[j] == k) for k in set(x)}
    assert classes(of) == classes(want)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 230)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    of = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    assert got == {n: r for n, r in of.items() if n != r}


# 3 exact


def test_exact_dedup(docs):
    rows = exact_dedup.exact_dedup(docs, k=4).collect()
    norm = [(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for i, t in body(docs)]
    by = collections.defaultdict(list)
    for i, t in norm:
        by[t].append(-1 if i is None else i)
    want = collections.Counter((i, max(by[t]) if max(by[t]) >= 0 else None, len(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(by) and all(r.doc_id == r.keep_id for r in rows if r.kept)
    kept = exact_dedup.without_copies(docs, k=4)
    assert kept.columns == docs.columns and kept.count() == len(by) and {r["__row"] for r in kept.collect()} == {1}


def test_misra_gries_misses_no_frequent_value():
    rng = random.Random(4)
    values = [bytes([min(int(rng.expovariate(0.4)), 99)]) for _ in range(5000)]
    counts = exact_dedup.misra_gries({}, values, 7)
    assert len(counts) <= 7 and {v for v, n in collections.Counter(values).items() if n > 5000 / 8} <= set(counts)


# 4 toxicity


def test_toxicity(spark, none):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, marks = [], []
    for i in range(800):
        y = int(rng.random() < 0.25)
        t = [rng.choice(words) for _ in range(rng.randrange(5, 200))]
        if y:
            t[rng.randrange(len(t))] = rng.choice(["idiot", "clown"])
        rows.append((i, " ".join(t)))
        marks.append((i, y))
    rows += [(900, None), (901, ""), (902, "w1 " * 50_000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks + [(903, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert len(got) == 803 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert got[900].score == got[901].score
    held = [(got[i].predicted, y) for i, y in marks if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.9
    assert toxicity.toxicity_report(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_report(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_do_not_matter(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} " + ("bad" if i % 3 == 0 else "good")) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity_report(docs, x).collect()} for x in (labels, turned))
    assert a == b


# 5 wavelet files


def test_wavelet_files(spark, docs, none):
    files = wavelet.write_files(docs, BYTE, 2)
    rows = wavelet.read_files(files).collect()
    want = sorted(((-1 if i is None else i), t) for i, t in body(docs))
    got = sorted(rows, key=lambda r: r.start)
    at = 0
    everything = []
    for (i, t), r in zip(want, got, strict=True):
        ids = hf_ids(BYTE, t, 2)
        assert (r.id if r.id is not None else -1, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), crc(ids)) and r.last_id == 2
        at += len(ids)
        everything += ids
    n = collections.Counter(everything)
    assert {r.token: r.n for r in wavelet.count_tokens(files, [2, 262, 50256, 65535]).collect()} == {k: n[k] for k in (2, 262, 50256, 65535)}
    assert wavelet.find_token(files, 2).count() == len(want)
    assert wavelet.tokens_read_back(none, BYTE, 2).count() == 0


@pytest.mark.parametrize("n", [1, 7, 512, 513, 3000])
def test_wavelet_matrix(n):
    v = np.random.default_rng(n).integers(0, 40, n)
    m = wavelet.WaveletMatrix.build(v, 16)
    assert (m.values() == v).all() and [m.access(i) for i in range(0, n, 11)] == v[::11].tolist()
    assert (m.access_all(np.arange(n)) == v).all() and (m.access_all(np.repeat(np.arange(n), 5)) == np.repeat(v, 5)).all()
    f = wavelet.File(wavelet.to_file(v, 16, [4, None], np.array([0, n // 2])))
    assert f.docs == [4, None] and f.starts.tolist() == [0, n // 2] and all((a == b).all() for a, b in zip(f.matrix.ones, m.ones, strict=True))
    assert f.matrix.select(int(v[-1]), m.count(int(v[-1])) - 1) == n - 1 and (f.matrix.values() == v).all()
    for t in range(0, 42, 5):
        assert m.count(t) == (v == t).sum() and m.count(t, n // 4, n // 2) == (v[n // 4 : n // 2] == t).sum()
        assert [m.select(t, k) for k in range(m.count(t))] == np.flatnonzero(v == t).tolist()
    with pytest.raises(IndexError):
        m.select(41, 0)


# 6 URLs


def test_url_verdicts(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "http://x.example.net/de/", "ftp://example.com/de/1", "https://h.org/fr/", "https://h.org?x/fr/", "nothing", None, "http://net", "http://evil.com/a", "http://good.com/a", "x://", "://q.org/fr/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://{'evil' if i % 2 else 'good'}.com/{i}") for i in range(200)], "page_id long, url string")
    outcomes = spark.createDataFrame([(100 + i, 1 - i % 2) for i in range(200)] + [(100, None)], "page_id long, outcome int")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, outcomes, url_filter.RULES).collect()}
    assert len(got) == 212
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[1].rule, got[1].verdict) == ("net/", "block") and (got[2].rule, got[2].verdict) == ("example.com/de/", "block") and got[3].rule == "org/fr/"
    assert (got[4].host, got[4].path, got[4].rule) == ("h.org", "", None) and (got[5].host, got[5].path) == (got[6].host, got[6].path) == ("", "")
    assert got[7].rule is None and got[8].verdict == "block" and got[9].verdict == "allow" and got[11].rule == "org/fr/"
    assert url_filter.url_verdicts(pages.limit(0), outcomes, url_filter.RULES).count() == 0
    con = duckdb.connect()
    p, o = pages.toPandas(), outcomes.select(F.col("page_id").alias("doc_id"), F.col("outcome").alias("quality")).toPandas()
    con.register("pages", p)
    con.register("labels", o)
    want = {r[0]: r[4:6] for r in con.execute(f"SELECT page_id, host, path, rule, verdict, lower FROM ({url_filter.ORACLE})").fetchall()}
    assert {k: (r.verdict, r.lower) for k, r in got.items()} == want


def test_host_levels(spark):
    hosts = spark.createDataFrame([("www.shop.co.uk",), ("co.uk",), ("a.xco.uk",), ("www.b.net:8080",), ("",), ("one",)], "host string")
    got = {r.host: (r.domain, r.suffix) for r in url_filter._levels(hosts, url_filter.SUFFIXES).collect()}
    assert got == {"www.shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.xco.uk": ("xco.uk", "uk"), "www.b.net:8080": ("b.net", "net"), "": ("", ""), "one": ("one", "one")}


@pytest.mark.parametrize("a, b", [(2.0, 3.0), (5.0, 3.0), (30.0, 20.0), (600.0, 300.0)])
def test_lower_quantile(spark, a, b):
    x = (np.arange(200_000) + 0.5) / 200_000
    density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log(1 - x))
    exact = x[np.searchsorted(np.cumsum(density) / density.sum(), 0.025)]
    assert abs(spark.range(1).select(url_filter.lower_quantile(F.lit(a), F.lit(b), 1.96)).first()[0] - exact) < 0.02


def test_prior_worth_is_estimated(spark):
    rng = np.random.default_rng(1)
    for worth in (4.0, 50.0):
        rates = rng.beta(0.6 * worth, 0.4 * worth, 600)
        level = spark.createDataFrame([(40, float(rng.binomial(40, r)), 0.6) for r in rates], "n long, good double, above double")
        assert 0.7 * worth < url_filter._worth(level) < 1.4 * worth


# 7 and 10 token ids and counts

ALPHABET = ["a", "B", " ", "  ", "\n", "\t", "é", "É", "\xa0", "\u3000", "İ", "ß", "'s", "'ll", "12", "²", "<|endoftext|>", "...", "\0", "\x1c", "\x85", "Σ", "你好", "🎉", "▁", "_", "-", "word", "The", "\u200b", "\r\n", "|", "\xad", "\ufeff"]


def fuzz(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(25))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_encoding(path):
    e = encoding.encoder(path)
    some = fuzz(3000, 1)
    assert [x for x, y in zip(some, e.encode(some)) if e.whole(x) != y] == []


def test_prefix_bpe(docs, none):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=prefix_bpe.ranks_of(MULTI), special_tokens={})
    t = prefix_bpe.Texts(MULTI, P.PATTERN)
    assert [x for x in fuzz(3000, 2) if t.encode(x) != lib.encode_ordinary(x)] == []
    rng = random.Random(9)
    pieces = ["".join(rng.choice("abc \xe9") for _ in range(rng.randrange(1, 40))).encode() for _ in range(500)]
    assert [p for p in pieces if t.bpe.encode_piece(p) != lib._encode_single_piece(p)] == []
    got = {r.doc_id: r for r in prefix_bpe.token_digests(docs, MULTI, P.PATTERN).collect()}
    for i, x in body(docs):
        if i not in (None, 11):
            ids = lib.encode_ordinary(x)
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())
    back = prefix_bpe.decode_texts(prefix_bpe.encode_texts(docs, MULTI, P.PATTERN), MULTI)
    assert collections.Counter(bytes(r.decoded) for r in back.collect()) == collections.Counter(x.encode() for _, x in body(docs))
    assert prefix_bpe.token_digests(none, MULTI, P.PATTERN).count() == 0


def test_prefix_bpe_appends_and_edits():
    rng = random.Random(1)
    b = prefix_bpe.PrefixBPE(prefix_bpe.ranks_of(MULTI))
    last, start = b.table(b"unbeliev")
    raw = b.append(b"unbeliev", last, start, b"ability")
    assert b.read(last, start) == b.read(*b.table(b"unbelievability"))
    for _ in range(300):
        raw = bytes(rng.choice(b"abetnos 1") for _ in range(rng.randrange(200)))
        last, start = b.table(raw)
        at, put = rng.randrange(len(raw) + 1), bytes(rng.choice(b"abetnos 1") for _ in range(rng.randrange(5)))
        removed = rng.randrange(min(5, len(raw) - at) + 1)
        edited, _ = b.edited(raw, last, start, at, removed, put)
        assert edited == raw[:at] + put + raw[at + removed :] and (last, start) == b.table(edited)
    raw = bytes(rng.choice(b"abetnos") for _ in range(20_000))
    last, start = b.table(raw)
    assert b.edited(raw, last, start, 100, 3, b"xyz")[1] < 200  # the rest is taken over


def test_prefix_bpe_has_the_library_s_classes():
    """Over all code points, also those that are letters to one library and not to the other."""
    import tiktoken

    texts, rng = prefix_bpe.opened(MULTI, P.PATTERN), random.Random(2)
    library = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=prefix_bpe.ranks_of(MULTI), special_tokens={})
    points = [c for c in range(0x32000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50):
        text = "".join(chr(c) + rng.choice(["a", " ", "1", "", "\n", "'s"]) for c in points[k : k + 50])
        assert texts.encode(text) == library.encode_ordinary(text)


def test_token_counts(docs, none, spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    some = spark.createDataFrame([(i, t) for i, t in enumerate(fuzz(800, 4))], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = token_counts.token_counts(some, PIECE, 50).collect()
    want = collections.Counter((i, len(t.encode()), len(lib.encode(t)), len(lib.encode(t)) > 50) for i, t in body(some))
    assert collections.Counter(map(tuple, got)) == want
    assert token_counts.token_counts(none, PIECE).count() == 0


# 8 fingerprints


def canonical(t: str) -> str:
    n = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(n.split())


def test_fingerprints(docs, none, spark):
    rows = fingerprint.fingerprint_report(docs).collect()
    assert len(rows) == docs.count() and fingerprint.fingerprint_report(none).count() == 0
    one = fingerprint.fingerprint_report(docs.filter("doc_id = 3")).first()
    assert (one.n_chars, one.near_next, one.edited_sha256) == (3, 1.0, hashlib.sha256(b"ono").hexdigest())  # it is its own next
    simple = [(i, t) for i, t in sorted(((i, t) for i, t in body(docs) if i is not None and i != 11 and i > 11), key=lambda x: x[0])]
    got = {r.doc_id: r for r in rows}
    for (i, t), (_, nxt) in zip(simple, simple[1:]):
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].near_edited == float(canonical(t) == canonical(edited)) and got[i].near_next == float(canonical(t) == canonical(nxt))
    same = collections.defaultdict(set)
    for i, t in body(docs):
        if i not in (None, 11):
            same[canonical(t)].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values()) and len(set.union(*same.values())) == len(same)


def test_next_documents_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "CELL_ROWS", 3)
    rng = random.Random(6)
    rows = sorted({rng.choice([rng.randrange(50), rng.randrange(10**9)]) for _ in range(120)})
    df = spark.createDataFrame([(i, f"t{i}") for i in rows], "doc_id long, text string").repartition(5)
    got = {r.id: r.next for r in fingerprint.with_next(df).collect()}
    assert got == {i: f"t{j}" for i, j in zip(rows, rows[1:] + rows[:1])}


def test_fingerprints_compare_bytes(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "bucket", lambda c: (F.xxhash64(F.substring(c, 1, 1)), F.lit(7).cast("long")))
    df = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "AB "), (4, "b")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    assert got[1] == got[3] != got[2] and len(set(got.values())) == 3
    again = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint_report(df).collect()}
    assert again == got


# 9 suffixes


def removed(rows: list[tuple]) -> list[tuple]:
    order = lambda i: -1 if i is None else i
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], 10**9), order(i))
    out = []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < order(i):
                gone[p] += 1
                gone[p + 50] -= 1
        c = np.cumsum(gone)[: len(b)] > 0
        kept = np.frombuffer(b, dtype=np.uint8)[~c].tobytes()
        out.append((i, len(b), int(c.sum()), int((np.diff(np.concatenate(([0], c.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs, none, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ROWS", 7)
    got = suffix_dedup.removal_report(docs).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(removed(body(docs)))
    assert suffix_dedup.removal_report(none).count() == 0
    again = suffix_dedup.suffix_dedup(docs.withColumns({"__kept": F.lit("mine"), "__sd_row": F.lit("mine")}))
    assert again.columns[-4:] == ["__n_bytes", "__n_removed", "__n_spans", "___kept"] and {(r["__kept"], r["__sd_row"]) for r in again.collect()} == {("mine", "mine")}
    kept = suffix_dedup.suffix_dedup(docs, as_text=True)
    assert kept.columns[:2] == ["doc_id", "row"] and kept.count() == docs.count()


@pytest.mark.parametrize("seed", range(2))
def test_suffix_dedup_on_overlapping_copies(spark, tmp_path, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abc é") for _ in range(3000))
    rows = []
    for i in range(60):
        a = rng.randrange(2900)
        t = base[a : a + rng.randrange(20, 400)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(80)))
        rows.append((i if i % 9 else i // 2, t + base[: rng.randrange(90)]))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert collections.Counter(map(tuple, suffix_dedup.removal_report(df).collect())) == collections.Counter(removed(body(df)))


def test_loser_trees():
    rng = random.Random(8)
    runs, everything = [], []
    for _ in range(13):
        keys = sorted(bytes(rng.choice(b"ab") for _ in range(suffixes.LENGTH)) if rng.random() < 0.5 else b"a" * 30 + bytes(rng.choice(b"ab") for _ in range(20)) for _ in range(rng.randrange(30)))
        common = lambda a, b: next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        runs.append(([0, *(common(a, b) for a, b in zip(keys, keys[1:]))][: len(keys)], keys))
        everything += keys
    order, shared = suffixes.merge(runs)
    at = [0] * len(runs)
    out = []
    for r in order:
        out.append(runs[r][1][at[r]])
        at[r] += 1
    assert out == sorted(everything)
    assert shared[1:] == [next((i for i in range(50) if a[i] != b[i]), 50) for a, b in zip(out, out[1:])]


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [(i, prose(120), "en", "s", 0) for i in range(150)]
    rows += [(200 + i, rows[i][1].upper() if i % 2 else rows[i][1], "en", "s", 0) for i in range(20)]
    rows += [(300 + i, prose(60) + " idiot clown " + prose(20), "en", "s", 0) for i in range(60)] + [(400, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(300 + i, 0, 1) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        kept.append({r.doc_id for r in docs.collect()})
    tox, exact, near, suffix = kept
    assert not any(300 <= i < 360 for i in tox) and len(set(range(150)) - tox) <= 3 and 400 in tox
    assert exact == {i for i in tox if not (i < 20 and 200 + i in tox)} and near <= exact and len(near) >= len(exact) - 2 and suffix <= near
    pieces = c.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == suffix
