"""Whitening, sharding and the conversation trie against brute force and odd inputs."""

import hashlib
import inspect
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingflow.llm import (
    ann, bpe, common, conversation_trie, graph, language_id, line_dedup, mixing, near_copies, quality_rules, sharding, simhash,
    token_counts, url_filter, warc, whitening, wordpieces,
)

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- whitening -------------------------------------------------------------------------------------------

def brute_whitening(vectors, components):
    x = np.floor(np.asarray(vectors, float) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    covariance = centred.T @ centred / n
    values, found = np.linalg.eigh(covariance)
    values, found = values[::-1][:components], found[:, ::-1][:, :components]
    return (centred @ found) / np.sqrt(values), values / np.trace(covariance), ((n * x - sums) ** 2).sum(axis=1)


def test_whitening_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    plain = table.toPandas().sort_values("vec_id")
    white, explained, deviation = brute_whitening(np.stack(plain.embedding.to_numpy()), 32)
    clash = table.withColumns({c: F.lit("clash") for c in ("v", "n", "part", "d", "component", "whitened", "first")})
    for docs in (table.repartition(70), clash):  # more tasks than one round combines
        got = whitening.whiten(docs).toPandas().sort_values(["vec_id", "component"])
        assert len(got) == white.size and (got.n == len(plain)).all() and (got.identity_error < 1e-9).all()
        found = got.whitened.to_numpy().reshape(white.shape)
        assert np.allclose(found * np.sign((found * white).sum(axis=0)), white, atol=1e-8)
        assert (got.deviation.to_numpy().reshape(white.shape) == deviation[:, None]).all()
        assert np.allclose(got.explained.to_numpy()[:32], explained, rtol=1e-9)


def test_rank_one_updates_add_up():
    rng = np.random.default_rng(0)
    for d in (1, 2, 7, 40):
        values, vectors, wanted = np.zeros(d), np.eye(d), np.zeros((d, d))
        for i in range(80):
            v = np.eye(d)[i % d] if i % 5 == 0 else rng.normal(size=d) * (1e-9, 1.0, 1e4)[i % 3]
            values, vectors = whitening.rank_one(values, vectors, v)
            wanted += np.outer(v, v)
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13 * d
        assert np.abs(vectors * values @ vectors.T - wanted).max() <= 1e-13 * d * np.abs(wanted).max()


def test_spectra_combine_to_that_of_all_rows():
    x = (np.random.default_rng(1).normal(size=(900, 6)) * 200).astype(np.int64) + 1_000_000
    whole = whitening.Spectrum.empty(6)
    for part in np.array_split(x, [1, 3, 400, 401]):
        one = whitening.Spectrum.empty(6)
        for block in np.array_split(part, 2):
            if len(block):
                one.add_rows(block)
        whole.add(one)
    centred = x - x.mean(axis=0)
    assert whole.n == 900 and whole.sums == x.sum(axis=0).tolist()
    assert np.allclose(whole.values, np.linalg.eigvalsh(centred.T @ centred), rtol=1e-9)


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, [0.0, 1.0, 5.0]), (1, [0.0, 1.0, 5.0]), (2, [2.0, 1.0, 5.0]), (None, [0.5, 3.0, 5.0]), (3, None), (4, [nan, 1.0, 2.0]),
           (5, [1.0, None, 2.0]), (6, [inf, 1.0, 2.0]), (7, [1.0, 2.0]), (8, []), (9, [1e300, 0.0, 0.0])]
    table = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got = whitening.whiten(table).toPandas()
    white, explained, deviation = brute_whitening([odd[i][1] for i in (0, 1, 2, 3)], 2)  # one dimension does not vary
    assert len(got) == 8 and sorted(got.vec_id.fillna(-1)) == [-1, -1, 1, 1, 1, 1, 2, 2] and (got.n == 4).all()
    assert sorted(got.deviation) == sorted(np.repeat(deviation, 2)) and np.allclose(sorted(np.abs(got.whitened)), sorted(np.abs(white).ravel()))
    assert np.allclose(sorted(set(got.explained)), sorted(explained))
    assert rows(whitening.whiten(table.limit(0))) == rows(whitening.whiten(table.where("vec_id = 1"))) == []
    wide = spark.createDataFrame([(i, [float(i) * 2.0 ** 36, 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whiten(wide).collect()] == [None] * 4  # beyond a long


# --- sharding -----------------------------------------------------------------------------------------

def check_shards(docs, got, shards=8):
    wanted = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == wanted
    places = {}
    for r in got:
        places.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return [sum(r.size for r in got if r.shard == s) for s in range(shards)]


def test_shards_have_near_equal_bytes_and_places_without_gaps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    got = sharding.shard(docs.repartition(5)).collect()
    total = check_shards(plain, got)
    assert max(total) - min(total) <= max(len((t or "").encode()) + 1 for _, t in plain)
    again = sharding.shard(docs).collect()
    assert {r.doc_id: r.shard for r in got} == {r.doc_id: r.shard for r in again}


def test_sharding_of_odd_rows(spark):
    odd = [(1, "ä" * 10), (1, "ä" * 10), (2, None), (None, "x"), (None, "y"), (None, None), (3, ""), (4, "z" * 300_000)] + [(5, "copy")] * 40
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("size", "part", "shard", "slot", "n", "at", "before", "virtual_slot", "bytes", "law")})
    got = sharding.shard(docs.repartition(7)).collect()
    check_shards(odd, got)
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert rows(sharding.shard(docs.limit(0))) == []


def test_maps_are_edited_little_and_kept(spark, tmp_path):
    rng = np.random.default_rng(2)
    load = (rng.pareto(1.5, 512) * 1000).astype(int).tolist()
    first = sharding.first_map(512, 8)
    edited = sharding.rebalanced(first, load)

    def total(shard_of, n):
        return [sum(x for x, s in zip(load, shard_of, strict=True) if s == k) for k in range(n)]

    assert max(total(edited, 8)) <= max(sum(load) / 8 * 1.001 + 1, max(load)) and sharding.rebalanced(edited, load) == edited
    assert sum(a != b for a, b in zip(first, edited, strict=True)) < 512 * 7 // 8
    more = sharding.grown(edited, load, 8)
    moved = [k for k in range(512) if more[k] != edited[k]]
    assert moved and all(more[k] == 8 for k in moved) and abs(total(more, 9)[8] - sum(load) / 9) <= max(load)
    path = str(tmp_path / "map")
    sharding.write_map(spark, path, edited, 1)
    sharding.write_map(spark, path, more, 2)
    assert sharding.read_map(spark, path, 1) == edited and sharding.read_map(spark, path, 2) == more
    assert sharding.rebalanced([0, 0, 0], [0, 0, 0], 2) == [0, 0, 0] and sharding.grown([0, 0], [0, 0], 1) == [0, 0]


# --- conversations ------------------------------------------------------------------------------------

def brute_trie(conversations):
    """Every node's row, from (conv_id, turn, role, text) rows whose turns are unique in a conversation."""
    turns = defaultdict(list)
    for c, turn, role, text in conversations:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [t[2:] for t in sorted(found)] for c, found in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(plain.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    found = {}
    for node in sorted(members, key=len, reverse=True):
        below = [found[k] for k in kids[node]]
        words = len(node[-1][1].split()) if node else 0
        found[node] = (min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below),
                       sum(b[5] for b in below) or 1, sum(b[6] for b in below) + (len(members[node]) - 1) * words,
                       hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
    return sorted(found.values(), key=str)


def some_conversations(seed, n, longest, kinds):
    rng = np.random.default_rng(seed)
    return [(int(c), int(t) if t else None, ("user", None, "")[int(rng.integers(3))] if kinds > 2 else "user",
             (f"word {k} of it" if k else None)) for c in rng.choice(5 * n, n, replace=False)
            for t, k in enumerate(rng.integers(0, kinds, rng.integers(1, longest)))]


def test_conversation_trie_equals_brute_force(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same = [(c, t, "user", f"turn {t}") for c in range(100, 340) for t in range(1, 5)]
    schema = "conv_id long, turn long, role string, text string"
    for rows_, options in ((real, {}), (some_conversations(1, 150, 6, 2), {"segment": 3, "block": 40, "fan": 2}),
                           (some_conversations(2, 60, 30, 2), {"segment": 4, "block": 10, "fan": 3}),
                           (some_conversations(3, 200, 4, 4), {"block": 5}), (same, {"segment": 2, "block": 30, "fan": 2})):
        table = spark.createDataFrame(rows_, schema).repartition(9)
        got = rows(conversation_trie.trie(table, **options))
        assert sorted(got, key=str) == brute_trie(rows_)


def test_contracted_ranges_merge_to_the_same_trie():
    rng = np.random.default_rng(5)
    sequences = sorted((bytes(rng.integers(0, 2, rng.integers(0, 7)).repeat(16).astype(np.uint8)), c) for c in range(300))
    items = [{"root": b"r", "keys": k, "words": [1] * (len(k) // 16), "next": None, "ends": True, "conv_id": c, "kids": 0,
              "leaves": 0, "saved": 0} for k, c in sequences]

    def read(rows_):
        return [conversation_trie._read_row(r) for r in rows_]

    def key(nodes):
        return sorted((r["depth"], r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in nodes)

    whole, _, _ = conversation_trie.contract(read(items), 99, 0, False)
    for cuts in ([150], [1, 2, 3], sorted(rng.choice(299, 60, replace=False) + 1)):
        found, left = [], []
        for part in np.split(np.arange(300), cuts):
            nodes, _, paths = conversation_trie.contract(read([items[i] for i in part]), 99, 0, True)
            found += nodes
            left += [conversation_trie._read_path(conversation_trie._path_row(p, 0, 0)) for p in paths]
        nodes, _, left = conversation_trie.contract(left, 99, 0, False)
        assert key(found + nodes) == key(whole) and left == []


def test_conversation_trie_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    odd = [(None, 0, "user", "no conversation"), (7, None, None, None), (7, 3, "user", "x " * 50_000), (9, 1, "", ""), (-5, 1, "a", "b"),
           (27, 1, "user", "alone"), (60, 0, "user", "x"), (61, 0, "user", "x"), (62, 0, "user", "x"), (63, 0, "user", "x")]
    table = spark.createDataFrame(odd, schema)
    clash = table.withColumns({c: F.lit("clash") for c in ("digest", "words", "tie", "part", "n", "base", "skip", "borrowed", "total",
                                                            "place", "at", "level", "root", "keys", "next", "ends", "id", "kind")})
    wanted = [r for r in odd if r[0] != -5]
    assert sorted(rows(conversation_trie.trie(clash.where("conv_id <> -5 or conv_id is null"))), key=str) == brute_trie(wanted)
    twice = conversation_trie.trie(spark.createDataFrame([(1, 0, "u", "a"), (1, 0, "u", "a")], schema)).collect()
    assert max(r.depth for r in twice) <= 2 and all(r.conv_id == 1 for r in twice)
    below = {(r.depth, r.conv_id): r.n_convs for r in conversation_trie.trie(table).collect()}
    assert below[0, -5] == 8  # ids below zero are members too
    assert rows(conversation_trie.trie(table.limit(0))) == rows(conversation_trie.trie(table.where("conv_id is null"))) == []


# --- extra columns, no labels, long texts -------------------------------------------------------------------

def names_inside(*modules):
    """Every name in quotes in the modules' code that may be a column's."""
    found = set()
    for module in modules:
        found |= set(re.findall(r"[\"']([a-z][a-z_0-9]*)[\"'.]", inspect.getsource(module)))
    return found


OPERATORS = {
    "op1": (line_dedup.dedup_lines, "documents", (line_dedup,), {"removed_runs"}),
    "op2": (url_filter.judge, "pages", (url_filter,), set()),
    "op3": (token_counts.token_counts, "documents", (token_counts, wordpieces), set()),
    "op4": (simhash.near_duplicates, "documents", (simhash, graph), set()),
    "op5": (quality_rules.ledger, "documents", (quality_rules,), set()),
    "op6": (warc.archive, "pages", (warc,), set()),
    "op7": (mixing.mix, "documents", (mixing,), set()),
    "op8": (language_id.identify, "documents", (language_id,), set()),
    "op9": (ann.nearest, "embeddings", (ann,), set()),
    "op10": (bpe.round_trip, "documents", (bpe, wordpieces), set()),
    "op11": (conversation_trie.trie, "conversations", (conversation_trie,), set()),
    "op12": (whitening.whiten, "embeddings", (whitening,), set()),
    "op13": (sharding.shard, "documents", (sharding,), set()),
    "accepted": (language_id.accepted, "documents", (language_id,), set()),
    "mixed": (mixing.mixed_documents, "documents", (mixing,), set()),
    "near": (near_copies.keep_one, "documents", (near_copies, graph), set()),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_column_name_clashes(spark, name):
    operator, table, modules, replaced = OPERATORS[name]
    plain = spark.read.parquet(f"{SF}/{table}.parquet").limit(60).repartition(3).cache()
    extra = sorted(names_inside(*modules, common) - set(plain.columns))
    clash = plain.withColumns({c: F.lit("clash") for c in extra})
    wanted, got = operator(plain), operator(clash)
    # Where a record lies in an archive and the sign of a component may differ.
    columns = [c for c in wanted.columns if c not in {"whitened", "identity_error"}][:6 if name == "op6" else None]
    assert sorted(map(repr, rows(got.select(*columns)))) == sorted(map(repr, rows(wanted.select(*columns))))
    if len(got.columns) > len(wanted.columns):  # those that give the rows back
        assert set(extra) - replaced <= set(got.columns) and got.select("clash" if "clash" in extra else extra[0]).distinct().count() == 1


def test_every_document_is_accepted_if_no_language_is_known(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert language_id.accepted(docs).count() == docs.count()
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs).collect()} == {("und", 0.0)}


def test_features_do_not_depend_on_blocks():
    rng = np.random.default_rng(0)
    texts = ["", "a", "  a ", "..", "Ab cd!! ef", "x" * 99, "".join(map(chr, rng.choice([32, 65, 98, 233, 1055, 46, 10, 0x4E2D, 0x1F600], 3000)))]
    for text in texts:
        whole = language_id.features(text)
        assert all((language_id.features(text, block=b) == whole).all() for b in (1, 2, 3, 50))
    spaced = " " + re.sub(r"[^a-z]+", " ", "some text  of words") + " "
    assert language_id.features("some text  of words").sum() == sum(len(spaced) - n for n in range(3))


# --- URL models and mixing by brute force ---------------------------------------------------------------------

def brute_probabilities(urls):
    """(context, symbol) -> probability by Witten-Bell interpolation of contexts of 0 to 3 symbols."""
    counts = [defaultdict(lambda: defaultdict(int)) for _ in range(4)]
    for url in urls:
        s = url_filter.symbols(url).tolist()
        for i in range(3, len(s)):
            for k in range(4):
                counts[k][tuple(s[i - k:i])][s[i]] += 1

    def p(context, symbol):
        below = 1 / url_filter.SYMBOLS
        for k in range(4):
            seen = counts[k].get(tuple(context[3 - k:]), {})
            kinds = max(len(seen), 1)
            below = (seen.get(symbol, 0) + kinds * below) / (sum(seen.values()) + kinds)
        return below

    return p


def test_url_scores_and_threshold_equal_brute_force(spark):
    urls = [f"http://site{i}.net/en/{i}" for i in range(40)] + [f"https://poker-{i % 7}.example.net/p{i}" for i in range(40)] \
        + [f"http://downloads{i}.net/x" for i in range(5)] + ["http://a.org/es", "http://x.com/de/1"] * 3
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def label(url):
        host = url.split("://")[1].split("/")[0]
        return int(not (url.startswith("http://x.com/de/") or "poker" in re.split("[.-]", host)))

    learned = {k: [u for u in urls if label(u) == k and zlib.crc32(u.encode()) % 5] for k in (0, 1)}
    models = {k: brute_probabilities(v) for k, v in learned.items()}

    def score(url):
        s = url_filter.symbols(url).tolist()
        ratios = [np.log(models[1](s[i - 3:i], s[i])) - np.log(models[0](s[i - 3:i], s[i])) for i in range(3, len(s))]
        return sum(ratios) / len(ratios)

    wanted = {i: score(u) for i, u in enumerate(urls)}
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert all(abs(got[i].score - w) < 1e-5 for i, w in wanted.items())
    held = [(wanted[i], label(u)) for i, u in enumerate(urls) if zlib.crc32(u.encode()) % 5 == 0]
    model = url_filter.fit(pages)

    def right(t):
        return sum(sum((s >= t) == k for s, x in held if x == k) / sum(x == k for _, x in held) for k in (0, 1))

    best = max(right(t) for t in np.arange(-400, 400) / 64)
    assert right(model.threshold) == pytest.approx(best) and 2 - right(model.threshold) == pytest.approx(model.false_block + model.false_allow)
    assert {r.false_block for r in got.values()} == {model.false_block}
    only = url_filter.fit(pages, rejected=("poker",), accepted=("net",), unjudged_accepted=False)
    assert np.isfinite(only.ratio).all() and only.false_block is not None


def test_the_mix_equals_brute_force(spark):
    """Whole passes over a source, and of the rest whole blocks in their order and the cut block up to the nearest document."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    blank = spark.createDataFrame([(10_000 + i, " ", "blank") for i in range(1500)], "doc_id long, text string, source string")
    docs = docs.union(blank).repartition(4)
    made = mixing.plan(docs, shards=4, block_words=300)
    placed = made.docs.collect()
    assert max(sum(1 for r in placed if (r.source, r.block) == k) for k in {(r.source, r.block) for r in placed}) <= 700
    shares = {s.source: s for s in made.shares}
    got = {r.doc_id: r for r in mixing.mix(docs, shards=4, block_words=300).collect()}
    for source, share in shares.items():
        own = [r for r in placed if r.source == source]
        words = defaultdict(int)
        for r in own:
            words[r.block] += r["size"]
        place = {r.block: (r.block, None) for r in own}
        drawn = {r.block: r for r in made.blocks.where(F.col("source") == source).collect()}
        left, taken = share.rest, 0
        assert set(drawn) == set(place)
        for block in drawn:
            part = drawn[block]["part"]
            members = sorted((r for r in own if r.block == block), key=lambda r: (r.order, r.doc_id))
            reached = 0
            for r in members:
                reached += r["size"]
                extra = part == words[block] and part > 0 or 0 < part < words[block] and 2 * reached - r["size"] <= 2 * part
                assert got[r.doc_id].taken == r["size"] * (share.passes + extra)
                taken += got[r.doc_id].taken
            left -= part
        assert left == 0 and sum(0 < drawn[b]["part"] < words[b] for b in drawn) <= 1
        assert abs(taken - share.target) <= max((r["size"] for r in own), default=0) / 2 + 1
    mixed = mixing.mixed_documents(docs, shards=4, block_words=300)
    copies = defaultdict(int)
    for r in mixed.select("doc_id").collect():
        copies[r.doc_id] += 1
    assert copies == {i: len(r.shards) for i, r in got.items() if r.shards}


def test_archive_files_are_bounded_by_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", "x" * n) for i, n in enumerate([10, 200_000, 2_000_000, 30, 17_000_000, 300_000] + [50] * 30)],
                                  "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    got = {r.page_id: r.payload_bytes for r in warc.read_archives(spark, path).collect()}
    assert got == {r.page_id: len(r.html) for r in pages.collect()} and len(sizes) > 4
    assert sorted(sizes)[-1] < 17_100_000 and sorted(sizes)[-2] < 2_100_000
