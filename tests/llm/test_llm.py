"""The corpus operators against brute force, libraries and odd inputs."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from listingflow.llm import (
    ann, bpe, catalog, graph, language_id, line_dedup, mixing, quality_rules, simhash, token_counts, url_filter, warc,
)

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, LONG + "\nother line", "en", "a", 1), (2, "intro\n" + LONG, "en", "b", 1), (2, "intro\n" + LONG, "en", "b", 1),
    (3, None, None, None, None), (None, "no id " + LONG, "en", None, 3), (4, "", "en", "a", 0), (5, " \t\n ", None, "c", 3),
    (6, "ÀÉ ß <|endoftext|> don't 123 …", "fr", "a", 2), (7, "x" * 200_000, "en", "", 5), (8, "1234 !!", "en", "b", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    return docs.withColumns({c: F.lit("clash") for c in ("size", "fp", "ids", "words", "block", "failed", "score", "order")}) \
        .repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def some(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_tokens_and_ids_are_the_librarys(odd, some, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for docs in (odd, some):
        texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        wanted = [(i, t, library.encode(t, add_special_tokens=False).ids) for i, t in texts]
        key = lambda r: str(r)
        assert sorted(rows(token_counts.token_counts(docs)), key=key) == sorted(
            [(i, len(t.encode()), len(ids), len(ids) > 2048) for i, t, ids in wanted], key=key)
        assert sorted(rows(bpe.round_trip(docs)), key=key) == sorted(
            [(i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
             for i, _, ids in wanted], key=key)
        decoded = bpe.decode(bpe.encode(docs)).collect()
        assert sorted((r.text for r in decoded)) == sorted(library.decode(ids, skip_special_tokens=False) for _, _, ids in wanted)
    assert rows(token_counts.token_counts(empty)) == rows(bpe.round_trip(empty)) == []


def test_overlapping_pairs_merge_from_the_left():
    from listingflow.llm.wordpieces import read_vocabulary
    content = read_vocabulary(None)
    merger, encoder = token_counts.RankMerger(content), bpe.PrefixEncoder(content)
    words = ["a" * n for n in range(1, 80)] + ["ab" * n for n in range(1, 40)] + ["hahah" * 7]
    assert merger.count(words) == [len(encoder.encode(w)) for w in words]


def brute_simhash(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] > label[i]:
                    label[j] = label[i]
                    changed = True
    return label


def test_simhash(odd, some, empty):
    for docs in (odd, some):
        docs = docs.where("coalesce(length(text), 0) < 5000")
        texts = docs.select("doc_id", "text").collect()
        fps = [brute_simhash(r.text) for r in texts]
        groups = defaultdict(list)
        for label, r in zip(brute_components(fps), texts, strict=True):
            groups[label].append(r.doc_id)
        least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
        wanted = [(r.doc_id, f"{fp:016x}", least[label]) for r, fp, label in
                  zip(texts, fps, brute_components(fps), strict=True)]
        got = rows(simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id"))
        assert sorted(got, key=str) == sorted(wanted, key=str)
    assert rows(simhash.near_duplicates(empty)) == []


def test_dense_fingerprints_keep_every_link(spark):
    rng = np.random.default_rng(1)
    fps = set()
    for base in rng.integers(0, 2**63, 5):
        for _ in range(80):
            x = int(base)
            for bit in rng.integers(0, 63, rng.integers(0, 6)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    edges = simhash.link_stars(spark.createDataFrame([(x,) for x in fps], "fp long"), 3, tile=32)
    named = {r.node: r.component for r in graph.components(edges).collect()}
    pairs = set(zip(brute_components(fps), [named.get(x, ("alone", x)) for x in fps], strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, None), (200, 201)], "a long, b long")
    found = defaultdict(set)
    for r in graph.components(edges).collect():
        found[r.component].add(r.node)
    assert sorted(map(sorted, found.values())) == [list(range(61)), [100], [200, 201]]


def test_line_dedup_keeps_the_first_copy(odd, empty):
    got = sorted(rows(line_dedup.dedup_lines(odd).select("doc_id", "text", F.size("removed_runs"))), key=str)
    changed = {(2, "intro\n" + LONG): ("intro", 1)}
    assert got == sorted([(i, *changed.get((i, t), (t, 0))) for i, t, *_ in TEXTS], key=str)
    assert rows(line_dedup.dedup_lines(empty)) == []


def test_line_dedup_runs(spark):
    short = [" ".join(f"{c}{i}" for i in range(20)) for c in "pqrs"]
    docs = [(1, "\n".join([*short, "end"])), (2, "\n".join(["start", short[0], "", *short[1:3], "tail"])),
            (3, "\n".join(short[:2])), (4, "\n".join(short[:3] + ["middle"] + short[:3]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    # 40 words repeat in document 3, fewer than a run; blank lines inside a run go with it.
    assert got == {1: docs[0][1], 2: "start\ntail", 3: docs[2][1], 4: "middle"}


def test_quality_ledger(odd, empty):
    entries = quality_rules.ledger(odd)
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_repeat_words) for r in entries.collect()}
    assert (3, 0, 0, 0) in got and (7, 1, 200_000, 0) in got and (1, 62, 299, 0) not in got and len(rows(entries)) == len(TEXTS)
    kept = quality_rules.apply_policy(entries)
    report = {r.rule: r for r in quality_rules.ablations(entries).collect()}
    assert report["few_words"].failed == kept.where("base_failed").count()
    assert rows(quality_rules.ledger(empty)) == []


def test_repeat_words_by_brute_force(spark, some):
    loops = [(10**6 + i, " ".join(w)) for i, w in enumerate((["a"] * 12, list("abcde") * 2, list("abcdeXabcdeY"), ["a"] * 5))]
    docs = some.select("doc_id", "text").union(spark.createDataFrame(loops, "doc_id long, text string"))
    texts = {r.doc_id: r.text.split() for r in docs.where("length(text) < 4000").collect()}
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measure(docs).collect()}
    for i, words in texts.items():
        places = defaultdict(list)
        for k in range(len(words) - 4):
            places[tuple(words[k:k + 5])].append(k)
        assert got[i] == len({k + d for v in places.values() if len(v) > 1 for k in v for d in range(5)})


def test_url_rules_and_models(spark):
    urls = ["http://a.org/x", "https://ORG/", "http://example.org/es/1", "http://m.Example.org/en/17", "http://x.com/fr/2",
            "http://x.com/de/2?q", "http://notorg/", "http://org", "nothing", "", None, "ftp://b.net#frag/", "http://casino-win.net/en/1"]
    more = [f"http://site{i}.net/en/{i}" for i in range(60)] + [f"http://casino-win.example.net/en/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + more)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    expected = [("a.org", "/x", "org/"), ("org", "/", "org/"), ("example.org", "/es/1", "example.org/es/"),
                ("m.example.org", "/en/17", "example.org/en/1"), ("x.com", "/fr/2", "com/fr/"), ("x.com", "/de/2", "com/de/"),
                ("notorg", "/", None), ("org", "", None), ("", "", None), ("", "", None), ("", "", None), ("b.net", "", None)]
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(12)] == expected
    assert [got[i].verdict for i in (0, 2, 3, 4, 5, 9, 10, 12)] == ["allow", "block", "block", "allow", "block", "block", "block", "block"]
    assert all(got[len(urls) + i].verdict == ("allow" if i < 60 else "block") for i in range(120))
    assert rows(url_filter.judge(pages.limit(0))) == []


def test_markov_models_are_distributions():
    counts = np.bincount(url_filter.grams("http://a.bc/ab"), minlength=url_filter.SYMBOLS ** 4)
    p = np.exp(url_filter.likelihoods(counts.astype(float))).reshape(-1, url_filter.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1)


def test_warc_round_trip(spark):
    tricky = "y" * 120 + "\r\n\r\nWARC/1.1\r\n\r\n"
    pages = spark.createDataFrame([
        (1, "http://b.a/x y", None, "z"), (5, None, tricky, "z"), (3, "q", tricky, "z"), (3, "q", tricky, "z"),
        (None, "q", tricky, "z"), (6, "http://a.a/", "short", "z"), (7, "http://a.a/", "short", "z")],
        "page_id long, url string, html string, digest string")
    got = warc.archive(pages).orderBy("merge_part", "merge_place").collect()
    wanted = {(1, 0, "response", None), (5, 136, "revisit", 3), (3, 136, "response", None), (None, 136, "revisit", 3),
              (6, 5, "response", None), (7, 5, "response", None)}
    assert len(got) == 7 and {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got} == wanted
    assert {r.payload_digest for r in got if r.payload_bytes == 136} == {hashlib.sha256(tricky.encode()).hexdigest()}
    assert [(r.url_key, r.captured_at) for r in got] == sorted((r.url_key, r.captured_at) for r in got)
    assert rows(warc.archive(pages.limit(0))) == []


def test_loser_tree():
    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 7):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 30)).tolist()) for _ in range(k)]
        merged = list(warc.LoserTree([((x,) for x in run) for run in runs]))
        assert merged == sorted((x,) for run in runs for x in run)


def test_mixing(odd, some, empty):
    for docs in (odd, some):
        got = mixing.mix(docs, shards=4, block_words=500).toPandas()
        assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all()
        by = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"), size=("size", "sum"))
        repeats = 2 if docs is odd else 1
        assert ((by.target - by.taken).abs() <= repeats * by.most).all() and (by.target <= 3 * by["size"]).all()
        assert abs(by.target.sum() - got["size"].sum()) < 1e-6
        again = mixing.mix(docs.repartition(5), shards=4, block_words=500).toPandas()
        key = ["doc_id", "source", "size", "taken"]
        assert got[key].sort_values(key).values.astype(str).tolist() == again[key].sort_values(key).values.astype(str).tolist()
    assert rows(mixing.mix(empty)) == rows(mixing.mixed_documents(empty)) == []


def test_splitting_tree_is_exact():
    quotas = np.array([17, 0, 400, 3])
    split = mixing.split_quotas(quotas, 6, np.random.default_rng(3))
    assert (split.sum(axis=0) == quotas).all() and (split >= 0).all() and np.ptp(split.sum(axis=1)) <= 2


def test_targets_stop_and_reshare():
    assert mixing.targets([100, 10, 10], [5, 2, 1]) == [75.0, 30.0, 15.0]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


def test_language_id(odd, some, empty):
    got = language_id.identify(some).toPandas().merge(some.toPandas(), on="doc_id")
    long = got[got.held_out & (got.n_chars > 60)]
    assert (long.lang_pred == long.lang).mean() > 0.97 and got.score.between(0, 1).all()
    judged = {(r.doc_id, r.lang_pred, r.rejected) for r in language_id.identify(odd).collect()}
    assert {(3, "und", True), (4, "und", True), (8, "und", True)} <= judged
    assert rows(language_id.identify(empty)) == rows(language_id.accepted(empty)) == []


def test_ann_recall_and_odd_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = ann.nearest(table, list_rows=40).toPandas()
    ids = table.toPandas().sort_values("vec_id")
    v = np.stack(ids.embedding.to_numpy()).astype(float)
    hits = 0
    for q, found in got.groupby("query_id"):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        hits += len({i for i in np.lexsort((ids.vec_id, d)) if i != q} and set(
            [i for i in np.lexsort((ids.vec_id, d)) if i != q][:10]) & set(found.vec_id))
        assert np.allclose(found.sort_values("rank").score, sorted(d[found.vec_id]), rtol=1e-12)
    assert hits >= 0.9 * len(got) and len(got) == 50
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]),
                                 (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(rows(ann.nearest(odd))) == [(0, 1, 1, 0.0), (0, 2, 8, 0.0), (0, 3, 7, 1.0)]
    assert rows(ann.nearest(odd.limit(0))) == []


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_queries_equal_their_sql(spark, name):
    import oracle
    difference, n = oracle.compare(spark, oracle.connect(SF), catalog.QUERIES[name], catalog.ORACLE[name], SF)
    assert difference is None and n > 0


def test_pipeline_stages(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).cache()
            docs.count()
    ids = [r.doc_id for r in corpus_pipeline.dedup_near(spark, odd, SF).collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8] and ids.count(None) == 1
