"""Rows on which operators of the third round went wrong."""

import numpy as np

import corpus_pipeline
from listingflow.llm import ann, graph, near_copies


def recall(spark, vectors):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, list_rows=40).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(vectors), 100):
        far = ((vectors - vectors[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(got[q] & set(np.argsort(far, kind="stable")[:10].tolist()))
    return hits / (10 * len(got))


def test_queries_unlike_the_other_vectors_find_their_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 16))[rng.integers(0, 60, 4000)] + 0.1 * rng.normal(size=(4000, 16))
    vectors[::100] = rng.normal(size=(40, 16))
    assert recall(spark, vectors) >= 0.9


def test_vectors_in_far_groups_find_their_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(90, 32))[rng.integers(0, 90, 4000)] + 0.05 * rng.normal(size=(4000, 32))
    assert recall(spark, vectors) >= 0.9


def test_near_copies_meet_at_the_anchors_of_their_fingerprints(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(6):
        words = [f"w{i}" for i in rng.integers(0, 10**6, 300)]
        for _ in range(4):
            texts.append(" ".join(words))
            words[rng.integers(300)] = f"v{rng.integers(10**6)}"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    marked = near_copies._marked(docs)
    sets = [near_copies.shingles(t) for t in texts]
    fps = [near_copies.fingerprint(s) for s in sets]
    assert {r.doc_id: r.fp % 2**64 for r in marked.collect()} == dict(enumerate(fps))
    at = {r.cls: r.doc_id for r in marked.collect()}
    close = {(i, j) for i in range(24) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= near_copies.THRESHOLD}
    found = {at[r.node]: r.component for r in graph.components(near_copies._anchored(marked)).collect()}
    assert close and all(found[i] == found[j] for i, j in close)
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()) == list(range(0, 24, 4))
