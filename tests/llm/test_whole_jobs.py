"""What the corpus operators once left out, against brute force."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from listingflow.llm.common import DOCUMENT_COLUMNS


def documents(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return docs.withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.length("text").cast("long")}) \
        .select(*DOCUMENT_COLUMNS)


def least_reached(edges, n):
    """The least node that each of ``n`` nodes reaches."""
    label = list(range(n))
    for i, j in edges:
        a, b = sorted((label[i], label[j]))
        label = [a if x == b else x for x in label]
    return label


def test_near_copies_are_what_five_word_shingles_say(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        words = [f"w{i}" for i in rng.integers(0, 10**6, 220)]
        for changes in (0, 0, 1, 2, 3, 4, 5, 6, 8):  # similarities of 1 to about 0.69
            copy = list(words)
            for at in rng.choice(220, changes, replace=False):
                copy[at] = f"v{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    sets = [{tuple(t.split()[k:k + 5]) for k in range(216)} for t in texts]
    wanted = least_reached([(i, j) for i in range(len(sets)) for j in range(i)
                            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])], len(sets))
    docs = documents(spark, list(enumerate(texts)))
    got = sorted(r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect())
    assert got == sorted(set(wanted)) and 12 < len(got) < len(texts)
    from listingflow.llm import near_copies
    # Clusters cut into chunks give the same.
    assert sorted(r.doc_id for r in near_copies.keep_one(docs, chunk=4).collect()) == got


def brute_runs(docs, min_words=50):
    """Lines of each document in a run of enough words that occurs at an earlier place."""
    lines = [(d, k, x) for d, t in docs for k, x in enumerate(t.split("\n"))]
    gone = set()
    for at in range(len(lines)):
        for before in range(at):
            n, words = 0, 0
            while at + n < len(lines) and lines[at + n][0] == lines[at][0] and lines[before + n][0] == lines[before][0] \
                    and lines[at + n][2] == lines[before + n][2]:
                words += len(lines[at + n][2].split())
                n += 1
            if words >= min_words:
                gone |= {lines[at + k][:2] for k in range(n)}
    return gone


def test_repeated_runs_are_maximal(spark):
    rng = np.random.default_rng(4)
    pool = [" ".join(f"l{i}w{k}" for k in range(n)) for i, n in enumerate([60, 10, 45, 55, 20, 1, 1, 3, 30, 49, 50, 7])]
    docs = [(1, "\n".join([pool[0], pool[1], "a"])), (2, "\n".join(["x", pool[0], pool[1], "y"])),
            (3, "\n".join(["b", *pool[2:8]])), (4, "\n".join([*pool[2:8], "c"]))]
    docs += [(i, "\n".join(pool[k] for k in rng.integers(0, len(pool), 9) // 3 * 3 + rng.integers(0, 2, 9))) for i in range(5, 25)]
    docs += [(i, "\n".join(pool[(s + k) % 12] for k in range(8))) for i, s in enumerate(rng.integers(0, 12, 15), 25)]
    gone = brute_runs(docs)
    wanted = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in docs}
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, documents(spark, docs), "").collect()}
    assert got == wanted and (got[2], got[4]) == ("x\ny", "c")


def test_every_group_keeps_a_document_if_ids_repeat(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = documents(spark, [(1, one), (1, one), (1, two), (2, one + " end"), (3, two + " end")])
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.dedup_near(spark, docs, "").collect())
    assert got == [(1, one), (1, two)]


def test_every_language_is_learned_however_many_there_are(spark):
    from listingflow.llm import language_id
    n = 1700
    texts = spark.range(3 * n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text of "), F.col("id")).alias("text"),
        F.concat(F.lit("l"), F.col("id") % n).alias("lang"))
    learned = texts.where(~language_id.held_out(F.col("doc_id"))).select("lang").distinct().count()
    model = language_id.fit(texts, dimensions=16)
    assert len(set(model.owner.tolist())) == len(model.languages) == learned > 1600


def test_the_pipeline_equals_its_stages_by_brute_force(spark):
    """Languages judged text by text, runs and near copies by comparing all pairs, draws as the mix has them, ids by the library."""
    import hashlib
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    from listingflow.llm import language_id, mixing
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(table)
    docs = {r.doc_id: r for r in table.collect() if not model.judge(r.text)[2]}
    gone = brute_runs(sorted((d, "\n".join(x.strip(" \t\n\x0b\x0c\r") for x in r.text.split("\n"))) for d, r in docs.items()))
    texts = {}
    for d, r in docs.items():
        lines = r.text.split("\n")
        deleted = [(d, k) in gone for k in range(len(lines))]
        for k, line in enumerate(lines):  # blank lines between deleted ones go with them
            if not line.strip() and any(deleted[:k]) and any(deleted[k + 1:]):
                before = next(j for j in range(k - 1, -1, -1) if lines[j].strip())
                after = next((j for j in range(k + 1, len(lines)) if lines[j].strip()), None)
                deleted[k] = deleted[before] and after is not None and deleted[after]
        texts[d] = "\n".join(x for x, out in zip(lines, deleted, strict=True) if not out)
    ids = sorted(texts)
    words = [texts[d].encode().lower().split() for d in ids]
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = least_reached([(i, j) for i in range(len(ids)) for j in range(i) if sets[i] == sets[j]
                           or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0], len(ids))
    kept = [d for i, d in enumerate(ids) if label[i] == i]
    left = spark.createDataFrame([(d, texts[d], docs[d].lang, docs[d].source, len(texts[d])) for d in kept], table.schema)
    copies = {r.doc_id: len(r.shards) for r in mixing.mix(left).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter()
    for d in kept:
        found = library.encode(texts[d], add_special_tokens=False).ids
        wanted[d, len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()] += copies[d]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +wanted and len(kept) < len(docs) < table.count() + 1
