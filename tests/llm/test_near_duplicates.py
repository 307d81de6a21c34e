"""Near duplicates that a filter, a window or a range cut could lose, against brute force."""

import random

import numpy as np

from tests_llm_plain import jaccard_classes
from tidemark.llm import near_duplicates


def classes_of(spark, texts, partitions=4):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(partitions)
    got = dict(near_duplicates.near_duplicate_classes(df).collect())
    return [got[i] for i in range(len(texts))]


def test_copies_that_repeat_passages_differently(spark):
    rng = random.Random(11)
    texts = []
    for k in range(60):
        base = [f"w{k}x{i}" for i in range(304)]
        other = base.copy()
        if k % 2:
            for i in range(4):
                other[30 + 60 * i] = "edited"
        passage = base[: 75 if k % 2 else 150]
        texts += [" ".join(base), " ".join(other + passage * rng.choice((9, 20, 40)))]
    want = jaccard_classes(texts)
    assert want == [i - i % 2 for i in range(len(texts))]
    assert classes_of(spark, texts) == want


def template_pairs(n):
    """Texts that share a template, 0.72 alike and so in the same buckets, and a copy of each, 0.81 alike."""
    base = [f"t{i}" for i in range(264)]
    texts = [base + [f"own{k}x{i}" for i in range(50)] for k in range(n)]
    texts += [t[:-30] + [f"new{k}x{i}" for i in range(30)] for k, t in enumerate(texts)]
    return [" ".join(t) for t in texts]


def test_links_in_a_bucket_larger_than_the_window(spark, monkeypatch):
    # A window of one and blocks of fifty stand for buckets that are many times larger than either.
    monkeypatch.setattr(near_duplicates, "BEFORE", 1)
    monkeypatch.setattr(near_duplicates, "BLOCK", 50, raising=False)
    texts = template_pairs(200)
    want = jaccard_classes(texts)
    assert want == [i % 200 for i in range(400)]
    assert classes_of(spark, texts) == want


def test_a_bucket_that_is_cut(spark):
    # More tasks than rows: each row of a sorted bucket has a task to itself.
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    try:
        assert classes_of(spark, template_pairs(1)) == [0, 0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pairs_at_the_threshold_with_low_estimates(spark):
    # Of many pairs at 0.8, those that share a band and whose signatures agree least.
    pairs = []
    for k in range(1500):
        base = [f"p{k}x{i}" for i in range(184)]
        pairs.append((" ".join(base), " ".join(base[:-20] + [f"q{k}x{i}" for i in range(20)])))
    text, shingle, count, _ = near_duplicates.shingles([t for p in pairs for t in p])
    signed = near_duplicates.signatures(text, shingle, np.ones_like(count), 2 * len(pairs)).reshape(len(pairs), 2, -1)
    same = signed[:, 0] == signed[:, 1]
    banded = same[:, : near_duplicates.BANDS * near_duplicates.ROWS].reshape(len(pairs), near_duplicates.BANDS, -1).all(2).any(1)
    lowest = [k for k in np.argsort(same.mean(1)).tolist() if banded[k]][:6]
    assert same.mean(1)[lowest].max() < 0.735
    assert classes_of(spark, [t for k in lowest for t in pairs[k]]) == [i - i % 2 for i in range(12)]


def test_both_texts_of_an_id_keep_their_links(spark):
    x, y = (" ".join(f"{name}{i}" for i in range(200)) for name in "xy")
    rows = [(1, x), (1, y), (2, x + " more"), (3, y + " more"), (5, "alone " + " ".join(map(str, range(40)))), (1, x), (5, y + " other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id, r.class_id) for r in near_duplicates.near_duplicate_classes(df).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (5, 1), (5, 5)]


def test_one_row_of_each_class_stays(spark):
    x, y, z = (" ".join(f"{name}{i}" for i in range(200)) for name in "xyz")
    rows = [(7, x, "a", 1), (7, y, "b", 2), (3, x + " more", "c", 3), (3, x + " more", "d", 4), (9, z, "e", 5), (9, z, "e", 5), (9, z + " more", "f", 6), (None, z, "g", 7), (None, None, None, None), (11, "", "h", 8), (12, None, "i", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, mark string, copies int").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in near_duplicates.first_of_each_class(df).collect()), key=repr)
    first = z if near_duplicates.digest(z.encode()) < near_duplicates.digest((z + " more").encode()) else z + " more"
    assert got == sorted([(7, y), (3, x + " more"), (9, first), (None, z), (None, None), (11, ""), (12, None)], key=repr)
    assert near_duplicates.first_of_each_class(df).columns == df.columns
    assert near_duplicates.first_of_each_class(df.limit(0)).count() == 0


def test_links_of_any_shape_make_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1200)] + [(2000 + rng.randrange(400), 2000 + rng.randrange(400)) for _ in range(350)]
    rng.shuffle(links)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert dict(near_duplicates.components(df).collect()) == {x: root(x) for x in parent}
    assert near_duplicates.components(df.limit(0)).count() == 0


def test_a_group_of_near_copies_brings_a_link_for_each_node(spark):
    rng = random.Random(12)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for k in range(300):
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(300)] = f"e{k}x{rng.randrange(9999)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = near_duplicates.document_rows(near_duplicates.marked(df))
    signed = near_duplicates.staged(rows.withColumnRenamed("doc_id", "node"), "test").select("node", "signature")
    pairs = near_duplicates.matches(near_duplicates.bucket_mates(signed), signed, 0.7).collect()
    assert 290 <= len(pairs) == len({p.b for p in pairs}) < 300 and all(p.a < p.b for p in pairs)
    assert classes_of(spark, texts) == [0] * 300
