"""Text operators: exactness against the tokenisers' own libraries and brute force, and odd tables for each of them."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_plain import best_fit_decreasing, jaccard_classes, rounds
from tidemark.llm import language_id, near_duplicates, packing, quality_model, quality_rules, toxicity, vector_search, warc
from tidemark.llm.byte_bpe import ByteCodec, round_trip
from tidemark.llm.common import PairTable, salted_lookup
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.token_counts import PieceCounter, token_counts

tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string, length string"
ODD_TEXTS = [None, "", " ", "\n\n", "a", "Ünïcödé  wörds\tand tabs", "x" * 3000, "one two three four five six seven eight nine ten eleven", "same words here " * 40, "日本語 テキスト 漢字", "<s> </s> <|endoftext|> <unk>", "a\x00b\x1cc\x85d\xa0e", "😀😀 é́ İstanbul ΑΣ"]
LETTERS = "ab e▁ \n\t.,=-thinerΩ日́'s\x1c\x85\xa0İſß1²"


def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, a repeated id, and columns with clashing names."""
    rows = [(i, t, None if i % 2 else "en", None, None, "s", "k", "l") for i, t in enumerate(ODD_TEXTS)]
    rows += [(7, ODD_TEXTS[7], "en", "src", 5, None, None, None), (None, "no id at all in this row of text, none", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 120))) for _ in range(n)]


def some_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- tokenisers


def test_piece_counts_equal_the_library():
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    texts = [t or "" for t in ODD_TEXTS] + random_texts(800) + ["a" * 4001, " " * 333, "ab" * 2000]
    ref = SentencePieceProcessor(model_file=path)
    assert PieceCounter(path).counts(texts) == [len(x) for x in ref.encode(texts)]


def test_byte_ids_equal_the_library_and_decode():
    import tiktoken

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = ByteCodec(ranks, tokenizers.PATTERN)
    texts = [t or "" for t in ODD_TEXTS] + random_texts(800, 2)
    got = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ref.encode_ordinary(t) for t in texts]
    assert [codec.decode(x) for x in got] == [t.encode() for t in texts]


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    ref = Tokenizer.from_file(path)
    texts = [t or "" for t in ODD_TEXTS] + random_texts(800, 3) + random_texts(300, 4)
    want = [x.ids for x in ref.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(path).encode(texts)] == want


def test_pair_table_finds_all_and_only_its_pairs():
    r = random.Random(3)
    pairs = {(r.randrange(500), r.randrange(500)): (k, k + 7) for k in range(3000)}
    table = PairTable(pairs)
    left, right = np.meshgrid(np.arange(500), np.arange(500))
    at = table.find(left.ravel(), right.ravel())
    got = {(a, b): (int(x), int(y)) for a, b, x, y in zip(left.ravel().tolist(), right.ravel().tolist(), table.rank[at], table.merged[at], strict=True) if x != PairTable.MISS}
    assert got == pairs


def test_token_queries_keep_every_row(spark):
    df = odd_docs(spark)
    got = token_counts(df, tokenizer_path("piece_bpe_32k.model"), 100).collect()
    assert len(got) == df.count() and {(r.n_bytes, r.n_tokens) for r in got if r.doc_id in (0, 1)} == {(0, 0)}
    assert any(r.over_limit for r in got) and sum(r.doc_id is None for r in got) == 1
    trip = {r.doc_id: r for r in round_trip(df, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).collect()}
    assert trip[0].n_tokens == 0 and trip[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(trip[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(ODD_TEXTS))
    assert token_counts(no_docs(spark), tokenizer_path("piece_bpe_32k.model")).count() == 0


# --- packing


def test_rounds_pack_as_well_as_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(100):
        size = r.choice([7, 16, 64])
        lengths = sorted((r.randint(1, size) for _ in range(r.randint(0, 300))), reverse=True)
        counts = {x: lengths.count(x) for x in set(lengths)}
        held = {}
        for first, n, start, offset in rounds(counts, size):
            for k in range(n):
                held.setdefault(start + k, []).append((offset, lengths[first + k]))
        assert sum(map(len, held.values())) == len(lengths) and len(held) == best_fit_decreasing(lengths, size)
        for v in held.values():
            ends = np.cumsum([n for _, n in sorted(v)])
            assert [o for o, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= size


def test_a_sweep_packs_as_well_as_best_fit_decreasing():
    r = random.Random(4)
    for _ in range(100):
        size = r.choice([7, 16, 64])
        lengths = np.array(sorted((r.randint(1, size) for _ in range(r.randint(0, 300))), reverse=True), np.int64)
        placed, left, gaps = packing.sweep_range(np.full(len(lengths), packing.PIECE), np.arange(len(lengths)), lengths, size, True)
        held = check_places([(int(i), int(s), o) for ranks, seqs, o in placed for i, s in zip(ranks, seqs, strict=True)], lengths, size)
        assert not left and len(held) == best_fit_decreasing(lengths.tolist(), size)
        assert sum(len(h) * g for h, g in gaps) == len(held) * size - lengths.sum()


def check_places(rows, lengths, size):
    """Pieces by their sequences, each of which is filled without a gap from 0."""
    held = {}
    for rank, seq, offset in rows:
        held.setdefault(seq, []).append((offset, int(lengths[rank])))
    assert sorted(rank for rank, _, _ in rows) == list(range(len(lengths)))
    for v in held.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= size
    return held


@pytest.mark.parametrize(("seed", "kind"), [(1, "even"), (2, "short"), (3, "same"), (4, "long")])
def test_rounds_over_many_tasks_pack_nearly_as_well(spark, monkeypatch, seed, kind):
    monkeypatch.setattr(packing, "TASK_PIECES", 400)
    r, size = random.Random(seed), 256
    draw = {"even": lambda: r.randint(1, size), "short": lambda: min(size, int(r.expovariate(1 / 30)) + 1), "same": lambda: r.choice([100, 100, 57, 1, 1]), "long": lambda: r.choice([size, r.randint(120, 200), r.randint(20, 60)])}[kind]
    lengths = sorted((draw() for _ in range(3000)), reverse=True)
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "rank bigint, length bigint")
    rows = [tuple(x) for x in packing.place(df, size).collect()]
    held = check_places(rows, lengths, size)
    assert len(held) <= best_fit_decreasing(lengths, size) * 1.01 + 2


def test_pairs_of_different_ranges_are_told_by_rank():
    # The nearest higher range first, and its smallest gap; each piece and each gap at most once.
    assert packing.meetings([(0, 0, 3), (1, 1, 2), (2, 4, 0), (3, 2, 1), (5, 1, 0)]) == [(0, 1, 0, 0, 0, 1), (1, 2, 0, 1, 0, 2), (3, 2, 2, 0, 1, 2), (5, 5, 0, 3, 0, 1)]


def test_packed_pieces_cover_every_document(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    ref = Tokenizer.from_file(path)
    df = odd_docs(spark)
    got = packing.pack(df, path, 64).toPandas()
    ids = {r.doc_id: [*ref.encode(r.text or "", add_special_tokens=False).ids, 0] for r in df.collect()}
    assert set(got.doc_id.dropna().astype(int)) == {k for k in ids if k is not None}
    one = got.drop_duplicates(["doc_id", "piece"])
    for r in one.itertuples():
        key = None if r.doc_id != r.doc_id else int(r.doc_id)
        data = np.array(ids[key][r.start : r.start + r.length], "<u4")
        assert len(data) == r.length and zlib.crc32(data.tobytes()) == r.ids_crc32 and r.start == 64 * r.piece
    assert one.length.sum() == sum(map(len, ids.values()))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 64
    assert got.sequence_id.nunique() == best_fit_decreasing(got.length.tolist(), 64)
    assert packing.pack(no_docs(spark), path).count() == 0


# --- archives


def test_archive_round_trip(spark):
    big, small = "<p>" + "same page " * 30, "tiny"
    rows = [(5, "http://a/%0A", big, 1), (3, None, big, 1), (9, "http://b\r\nX: y", big, 1), (1, "u", small, 1), (2, "u", small, 1), (4, "u", None, 1), (6, "u", "", 1), (7, "ü", "é" * 200_000, 1), (None, "n", big, 1), (8, "c", "unique " * 20, 1), (8, "c", "unique " * 20, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    files = warc.write_warc(pages, f"{spark.conf.get('spark.checkpoint.dir')}/warc-test", file_bytes=2000)
    back = warc.read_warc(files).collect()
    assert len(back) == len(rows) and files.agg(F.sum("records")).first()[0] == len(rows)
    got = {r.page_id: r for r in back}
    body = big.encode()
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 3), 1: ("response", None), 2: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None), None: ("revisit", 3), 8: ("response", None)}
    assert all(got[k].payload_bytes == len(body) and got[k].payload_digest == hashlib.sha256(body).hexdigest() for k in (3, 5, 9))
    assert bytes(got[7].payload) == ("é" * 200_000).encode() and got[5].payload == b"" and got[4].payload_bytes == 0
    assert got[9].url == "http://b\r\nX: y" and got[5].url == "http://a/%0A" and got[3].url is None
    assert warc.archive_round_trip(spark.createDataFrame([], pages.schema)).count() == 0


def test_reader_rejects_damage():
    data = warc.member(1, "u", b"x" * 500, None, hashlib.sha256(b"x" * 500).hexdigest(), "2024-01-01T00:00:00Z")
    assert [r.kind for r in warc.read_records(io.BytesIO(data + data))] == ["response", "response"]
    assert list(warc.read_records(io.BytesIO(b""))) == []
    wrong = warc.member(1, "u", b"x" * 500, None, "0" * 64, "2024-01-01T00:00:00Z")
    for bad in (data[:-9], data[: len(data) // 2], data[:40] + b"\x00" + data[41:], wrong, data + b"junk"):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


# --- quality


def repeated_by_hand(text):
    words = [w for w in __import__("re").split("[ \t-\r]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), len(hit)


def test_rules_on_odd_documents(spark):
    extra = ["a b c d e f a b c d e", "w " * 9 + "x", "a b c d e " * 3, "Home | About | Contact\nreal sentence with some more words here to keep it\n", "### $$$ a%%% b&&&\nc d e f g h i j k l m n"]
    df = odd_docs(spark).unionByName(spark.createDataFrame([(100 + i, t, "en", "", 0, "", "", "") for i, t in enumerate(extra)], DOCS))
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for k, r in got.items():
        assert (r.n_words, r.n_repeat_words) == repeated_by_hand(texts[k])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert not got[0].kept and got[7].kept and got[103].clean_text.startswith("real sentence") and got[103].kept
    assert got[8].n_repeat_words == 120 and not got[8].kept
    assert quality_rules.quality_rules(no_docs(spark)).count() == 0
    assert "score" in quality_rules.quality_rules(df).columns


def test_weak_labels_and_scorer_agree_with_the_hidden_labels(spark):
    docs, labels = some_docs(spark), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality_model.score_quality(docs, quality_model.fit_quality(docs)).join(labels, "doc_id").toPandas()
    assert ((scored.accepted == (scored.quality == 1)).mean()) > 0.9
    assert scored[scored.quality == 1].accepted.mean() > 0.93


def test_label_model_finds_the_accurate_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    vote = lambda right: np.where(rng.random(4000) < right, np.where(truth, 2, 1), np.where(truth, 1, 2))
    patterns = ["".join(map(str, r)) for r in zip(vote(0.95), vote(0.9), vote(0.6), strict=True)]
    names, counts = np.unique(patterns, return_counts=True)
    model = quality_model.fit_labels(names.tolist(), counts.tolist())
    right = [model.table[j, 1, 2] / model.table[j, 1, 1:].sum() for j in range(3)]
    assert right[0] > right[1] > right[2] and abs(right[0] - 0.95) < 0.04
    assert ((model.posterior(patterns) > 0.5) == truth).mean() > 0.93


def test_quality_of_odd_and_empty_tables(spark):
    df = odd_docs(spark).withColumn("accepted", F.lit("clash"))
    got = quality_model.score_quality(df, quality_model.fit_quality(df)).collect()
    assert len(got) == df.count() and not any(r.accepted for r in got if r.doc_id in (0, 1, 2, 3)) and all(0 <= r.quality_score <= 1 for r in got)
    assert quality_model.score_quality(no_docs(spark), quality_model.fit_quality(no_docs(spark))).count() == 0


# --- classifiers


def test_toxicity_finds_gapped_and_unseen_forms():
    rng = random.Random(2)
    clean = ["garden", "window", "paper", "river", "music", "number", "simple", "carry", "letter", "summer", "yellow", "planet", "travel", "market", "silver", "doctor"]
    insults = ["idiot", "moron", "grubblax", "grubblen", "grubbling", "worthless"]
    word = lambda: rng.choice(clean) + rng.choice(["", "s", "ed", "ing", "er"])
    texts, toxic = [], []
    for k in range(600):
        words = [word() for _ in range(rng.randint(5, 60))]
        if k % 4 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        texts.append(" ".join(words))
        toxic.append(int(k % 4 == 0))
    model = toxicity.train(texts, toxic)
    score = lambda t: float(model.probability(np.array(model.text_margins([t])))[0])
    plain = " ".join(word() for _ in range(30))
    assert score(plain) < 0.2 and score("") < 0.5
    assert all(score(f"{plain} {x} {plain}") > 0.5 for x in ("idiot", "i-d-i-o-t", "i d i o t", "idiiot", "grubblish", "MORON!!"))


def test_toxicity_of_odd_tables(spark):
    docs, labels = some_docs(spark), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, F.lit(True), 100)
    got = toxicity.score_toxicity(odd_docs(spark), model).collect()
    assert len(got) == odd_docs(spark).count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.fit_toxicity(no_docs(spark), labels.limit(0), F.lit(True))
    assert toxicity.score_toxicity(no_docs(spark), none).count() == 0 and toxicity.score_toxicity(odd_docs(spark), none).count() == len(got)


def test_kernel_is_the_feature_maps_product():
    """The explicit feature map against the definition: shared gapped triples, weighted by the spans they cover."""
    from collections import Counter
    from itertools import combinations

    def vector(u):
        s = f"^{u}$"
        out = Counter()
        for places in combinations(range(len(s)), 3):
            if places[2] - places[0] < toxicity.SPAN:
                out[tuple(s[p] for p in places)] += toxicity.DECAY ** (places[2] - places[0] + 1)
        return out

    units = ["idiot", "idiiot", "moron", "garden", "ab"]
    m = toxicity.feature_matrix(units)
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            x, y = vector(a), vector(b)
            want = sum(x[k] * y[k] for k in x) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            assert abs(float(m[i] @ m[j]) - want) < 1e-5


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language_id.fit_languages(docs, ~held, 150)
    got = language_id.identify(docs.where(held), model).join(docs, "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95


def test_language_of_odd_tables(spark):
    model = language_id.train(["the and of that with " * 9, "der und die nicht mit " * 9] * 10, ["en", "de"] * 10)
    got = {r.doc_id: r for r in language_id.identify(odd_docs(spark), model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in (0, 1, 2, 3))
    assert all(r.lang_pred in ("en", "de") for k, r in got.items() if k is None or k > 3)
    one = spark.createDataFrame([(1, "²³ 12 --")], "doc_id bigint, text string")
    assert language_id.identify(one, model).first().lang_pred == "und"
    empty = language_id.fit_languages(no_docs(spark), F.lit(True))
    assert language_id.identify(no_docs(spark), empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd_docs(spark), empty).collect()} == {"und"}


# --- similarity


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 80, 300]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 8, 40])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["", None, " ", "short one", "Short  one", "short two"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, node int")
    got = dict(near_duplicates.near_duplicate_classes(df).collect())
    assert [got[i] for i in range(len(texts))] == jaccard_classes(texts)


def test_estimates_are_of_the_probability_jaccard_similarity():
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(500)]
    copies = [" ".join(base[:k] + [f"x{rng.randrange(900)}" for _ in range(500 - k)]) for k in (500, 470, 400, 250, 0)]
    text, shingle, weight, _ = near_duplicates.shingles(copies)
    signed = near_duplicates.signatures(text, shingle, weight, len(copies))
    sets = [{s: 1 + np.log(w) for s, w in zip(shingle[text == i].tolist(), weight[text == i].tolist(), strict=True)} for i in range(len(copies))]
    for i, x in enumerate(sets):
        y = sets[0]
        want = sum(1 / sum(max(x.get(j, 0) / x[m], y.get(j, 0) / y[m]) for j in x.keys() | y.keys()) for m in x.keys() & y.keys())
        assert abs((signed[0] == signed[i]).mean() - want) < 0.1


def test_classes_of_odd_tables(spark):
    df = odd_docs(spark)
    got = near_duplicates.near_duplicate_classes(df).collect()
    assert len(got) == df.count() and all(r.class_id == r.doc_id for r in got)
    assert near_duplicates.near_duplicate_classes(no_docs(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(100, 101)], "a bigint, b bigint")
    assert {r.label for r in near_duplicates.components(links).collect()} == {10, 100}


def test_salted_lookup_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(200)] + [(500, None)], "i bigint, key string")
    found = spark.createDataFrame([("hot", 7)], "key string, v int")
    got = salted_lookup(rows, found, ["key"], ["i"], 8).collect()
    assert len(got) == 201 and sum(r.v == 7 for r in got) == 100


def brute_force(ids, vectors, k, every):
    out = {}
    unit = vectors / np.sqrt((vectors**2).sum(1, keepdims=True))
    for q in range(len(ids)):
        if ids[q] % every == 0:
            order = sorted((-round(float(unit[q] @ unit[j]), 12), int(ids[j])) for j in range(len(ids)) if j != q)
            out[int(ids[q])] = [j for _, j in order[:k]]
    return out


def test_search_recall_over_several_shards(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 24))
    vectors = (centres[rng.integers(0, 20, 3000)] + 0.5 * rng.normal(size=(3000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, rank int")
    index = vector_search.build_index(df, 6, shard_points=800)
    assert index.count() == 4
    got = vector_search.search(index, df.where("vec_id % 50 = 0"), 5).toPandas()
    want = brute_force(np.arange(3000), vectors.astype(np.float64), 5, 50)
    hits = sum(len(set(want[q]) & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert len(got) == 5 * len(want) and hits / len(got) >= 0.95
    for _, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and (np.diff(g.score) <= 0).all()


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (100, [0.0, 0.0]), (150, None), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, []), (None, [1.0, 1.0]), (7, [1.0, 0.0]), (200, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = vector_search.nearest_neighbours(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, round(r.score, 9)) for r in got] == [(0, 3, 1.0), (0, 7, 1.0), (0, 50, 1.0), (0, 4, 0.0), (50, 0, 1.0), (50, 3, 1.0), (50, 7, 1.0), (50, 4, 0.0)]
    assert vector_search.nearest_neighbours(df.limit(0)).count() == 0


def test_many_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(500)], "vec_id bigint, embedding array<float>")
    got = {q: [] for q in range(0, 500, 50)}
    for r in vector_search.nearest_neighbours(df).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    assert all(v == [i for i in range(6) if i != q][:5] for q, v in got.items())


def test_long_pretokens_equal_the_library():
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    r = random.Random(8)
    runs = [(900, "ab"), (2500, "ering"), (4000, "abcdefghijklmnopqrstuvwxyz"), (3000, "aà漢字あ😀e"), (3000, "=-_/."), (2000, "0123456789"), (1500, "stion "), (700, "lo▁wd")]
    texts = ["".join(r.choice(letters) for _ in range(n)) for n, letters in runs] + ["aaab" * 500, "thequickbrownfox" * 60]
    ref = SentencePieceProcessor(model_file=path)
    counter = PieceCounter(path)
    assert counter.counts(texts) == [len(x) for x in ref.encode(texts)]
    assert counter.count_long(texts[:3]).tolist() == counter.count_sequences(texts[:3]).tolist()


def test_time_of_a_long_pretoken_grows_with_its_length():
    import time

    counter, r, took = PieceCounter(tokenizer_path("piece_bpe_32k.model")), random.Random(9), []
    for n in (20_000, 160_000):
        text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        start = time.process_time()
        counter.counts([text])
        took.append(time.process_time() - start)
    assert took[1] < 16 * took[0] + 1


# --- learned operators against plain versions


def test_toxicity_scores_equal_the_plain_kernel_sum():
    r = random.Random(21)
    rng = np.random.default_rng(21)
    model = toxicity.ToxicityModel(rng.normal(size=toxicity.DIMENSIONS), -0.3, 1.7, 0.2)

    def margin(unit):
        """The largest of its windows' sums over all triples of symbols, each over the length of the window's vector."""
        out = []
        for w in toxicity.windows(unit):
            sym = [39, *((ord(c) - 97) if "a" <= c <= "z" else 26 + ord(c) % 13 for c in w), 39]
            vector = {}
            for i in range(len(sym)):
                for j in range(i + 1, min(len(sym), i + toxicity.SPAN)):
                    for k in range(j + 1, min(len(sym), i + toxicity.SPAN)):
                        code = (sym[i] * 40 + sym[j]) * 40 + sym[k]
                        vector[code] = vector.get(code, 0) + toxicity.DECAY ** (k - i + 1)
            norm = sum(v * v for v in vector.values()) ** 0.5
            out.append(model.bias + sum(model.weights[c] * v for c, v in vector.items()) / norm)
        return max(out)

    texts = [" ".join("".join(r.choice("abcdeéЖ1.") for _ in range(r.choice([1, 1, 2, 5, 9, 40]))) for _ in range(r.randint(0, 12))) for _ in range(60)]
    for text, got in zip(texts, model.text_margins(texts), strict=True):
        want = max([margin(u) for u in toxicity.units_of(text.lower().split())], default=model.bias)
        assert abs(got - want) < 1e-9
    assert abs(model.probability(np.array([0.7]))[0] - 1 / (1 + np.exp(-1.7 * 0.5))) < 1e-12


def test_near_copies_among_training_texts_count_once():
    base = [f"word{i}long{i}" for i in range(30)]
    bags = [base, *([f"other{k}x{i}" for i in range(30)] for k in range(120)), base[:20] + [f"new{i}" for i in range(10)]]
    assert toxicity.originals([sorted(b) for b in bags]) == list(range(121))


def test_expectation_maximisation_equals_one_over_documents():
    r = random.Random(22)
    docs = ["".join(r.choices("012", (3, good and 1 or 4, good and 4 or 1))[0] for _ in range(5)) for good in (r.random() < 0.7 for _ in range(400))]
    patterns = sorted(set(docs))
    model = quality_model.fit_labels(patterns, [docs.count(p) for p in patterns], 30)
    votes = np.array([[int(c) for c in d] for d in docs])
    bad, good = (votes == 1).sum(1), (votes == 2).sum(1)
    q = np.where(bad + good == 0, 0.5, (good + 0.5) / (good + 4 * bad + 1))
    for _ in range(30):
        logs = np.tile(np.log(np.clip(q.mean(), 0.02, 0.98) / (1 - np.clip(q.mean(), 0.02, 0.98))), len(docs))
        for j in range(5):
            idle = (votes[:, j] == 0).mean()
            for v in (1, 2):
                of = votes[:, j] == v
                share = [(w[of].sum() + 1) / (w[votes[:, j] > 0].sum() + 2) for w in (1 - q, q)]
                logs[of] += np.log(max(share[1] * (1 - idle), 1e-9) / max(share[0] * (1 - idle), 1e-9))
        new = 1 / (1 + np.exp(-logs))
        done = abs(new - q).max() < 1e-6
        q = new
        if done:
            break
    assert np.allclose(model.posterior(docs), q, atol=1e-5)


def test_quality_scores_equal_a_sum_over_tokens():
    rng = np.random.default_rng(23)
    scorer = quality_model.QualityScorer(rng.normal(size=quality_model.WORD_BUCKETS), rng.normal(size=quality_model.PAIR_BUCKETS), 0.4)
    texts = ["One two two Three!", "", "x", "AAA bbb 123 4-5 ... ###", *random_texts(40, 5)]
    for text, got in zip(texts, scorer.scores(texts), strict=True):
        z, before, last = [], -1, None
        for w in text.split():
            word, kind = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")), zlib.crc32(quality_model.shape(w).encode("utf-8", "surrogatepass")) % quality_model.SHAPES
            pair = ((before + 1) * 2654435761 + kind * 40503 + (word == last) * 7919) % 4294967291 % quality_model.PAIR_BUCKETS
            z.append(scorer.words[word % quality_model.WORD_BUCKETS] + scorer.pairs[pair])
            before, last = kind, word
        want = scorer.bias + (sum(z) / len(z) if z else 0)
        assert abs(got - 1 / (1 + np.exp(-want))) < 1e-9


def test_a_labeller_judges_long_texts_like_short_ones():
    r = random.Random(24)
    block = " ".join(f"w{r.randrange(900)}" for _ in range(quality_model.BLOCK))
    assert quality_model.votes(block)[5] == quality_model.votes(" ".join([block] * 20))[5]
    assert quality_model.votes("spam " * 50_000)[5] == str(quality_model.BAD)


def test_language_scores_equal_a_mean_over_grams():
    rng = np.random.default_rng(25)
    model = language_id.LanguageModel(["a", "b", "c"], rng.normal(size=(language_id.BUCKETS, 3)), rng.normal(size=3), 0.7)
    data = [x for x in map(language_id.prepared, ["Hello there", "Ünï çödé wörds", "日本語", "x", *random_texts(30, 6)]) if x]
    for x, got in zip(data, model.scores(data), strict=True):
        rows = []
        for n in language_id.GRAMS:
            for i in range(len(x) - n + 1):
                key = int.from_bytes(bytes([n]) + x[i : i + n], "big") & 0xFFFFFFFFFFFFFFFF
                rows.append(model.logits[(key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 48])
        z = (np.mean(rows, 0) + model.bias) / 0.7
        assert np.allclose(got, np.exp(z) / np.exp(z).sum())


def test_ties_between_languages_go_to_the_first(spark):
    model = language_id.LanguageModel(["aa", "bb"], np.zeros((language_id.BUCKETS, 2)), np.zeros(2))
    got = language_id.identify(spark.createDataFrame([(1, "any text"), (2, None), (3, "12")], "doc_id bigint, text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("aa", 0.5), ("und", 0.0), ("und", 0.0)]


def test_training_samples_are_bounded(spark):
    from tidemark.llm.common import fetched_texts, sampled_ids

    rows = [(i % 3000, "x" * 100) for i in range(9000)] + [(5, f"another text {k}") for k in range(500)] + [(None, "no id"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    hashes = dict(spark.range(3000).select("id", F.xxhash64("id")).collect())
    first = sorted(range(3000), key=lambda i: (hashes[i], i))
    for most in (50, 400, 5000):
        assert [r[0] for r in sampled_ids(df, most).collect()] == first[:most]
    got = fetched_texts(df, sampled_ids(df, 200), 1 << 20)
    assert [g[0] for g in got] == first[:200]
    assert len(fetched_texts(df, sampled_ids(df, 200), 1000)) == 10
    ids = spark.createDataFrame([(5, 1), (5, 0), (9, 1)], "doc_id bigint, toxic int")
    assert sorted((a, b) for a, b, _ in fetched_texts(df, ids, 1 << 20, ("toxic",))) == [(5, 0), (5, 1), (9, 1)]
    assert fetched_texts(df.limit(0), sampled_ids(df.limit(0), 5), 10) == []
    langs = spark.createDataFrame([(i % 700, "t", "en" if i % 7 else "de") for i in range(2100)] + [(None, "t", "en"), (3, None, "fr")], "doc_id bigint, text string, lang string")
    chosen = language_id.training_ids(langs, F.lit(True), 60, 5)
    assert {x: [i for i, y in chosen if y == x] for x in ("en", "de")} == {x: [i for i in first if i < 700 and (i % 7 > 0) == (x == "en")][:60] for x in ("en", "de")}
