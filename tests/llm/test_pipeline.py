"""The corpus pipeline stage by stage, each against a plain version of it on what the stage before kept."""

import duckdb
import pytest

import corpus_pipeline
from tests_llm_plain import best_fit_decreasing, jaccard_classes
from tidemark.llm.common import staged
from tidemark.llm.queries import ORACLES, QUERIES, quality_rules_sql, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "test")
        out.append(docs.toPandas())
    return out


def test_stages_return_the_columns_of_documents(stages):
    assert len(corpus_pipeline.STAGES) == 4 and all(list(s.columns) == corpus_pipeline.COLUMNS for s in stages[:4])


def test_classifier_keeps_good_documents(stages):
    con = duckdb.connect()
    good = con.execute(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetch_df().set_index("doc_id").quality
    kept = set(stages[1].doc_id)
    of = lambda q: [i for i in good.index if good[i] == q and i in set(stages[0].doc_id)]
    assert sum(i in kept for i in of(1)) / len(of(1)) > 0.95
    assert sum(i in kept for i in of(0)) / max(1, len(of(0))) < 0.4


def test_rules_equal_sql(stages):
    con = duckdb.connect()
    con.register("kept_", stages[1])
    want = con.execute(f"SELECT doc_id FROM ({quality_rules_sql('kept_', 'doc_id')}) WHERE kept").fetch_df()
    assert sorted(want.doc_id) == sorted(stages[2].doc_id)


def test_one_document_of_each_class_stays(stages):
    docs = stages[2].sort_values("doc_id")
    label = jaccard_classes(docs.text.tolist())
    assert sorted(stages[3].doc_id) == [i for k, i in enumerate(docs.doc_id.tolist()) if label[k] == k]


def test_packing_covers_what_is_left(stages):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {i: len(ref.encode(t, add_special_tokens=False).ids) + 1 for i, t in zip(stages[3].doc_id, stages[3].text, strict=True)}
    packed = stages[4]
    assert packed.groupby("doc_id").length.sum().to_dict() == want
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.sequence_id.nunique() == best_fit_decreasing(packed.length.tolist(), 2048)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_text_query_equals_sql(spark, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


def test_stages_on_odd_tables(spark):
    prose = "The quiet harbour wakes before dawn, while old fishermen mend their nets. Later a market opens on the square, where farmers sell apples, bread and honey. Children run home through narrow lanes, and by evening every window shows a small lamp."
    menu = "Home | News | Sport | Contact | Sign in"
    rows = [(1, prose, "en", "a", len(prose)), (1, prose, "en", "a", len(prose)), (2, prose + "\n" + menu, "en", None, None), (3, None, None, None, None), (4, "", "en", "b", 0), (None, prose, None, None, None), (5, prose + " " + " ".join(f"more{k}" for k in range(30_000)), "en", "b", 7), (1, "another text under the same id, " + prose[::-1], "en", "c", 9)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "'x' as kept", "1 as _0", "2 as mark", "'y' as clean_text")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0, name
    accepted = corpus_pipeline.quality_classifier(spark, docs, SF).collect()
    assert all(r.text for r in accepted) and {r.doc_id for r in accepted} <= {1, 2, 5, None}
    ruled = corpus_pipeline.rules(spark, docs, SF).toPandas()
    one = ruled[ruled.doc_id == 2].iloc[0]
    assert one.text == prose and one.n_chars == len(prose) and (ruled.doc_id == 1).sum() >= 2 and not ruled.doc_id.isin([3, 4]).any()
    assert ruled[ruled.doc_id == 5].iloc[0].n_chars == 7
    kept = corpus_pipeline.deduplicate(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:12]) for r in kept) == sorted([(1, prose[:12]), (2, prose[:12]), (1, "another text"), (0, prose[:12]), (3, ""), (4, ""), (5, prose[:12])])
    packed = corpus_pipeline.packing(spark, docs, SF).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and (packed.doc_id.isin([3, 4]) & (packed.length == 1)).sum() == 2
