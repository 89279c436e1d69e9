import hashlib
import os

import brute
import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from premia.llm import all_queries, all_sql
from premia.llm.common import read, write_table
from premia.llm.queries import bpe_file

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_is_its_sql(spark, database, name):
    expected = database.execute(all_sql()[name])
    columns = [c[0] for c in expected.description]
    rows = sorted(expected.fetchall(), key=str)
    found = all_queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(columns)
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=str) == rows


def test_token_query_is_the_library(spark):
    library = Tokenizer.from_file(bpe_file())
    for r in all_queries()["op10_bpe"](spark, DATA).join(read(spark, DATA, "documents"), "doc_id").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(data).hexdigest())
        assert r.decoded_sha256 == brute.sha(library.decode(ids, skip_special_tokens=False))


def test_passage_query_is_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, DATA, "documents").collect()]
    found = all_queries()["op6_suffix_array"](spark, DATA).collect()
    assert {(r.doc_id, k) for r in found for k in range(r.start, r.start + r.n_words)} == brute.repeated_words(docs)


def test_licence_and_toxicity_queries_answer_every_document(spark):
    n = read(spark, DATA, "documents").count()
    for name in ("op7_licences", "op8_toxicity"):
        assert all_queries()[name](spark, DATA).select("doc_id").distinct().count() == n


def test_pipeline_is_brute_force_stage_by_stage(spark, documents):
    docs = read(spark, DATA, "documents")
    extra = documents.select(*docs.columns).withColumn("doc_id", documents.doc_id + 100_000)
    docs, kept = write_table(docs.union(extra.dropDuplicates(["doc_id"]).where("doc_id is not null")), "in"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        docs = write_table(stage(spark, docs, DATA), "out")
        kept[name] = (before, {r.doc_id: r for r in docs.collect()})
        assert docs.count() == len(kept[name][1])
        if name != "tokens":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    before, after = kept["toxicity"]
    assert set(after) <= set(before) and len(after) > 0.8 * len(before)
    before, after = kept["minhash"]
    assert set(after) == {i for i, v in brute.near_duplicates(before.items()).items() if v[2]}
    before, after = kept["substrings"]
    cut = brute.without_repeats(before.items())
    assert set(after) == {i for i, (n, gone, _) in cut.items() if gone == 0 or gone < n}
    for i, r in after.items():
        assert r.text == (cut[i][2] if cut[i][1] else before[i])
    before, after = kept["decontaminate"]
    items = [(r.item_id, r.text) for r in read(spark, DATA, "benchmark").collect()]
    assert set(after) == {i for i, v in brute.passages(before.items(), items).items() if not v[1]}
    before, after = kept["tokens"]
    library = Tokenizer.from_file(bpe_file())
    for i, r in after.items():
        assert r.n_tokens == len(library.encode(before[i] or "", add_special_tokens=False).ids) and r.round_trip
    assert set(after) == set(before)


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        read(spark, DATA, name).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
