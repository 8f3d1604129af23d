"""The registered queries and the pipeline as a whole."""

import pytest

import corpus_pipeline
from docloom.llm.queries import ORACLE, QUERIES
from llm_rows import SF_DIR
from oracle_check import compare

COLUMNS = {
    1: "doc_id class_id n_links", 2: "doc_id held_out score predicted", 3: "page_id url text n_chars",
    4: "page_id payload_bytes payload_digest record_type refers_to", 5: "doc_id n_bytes n_removed n_spans kept_sha256",
    6: "doc_id n_words n_removed kept_sha256", 7: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    8: "doc_id start n_tokens ids_crc32", 9: "doc_id keep_id group_size kept text_sha256", 10: "doc_id item_id coverage",
    11: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    12: "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    13: "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_result_as_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), SF_DIR, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[int(name[2:].split("_")[0])].split()) <= set(df.columns)
    assert df.count() > 0


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    left = [docs.count()]
    from docloom.llm.common import stored

    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, out, SF_DIR), name)
        if name != "packed":
            assert out.columns == docs.columns
            left.append(out.count())
    assert left == sorted(left, reverse=True) and left[1] > 0.7 * left[0] and left[2] < left[1]
    whole = corpus_pipeline.run(spark, SF_DIR)
    key = ["doc_id", "start", "length", "sequence_id", "offset"]
    assert sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, out.select(*key).collect()))


def test_pipeline_of_odd_rows(spark, odd_docs):
    from docloom.llm.common import stored

    out = odd_docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stored(stage(spark, out, SF_DIR), name)
    assert out.count() > 0
