from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from themeloom.llm import oracle, queries, toxicity
from themeloom.staging import stage

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


def test_pipeline_stages_do_their_work(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "entities", "mixing", "packing"]
    columns, kept = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, FOLDER), f"test_{name}")
        assert name == "packing" or docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = toxicity.scored_documents(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels)
    assert kept["toxicity"] == {r.doc_id for r in scored.where("predicted = 0").collect()}
    assert kept["near_duplicates"] <= kept["toxicity"] and kept["entities"] == kept["near_duplicates"]
    assert kept["packing"] == kept["mixing"] <= kept["entities"]


def test_queries_have_the_agreed_columns(spark):
    wanted = {
        "op1_source_mixing": "doc_id size source_size target taken",
        "op2_minhash_near_duplicates": "doc_id n_shingles component_id kept",
        "op3_stratified_shards": "doc_id size text_crc32 law shard slot grown_shard",
        "op5_robust_outliers": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op6_attention_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op7_counterfactual_toxicity": "doc_id held_out score predicted",
        "op8_exact_top_scores": "query_id rank vec_id score",
        "op9_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
        "op10_main_text": "page_id url text n_chars",
        "op11_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
        "op12_shared_lines": "doc_id n_lines n_dropped kept_sha256",
        "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    }
    for name, columns in wanted.items():
        frame = queries.QUERIES[name](spark, FOLDER)
        assert set(columns.split()) <= set(frame.columns), name


def test_toxic_documents_are_found_where_labels_are_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = queries.QUERIES["op7_counterfactual_toxicity"](spark, folder).where("held_out")
    rows = scored.join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)


@pytest.mark.parametrize("name", sorted(oracle.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(result.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({oracle.QUERIES[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in result.collect()))) == sorted(map(str, expected))
