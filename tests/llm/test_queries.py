"""The registered queries on the smallest tables: columns, whole tables, and SQL where there is some."""

import duckdb
import pytest

import __spark_entry__ as contract
from check_oracle import digest
from corpuslens.llm.queries import ORACLES, QUERIES

COLUMNS = {
    1: "doc_id size text_crc32 law shard slot grown_shard",
    2: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    3: "doc_id n_words n_hit n_items items_sha256 contaminated",
    4: "doc_id n_bytes n_removed n_spans kept_sha256",
    5: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    6: "doc_id n_assign n_access n_hex base_sha256 spans",
    7: "doc_id start n_tokens ids_crc32",
    8: "doc_id fingerprint component_id",
    9: "page_id host path rule verdict",
    10: "page_id payload_bytes payload_digest record_type refers_to",
    11: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    12: "doc_id held_out lang_pred score",
    13: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}
NATIVE = (1, 2, 6, 9)


def number(name):
    return int(name.removeprefix("op").split("_")[0])


def test_all_operators():
    assert sorted(map(number, QUERIES)) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    wanted = COLUMNS[number(name)].split()
    assert df.columns[: len(wanted)] == wanted
    if number(name) in NATIVE:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = [tuple(r) for r in df.collect()]
    table = {"page_id": "pages", "conv_id": "conversations"}.get(wanted[0], "documents")
    every = {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(wanted[0]).collect()}
    assert {r[0] for r in rows} <= every if table == "conversations" else {r[0] for r in rows} == every
    if number(name) not in (5, 11):
        assert len(rows) == len(every)
    if name in ORACLES:
        db = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        result = db.execute(ORACLES[name])
        columns = [d[0] for d in result.description]
        assert digest(df.columns, rows)[1] == digest(columns, result.fetchall())[1]
