"""The queries on the test tables: against SQL where there is some, and their contracts' columns."""

import duckdb
import pytest

from gridscribe.llm import queries

COLUMNS = {
    "op1_mix": "doc_id size source_size target taken",
    "op2_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op4_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op5_url_filter": "page_id host path rule verdict",
    "op6_webp": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op7_quality": "doc_id held_out score predicted",
    "op8_decontamination": "doc_id item_id containment",
    "op9_language_id": "doc_id held_out lang_pred score",
    "op10_jaccard_join": "doc_id class_id n_links",
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir).toArrow(), con.execute(queries.oracle_sql()[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = lambda t: sorted(repr(tuple(r[n] for n in names)) for r in t.to_pylist())
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_reruns(spark, sf_dir, name):
    query = queries.queries()[name]
    first = query(spark, sf_dir)
    assert set(COLUMNS[name].split()) <= set(first.columns)
    assert sorted(map(str, first.collect())) == sorted(map(str, query(spark, sf_dir).collect()))
