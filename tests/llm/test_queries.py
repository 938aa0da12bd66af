import pytest

from tabscope.llm import queries
from tests.compare import connection, difference


def test_names():
    made = queries.queries()
    assert [n for n in range(1, 14) if sum(q.startswith(f"op{n}_") for q in made) == 1] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(made)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    assert difference(spark, sf, name, queries.queries()[name], queries.oracle_sql()[name], connection(sf)) is None


COLUMNS = {
    "op1": "page_id bigint, url string, text string, n_chars bigint",
    "op3": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op5": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9": "page_id bigint, host string, path string, rule string, verdict string",
    "op10": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op12": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
}


@pytest.mark.parametrize("operator", COLUMNS)
def test_columns_and_rows(spark, sf, operator):
    name, make = next((n, q) for n, q in queries.queries().items() if n.startswith(operator + "_"))
    made = make(spark, sf)
    assert ", ".join(f"{c} {t}" for c, t in made.dtypes).startswith(COLUMNS[operator]), name
    table = "pages" if operator in ("op1", "op9", "op13") else "documents"
    assert made.count() == queries.read_table(spark, sf, table).count()
