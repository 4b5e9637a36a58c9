"""The queries against the same question in SQL, row for row."""

import duckdb
import pytest

from sharedrift.llm.oracle import ORACLE_SQL
from sharedrift.llm.queries import QUERIES
from tests import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    got_columns, got = compare.spark_rows(QUERIES[name](spark, sf_dir))
    want_columns, want = compare.sql_rows(compare.connect(sf_dir), ORACLE_SQL[name])
    assert got_columns == want_columns
    missing, extra = want - got, got - want
    assert sum(got.values()) > 0
    assert not missing and not extra, (
        f"{sum(got.values())} rows; {sum(missing.values())} missing, {sum(extra.values())} extra; "
        f"e.g. want {sorted(missing, key=str)[:2]} got {sorted(extra, key=str)[:2]}")


def both(spark, name, texts):
    """Rows of a query and of its SQL over a small table of documents."""
    import tempfile

    folder = tempfile.mkdtemp()
    rows = [(n, text, "en", "s1", len(text)) for n, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = compare.spark_rows(QUERIES[name](spark, folder))
    assert got == compare.sql_rows(con, ORACLE_SQL[name])
    return [dict(zip(got[0], row)) for row in got[1]]


def test_notices_in_a_row_have_their_label_in_both(spark):
    rows = both(spark, "op4_license_scan", ["All rights reserved. All rights reserved.", "all rights reserved", "rights reserved all"])
    assert sorted((r["doc_id"], r["labels"] != "") for r in rows) == [(0, True), (1, True), (2, False)]


def test_lines_are_counted_by_whole_texts_in_both(spark):
    own = [" ".join(f"w{n}x{k}" for k in range(60)) for n in range(20)]
    texts = [f"The header line\n{text}\nThe footer line" for text in own] + [f"{own[0]}\nA copied line"] * 20
    rows = both(spark, "op8_quality_rules", texts)
    assert sorted(r["n_removed_words"] for r in rows) == [0] * 20 + [6] * 20
