"""Every query with SQL against DuckDB on the smallest tables, and every other one for rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from turnmill.plans.catalogue import QUERIES, SQL
from turnmill.session import ARROW, ARROW_BYTES, BATCH_BYTES, BATCH_ROWS

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MAY_BE_EMPTY = {"dull_share"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple("~" if r[k] is None or r[k] != r[k] else repr(round(float(r[k]), 6)) if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in SQL:
        want = db.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert plain(rows, df.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["tweet_tokens", "emoticon_strip", "html_nodes", "post_cases", "normalize_post", "tweet_cases", "emoticon_cases"])
def test_python_gets_small_batches(spark, name):
    own = QUERIES[name](spark, SF).sparkSession.conf
    assert int(own.get(ARROW)) <= BATCH_ROWS and int(own.get(ARROW_BYTES)) <= BATCH_BYTES
    assert int(spark.conf.get(ARROW)) > BATCH_ROWS  # the caller's session keeps its own


def test_textual_odd_texts(spark, tmp_path):
    texts = ["", None, " ", "\n", "1", "a", "abc def!", "abc 123", "a" * 17 + "123", "a" * 16 + "1234", "\u00e9", "a" * 17 + "\U0001f468" * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["is_textual"](spark, str(tmp_path)).collect())) == sorted(c.sql(SQL["is_textual"]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
