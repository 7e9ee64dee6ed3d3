"""Text queries that SQL can express, on the smallest tables and on awkward rows."""

import pytest
from conftest import SMOKE
from oracle import compare, connect

from plaidframe.llm.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connect(SMOKE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], SMOKE) == ""


LONG = "alpha beta gamma delta " * 3000
DOCS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "b", 1),
        (2, "ONE two, three! four five six seven eight nine ten eleven twelve thirteen and more", "en", None, 2),
        (3, "", "en", "b", 3), (4, None, None, "b", 4), (5, "É É école", "fr", "a", 5), (6, LONG, "en", "c", 6),
        (7, LONG, "en", "c", 7), (8, LONG + "tail", "en", "é", 8), (9, " \t\n ", "en", "", 9), (10, "a b", "en", "a", 1),
        (11, "a  B", "en", "a", 1), (12, "a b c", "en", "d", 1)]
ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, "école"), (2, "ÉCOLE x"),
         (3, None), (4, "..."), (10, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")]
TURNS = [(1, 0, "user", "a <| b \\ <|im_end|>\n"), (1, 1, "assistant", "<\\| \\\\"), (1, 2, "user", None),
         (2, None, None, "x"), (2, 3, "assistant", ""), (2, 3, "assistant", "tie"), (2, 3, "assistant", "tie"),
         (3, 5, "us\ner", "\n"), (3, 2000, "assistant", "late é"), (4, 1, "system", "only")]
PAGES = [(1, "http://a.Example.com/en/x?y"), (2, None), (3, "no scheme"), (4, "x://www.example.com/en/"), (5, "http://net"),
         (6, "http://net/fr/#"), (7, "http://a.net:80/fr/"), (8, "http://org/x.com/"), (9, "a://b://c.com/"),
         (10, "http://com/" + "z" * 70000), (10, "http://com/" + "z" * 70000), (11, "http://notexample.com/en/1")]


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", sorted(SQL))
def test_awkward_rows(spark, tmp_path, name, empty):
    tables = {"documents": (DOCS, "doc_id long, text string, lang string, source string, n_chars long"),
              "benchmark": (ITEMS, "item_id long, text string"),
              "conversations": (TURNS, "conv_id long, turn long, role string, text string"),
              "pages": ([(*p, "") for p in PAGES], "page_id long, url string, html string")}
    for table, (rows, schema) in tables.items():
        frame = spark.createDataFrame([] if empty else rows, schema)
        # columns that operators use inside must not clash
        extra = {c: frame[frame.columns[0]] for c in ("kept", "node", "size", "hits", "rule", "block", "example")}
        frame.withColumns(extra).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    import duckdb
    base = duckdb.connect()
    for table in tables:
        base.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert compare(spark, base, QUERIES[name], SQL[name], str(tmp_path)) == ""
