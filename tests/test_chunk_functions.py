"""The chunkers as SQL functions, and the recursive SQL that the queries are held against, on odd texts."""

import duckdb
import pandas as pd
import pytest

from tessera.operators import chunk_functions, chunkers
from tessera.plans.chunk_sql import paragraph_sql, recursive_sql

TEXTS = [
    None, "", " \n ", "one", "a. b. c", "x" * 95, "word " * 60, "Long sentence here without an end " * 9 + ". Short. " * 12, "p one.\n\np two is a bit longer. It has two sentences.\n\n\n\np three\nwith lines\nand more", "\n\n  lead\n\n",
    "a" * 30 + "\n\n" + "b" * 31 + "\n\n" + "c" * 29, ("é" * 25 + ". ") * 6, "one\n\n" + "y" * 64 + " z. " + "q" * 70, "tail.   \n\n" + "k l m n o p. " * 10, "\n".join(["row"] * 40), ". . . . " * 20,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def plain(rows):
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("strategy", ["paragraph", "recursive"])
@pytest.mark.parametrize(("size", "overlap"), [(30, 0), (30, 12), (64, 7), (7, 3)])
def test_functions_operators_and_sql_agree(spark, docs, strategy, size, overlap):
    chunk_functions.register(spark)
    docs.createOrReplaceTempView("odd_docs")
    wanted = plain(chunkers.chunk_documents(docs, size, overlap, strategy).select("doc_id", "chunk_index", "text", "char_start", "char_end").collect())
    lateral = spark.sql(f"SELECT d.doc_id, c.* FROM odd_docs d, LATERAL chunk_text(d.text, {size}, {overlap}, '{strategy}') c")
    assert plain(lateral.collect()) == wanted
    whole = spark.sql(f"SELECT * FROM chunk_table(TABLE(odd_docs) PARTITION BY (doc_id), {size}, {overlap}, '{strategy}')")
    assert plain(whole.collect()) == wanted
    con = duckdb.connect()
    con.register("docs", pd.DataFrame({"doc_id": range(len(TEXTS)), "text": pd.Series(TEXTS, dtype=object)}))
    sql = (recursive_sql if strategy == "recursive" else paragraph_sql)("SELECT doc_id, text FROM docs", size, overlap)
    assert plain(con.execute(sql).fetchall()) == wanted


def test_a_table_keeps_its_other_columns_and_refuses_clashes(spark):
    chunk_functions.register(spark)
    spark.createDataFrame([("a", "one two", 5)], "name string, text string, n int").createOrReplaceTempView("named_docs")
    found = spark.sql("SELECT * FROM chunk_table(TABLE(named_docs), 3, 0, 'recursive')")
    assert found.columns == ["name", "n", "chunk_index", "chunk", "char_start", "char_end"]
    assert plain(found.collect()) == [("a", 5, 0, "one", 0, 3), ("a", 5, 1, "two", 4, 7)]
    spark.createDataFrame([("a", 5)], "text string, chunk int").createOrReplaceTempView("clashing_docs")
    with pytest.raises(Exception, match="columns of the result"):
        spark.sql("SELECT * FROM chunk_table(TABLE(clashing_docs), 3, 0, 'recursive')").collect()
