"""Hand-made cases: chunkers, elements, cursors, files, scopes, metadata, snapshots, context, and streams."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tessera.operators import access, catalog, chunkers, context, ingest, retrieval, snapshots
from tessera.sources import files
from tessera.streaming.timelines import once_per_key, write_log


def test_paragraphs_are_packed_to_the_size():
    text = "aaaa\n\nbbbb\n\n  \n\ncccc"
    assert chunkers.paragraph_pieces(text, 10) == [("aaaa\n\nbbbb", 0), ("cccc", 16)]
    assert chunkers.paragraph_pieces(text, 9) == [("aaaa", 0), ("bbbb", 6), ("cccc", 16)]


def test_long_paragraphs_are_packed_by_sentences_and_windows():
    assert chunkers.paragraph_pieces("One two. Three. Fo", 12) == [("One two.", 0), ("Three. Fo", 9)]
    # The window that is left last goes on with the next sentence.
    assert chunkers.paragraph_pieces("x" * 25 + ". ab", 12) == [("x" * 12, 0), ("x" * 12, 12), ("x. ab", 24)]
    # The carry of a long paragraph goes on with the next paragraph.
    assert chunkers.paragraph_pieces("aaaa bbbb. cc\n\ndd", 10) == [("aaaa bbbb.", 0), ("cc\n\ndd", 11)]


def test_recursive_chunks_prefer_coarse_separators():
    assert chunkers.recursive_pieces("aa bb\n\ncc dd", 7) == [("aa bb", 0), ("cc dd", 7)]
    assert chunkers.recursive_pieces("aaa. bbb. ccc", 6) == [("aaa.", 0), ("bbb.", 5), ("ccc", 10)]
    assert chunkers.recursive_pieces("abcdefgh", 3) == [("abc", 0), ("def", 3), ("gh", 6)]
    assert chunkers.recursive_pieces("x" * 9, 0) == []


def test_overlap_begins_after_a_space(spark):
    docs = spark.createDataFrame([(1, "abcd efgh\n\nijkl"), (2, None), (3, " ")], "doc_id long, text string")
    got = [(r.id, r.text, r.char_start, r.char_end) for r in chunkers.chunk_documents(docs, 9, 6).orderBy("chunk_index").collect()]
    assert got == [("1_0", "abcd efgh", 0, 9), ("1_1", "efgh ijkl", 4, 15)]
    assert [r.doc_id for r in chunkers.without_chunks(docs, chunkers.chunk_documents(docs, 9)).orderBy("doc_id").collect()] == [2, 3]


def test_blocks_and_their_kinds(spark):
    blocks = ["# Title", " plain ", "a | b | c\n--|---|--", "$$x$$", "e = mc", "![ alt ](u.png) more", "e\n= 1", "1 = 2"]
    docs = spark.createDataFrame([(1, "\n\n".join(blocks))], "doc_id long, text string")
    got = chunkers.block_elements(docs).orderBy("element_index").collect()
    assert [r.kind for r in got] == ["heading", "text", "table", "equation", "equation", "image", "text", "text"]
    assert (got[0].caption, got[5].caption, got[1].caption) == ("Title", "alt", None)
    text = "\n\n".join(blocks)
    assert all(text[r.char_start : r.char_end] == r.text for r in got)


def test_elements_without_a_span_belong_to_the_first_chunk(spark):
    elements = spark.createDataFrame([(1, 0, "image", None, None), (1, 1, "table", 5, 12), (1, 2, "text", 0, 20)], "doc_id long, element_index long, kind string, char_start long, char_end long")
    chunks = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20), (1, 2, 20, 30)], "doc_id long, chunk_index long, char_start long, char_end long")
    assert {r.chunk_index: (r.content_kinds, r.refs) for r in chunkers.element_refs(elements, chunks).collect()} == {0: ("image,table", "0,1"), 1: ("table", "1")}


def test_cursors_come_back(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5), "k?>")], "at timestamp, key string")
    text = df.select(catalog.cursor(F.col("at"), F.col("key"))).first()[0]
    assert catalog.read_cursor(text) == (datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc), "k?>") and "=" not in text
    for at in (datetime(2024, 1, 2, 3, 4, 5, 123456), datetime(2024, 1, 2, 3, 4, 5, 900000)):
        text = spark.createDataFrame([(at, "1")], "at timestamp, key string").select(catalog.cursor(F.col("at"), F.col("key"))).first()[0]
        assert catalog.read_cursor(text) == (at.replace(tzinfo=timezone.utc), "1")
    for bad in ("", "!!", "e30", "eyJjcmVhdGVkX2F0IjoiMjAyNC0wMS0wMVQwMDowMDowMCIsImlkIjoiMSJ9"):
        with pytest.raises(ValueError):
            catalog.read_cursor(bad)
    with pytest.raises(ValueError):
        catalog.cursor_allowed("filename")


def test_files_are_listed_and_checked(spark, tmp_path):
    bodies = {"a.txt": b"caf\xc3\xa9 \xff", "b.md": b" \n", "c.pdf": b"%PDF-1", "d.pdf": b"no", "e.PNG": b"\x89PNG\r\n\x1a\nx", "f.exe": b"MZ", "sub/g.json": b"{}", "h.gif": b"GIF88"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    listed = {r.path.rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path)).collect()}
    assert listed == {"a.txt", "b.md", "c.pdf", "d.pdf", "e.PNG", "g.json", "h.gif"}
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "café �" and got["a.txt"]["size"] == 7
    assert {k: (r.route, r.error) for k, r in got.items()} == {
        "a.txt": ("plain", None), "b.md": ("plain", "blank"), "c.pdf": ("pdf", None), "d.pdf": ("pdf", "content"), "e.PNG": ("rich", None), "f.exe": ("rich", "unsupported"),
        "g.json": ("plain", None), "h.gif": ("rich", "content"),
    }


def test_metadata_rules(spark):
    schema = {"required": ["a"], "properties": {"a": {"type": "string", "pattern": "x+", "minLength": 2}, "n": {"type": "number", "maximum": 5}, "b": {"type": "boolean"}, "o": {"type": "object"}}}
    cases = {'{"b":true}': "a:required", '{"a":1}': "a:type", '{"a":"xy"}': "a:pattern", '{"a":"x"}': "a:minLength", '{"a":"xx"}': None, '{"a":"xx","n":5.5}': "n:maximum", '{"a":"xx","n":"5"}': "n:type", '{"a":"xx","b":"true"}': "b:type", '{"a":"xx","o":{}}': None, '{"a":null}': "a:type"}
    df = spark.createDataFrame(list(cases.items()), "m string, want string")
    for r in df.select("m", "want", access.metadata_error("m", schema).alias("error")).collect():
        assert (r.m, r.error) == (r.m, r.want)
    with pytest.raises(ValueError):
        access.metadata_error("m", {"type": "array"})


def test_tenants_write_their_own(spark):
    rows = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "id int, tenant string")
    own = access.with_tenant(rows, "tenant", "t").collect()
    assert {(r.tenant, r.error) for r in own} == {("t", None)}
    assert [r.error for r in access.with_tenant(rows, "tenant", None, True).orderBy("id").collect()] == [None, "required", "required"]
    assert {r.error for r in access.with_tenant(rows, "tenant", None).collect()} == {"denied"}
    assert rows.where(access.tenant_visible("tenant", None)).count() == 0


def test_the_last_administrator_stays(spark):
    rows = spark.createDataFrame([(1, "admin"), (2, "user")], "id int, role string")
    assert [r.id for r in access.keeps_one(rows, "role", "admin").collect()] == [2]
    assert access.keeps_one(rows.union(rows), "role", "admin").count() == 4


def test_hits_date_a_cache_once_an_hour(spark):
    now = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    cache = spark.createDataFrame([(1, "2024-01-01 11:30:00"), (2, "2024-01-01 10:00:00"), (3, "2024-01-01 10:00:00")], "k int, at string").select("k", F.to_timestamp("at").alias("last_hit_at"))
    hits = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert [r.last_hit_at.hour for r in snapshots.touched(cache, hits, ["k"], now).orderBy("k").collect()] == [11, 12, 10]


def test_context_is_cut_to_the_budget(spark):
    rows = [(1, 1, " (a)", "x" * 50, ""), (1, 2, "", "y" * 50, "!"), (1, 3, "", "z" * 50, "")]
    df = spark.createDataFrame(rows, "query_id long, rank long, label string, text string, extra string")
    got = context.context_blocks(df, 120).first().context
    # 120 - (8 + 50) = 62 are left; 62 - 4 - 1 - 16 = 41 of the second text fit, and nothing after it.
    assert got == "[1] (a) " + "x" * 50 + "\n\n---\n\n" + "[2] " + "y" * 41 + "!"
    assert df.select(context.context_block(F.array().cast("array<struct<label:string,text:string,extra:string>>"), 100).alias("c")).first().c == context.NOTHING


def test_modes_search_for_their_own_queries(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "id long, vector array<double>")
    texts = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (9, "red hen")], "id long, text string")
    asked = spark.createDataFrame([(1, "red", [1.0, 0.0], 1, None, None, None), (2, "red", [1.0, 0.0], 1, "keyword", 1, None), (3, "fox", [0.0, 1.0], 1, "hybrid", 5, 0.4), (4, "red", [1.0, 0.0], 2, "odd", 3, 0.7)], "query_id long, query string, vector array<double>, collection_id long, mode string, top_k long, min_score double")
    collections = spark.createDataFrame([(1, 2, None, "semantic")], "collection_id long, default_top_k long, default_min_score double, default_mode string")
    filled = retrieval.with_defaults(asked, collections)
    got = {}
    for r in retrieval.retrieve(filled, vectors, texts).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got[1] == [1, 2] and got[2] == [1] and got[4] == [1, 2] and set(got[3]) <= {1, 2, 3}
    with pytest.raises(ValueError):
        retrieval.at_most([1] * 21, retrieval.MAX_BATCH, "queries")


def test_guards_name_each_fault(spark):
    rows = spark.createDataFrame([(1, [1.0], "a", "{}"), (2, None, "a", "{}"), (3, [1.0, 2.0], "a", "{}"), (4, [float("nan")], "a", "{}"), (5, [1.0], "aaaa", "{}"), (6, [1.0], "a", "{      }")], "id long, vector array<double>, text string, metadata string")
    assert {r.id: r.reason for r in ingest.bad_vectors(rows, 1, 3, 5).collect()} == {2: "missing", 3: "dimension", 4: "not finite", 5: "text", 6: "metadata"}


def test_streams_drop_repeats_and_write_logs(spark, tmp_path):
    events = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, key string").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    once = once_per_key(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "key")
    write_log(once, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    # A second run finds nothing new.
    write_log(once, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
