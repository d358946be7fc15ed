"""What a chat turn is given: sources in order, cut to a budget of characters."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.metadata import metadata_field

#: Bounds of the budget, characters kept free for each source, and what stands between sources.
LEAST, MOST, SPARE, BETWEEN = 100, 200_000, 16, "\n\n---\n\n"
NOTHING = "(no matching chunks were found)"
#: Characters of a document's metadata, elements of a source, characters of an element.
METADATA_CHARS, MAX_ELEMENTS, ELEMENT_CHARS = 1600, 5, 600


def label(document: Column, filename: Column, chunk: Column, page: Column) -> Column:
    """What a source is called, from the parts that it has; empty without any."""
    parts = F.array_compact(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f"{name} "), c.cast("string"))) for name, c in (("document_id", document), ("filename", filename), ("chunk", chunk), ("page", page)))))
    return F.when(F.size(parts) > 0, F.concat(F.lit(" ("), F.array_join(parts, ", "), F.lit(")"))).otherwise("")


@F.pandas_udf(StringType())
def _plain_json(values: pd.Series) -> pd.Series:
    """JSON with sorted keys, spaces after commas and colons, and nothing but ASCII."""
    return values.map(lambda v: None if v is None else json.dumps(json.loads(v), ensure_ascii=True, sort_keys=True))


def metadata_extra(metadata: Column, chunk_index: Column) -> Column:
    """What a source shows of its document's metadata (VARIANT): its field ``document_metadata``, or all of it if the source is no chunk.

    Empty unless that is an object with fields. A null field counts as missing.
    """
    own = metadata_field(metadata, "document_metadata")
    shown = F.when(own.isNotNull() & ~F.is_variant_null(own), own).when(chunk_index.isNull(), metadata)
    fields = F.try_variant_get(shown, "$", "map<string, variant>")
    text = _plain_json(F.when(F.startswith(F.schema_of_variant(shown), F.lit("OBJECT")) & (F.size(fields) > 0), F.to_json(shown)))
    return F.coalesce(F.concat(F.lit("\nDocument metadata: "), F.substring(text, 1, METADATA_CHARS)), F.lit(""))


def elements_extra(elements: Column) -> Column:
    """What a source shows of its first elements (structs with kind, summary, caption, text): the first of the three that isn't empty. Empty without elements."""

    def line(e: Column) -> Column:
        detail = F.coalesce(*(F.nullif(e[c], F.lit("")) for c in ("summary", "caption", "text")))
        return F.concat(F.lit("- "), e["kind"], F.coalesce(F.concat(F.lit(": "), F.substring(detail, 1, ELEMENT_CHARS)), F.lit("")))

    lines = F.array_join(F.transform(F.slice(elements, 1, MAX_ELEMENTS), line), "\n")
    return F.when(F.size(elements) > 0, F.concat(F.lit("\n\nRetrieved elements:\n"), lines)).otherwise("")


def context_block(sources: Column, max_chars: int) -> Column:
    """One text of numbered sources (label, text, extra), in order, until the budget is used up; texts are cut, labels and extras never.

    A fold over the ordered array, for what a source may use depends on what the ones before it used.
    """
    budget = max(LEAST, min(max_chars, MOST))
    start = F.struct(F.lit(budget).alias("left"), F.lit(0).alias("n"), F.lit(True).alias("open"), F.lit("").alias("text"))

    def add(state: Column, source: Column) -> Column:
        head = F.concat(F.lit("["), (state["n"] + 1).cast("string"), F.lit("]"), source["label"], F.lit(" "))
        fixed = F.length(head) + F.length(source["extra"])
        room = state["left"] - fixed - SPARE
        text = F.substring(source["text"], F.lit(1), F.greatest(room, F.lit(0)))
        joined = F.concat(state["text"], F.when(state["n"] > 0, BETWEEN).otherwise(""), head, text, source["extra"])
        more = F.struct((state["left"] - fixed - F.length(text)).alias("left"), (state["n"] + 1).alias("n"), F.lit(True).alias("open"), joined.alias("text"))
        shut = F.struct(state["left"].alias("left"), state["n"].alias("n"), F.lit(False).alias("open"), state["text"].alias("text"))
        return F.when(state["open"] & (room > 0), more).otherwise(shut)

    return F.when(F.size(sources) > 0, F.aggregate(sources, start, add)["text"]).otherwise(NOTHING)


def context_blocks(hits: DataFrame, max_chars: int) -> DataFrame:
    """Rows (query_id, context) of hits (query_id, rank, label, text, extra)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "label", "text", "extra")))
    return hits.groupBy("query_id").agg(context_block(ordered, max_chars).alias("context"))


def mentioned(messages: DataFrame, ids: DataFrame, pattern: str = r"\b\d+\b") -> DataFrame:
    """Rows (message_id, doc_id, place): documents whose exact id stands in a message, by their first mention."""
    found = messages.select("message_id", F.posexplode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("place", "id"))
    return found.join(ids.select(F.col("doc_id").cast("string").alias("id"), "doc_id"), "id").select("message_id", "doc_id", F.col("place").cast("long").alias("place"))


def sources_in_order(exact: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Rows (message_id, doc_id, source_rank): documents named exactly first, then retrieved ones that aren't among them, each document once.

    exact: message_id, doc_id, place; retrieved: message_id, doc_id, rank.
    """
    first = exact.select("message_id", "doc_id", F.lit(0).alias("group"), F.col("place").alias("at"))
    rest = retrieved.join(exact.select("message_id", "doc_id"), ["message_id", "doc_id"], "left_anti").groupBy("message_id", "doc_id").agg(F.min("rank").alias("at"))
    both = first.unionByName(rest.withColumn("group", F.lit(1)))
    return both.select("message_id", "doc_id", F.row_number().over(Window.partitionBy("message_id").orderBy("group", "at", "doc_id")).cast("long").alias("source_rank"))
