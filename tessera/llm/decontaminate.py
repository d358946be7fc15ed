"""Benchmark decontamination with one Aho-Corasick automaton over the words of test items."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filter_values, map_values, materialise

#: Words: ASCII digits and letters, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
RATIO = 20
#: Characters of test items in one automaton, and so in one broadcast; more items are scanned in further blocks.
BLOCK_CHARS = 8_000_000

_find = re.compile(WORD).finditer
_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(WORD, text.translate(_lower)) if text else []


class Automaton:
    """Aho-Corasick over word numbers; every window of every item is a pattern."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.items, self.width = items, width
        self._build()

    def _build(self) -> None:
        numbers: dict[str, int] = {}
        patterns: dict[tuple[int, ...], set[str]] = {}
        for name, text in self.items:
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in words(text)]
            for k in range(max(1, len(ids) - self.width + 1) if ids else 0):
                patterns.setdefault(tuple(ids[k : k + self.width]), set()).add(name)
        self.numbers, self.names = numbers, [frozenset(v) for v in patterns.values()]
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, p in enumerate(patterns):
            self.trie.add_word(p, (len(p), k))
        if patterns:
            self.trie.make_automaton()

    def __reduce__(self):
        return Automaton, (self.items, self.width)

    def scan(self, found: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of word places that windows cover, and the items whose windows occur."""
        if not self.names or not found:
            return [], set()
        get = self.numbers.get
        ends: dict[int, int] = {}
        seen: set[int] = set()
        for end, (n, k) in self.trie.iter(tuple([get(w, 0) for w in found])):
            ends[end] = max(n, ends.get(end, 0))
            seen.add(k)
        spans: list[tuple[int, int]] = []
        for start, end in sorted((e - n + 1, e + 1) for e, n in ends.items()):
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], end))
            else:
                spans.append((start, end))
        return spans, set().union(*(self.names[k] for k in seen))


_cache: dict[str, Automaton] = {}


def _automaton(items: list[tuple[str, str]], width: int) -> Automaton:
    """The automaton, built once in each Python worker."""
    key = hashlib.sha256(repr((items, width)).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _cache:
        _cache.clear()
        _cache[key] = Automaton(items, width)
    return _cache[key]


_FOUND = "n_words long, n_hit long, spans array<array<long>>, offsets array<array<long>>, items array<string>"


def _scan(shared, width: int):
    def make(texts: list[str | None]) -> list[list]:
        automaton = _automaton(shared.value, width)
        rows = []
        for text in texts:
            found = words(text)
            spans, names = automaton.scan(found)
            places = [(m.start(), m.end()) for m in _find(text.translate(_lower))] if spans else []
            original = [[places[a][0], places[b - 1][1]] for a, b in spans]
            rows.append((len(found), sum(b - a for a, b in spans), [list(s) for s in spans], original, sorted(names)))
        return [list(x) for x in zip(*rows, strict=True)] or [[]] * 5

    return make


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[str, str]]]:
    """The test items in blocks of at most about ``limit`` characters; the driver holds one block at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    block: list[tuple[str, str]] = []
    n = 0
    for r in rows.orderBy("item", "text").toLocalIterator():
        if block and n + len(r.text) > limit:
            yield block
            block, n = [], 0
        block.append((r.item, r.text))
        n += len(r.text)
    yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", width: int = WINDOW, limit: int = BLOCK_CHARS) -> DataFrame:
    """Rows (id, n_words, n_hit, spans, offsets, items), one for each row of docs.

    spans are places of hit words, offsets the same spans in characters of the
    original text, items the names of the test items whose windows occur. Each
    text is scanned once for each block of the benchmark; with one block, which is
    what benchmarks of up to ``limit`` characters are, nothing is shuffled.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("doc_id"), "text")
    only, parts = _blocks_ahead(benchmark, limit)
    if only is not None:
        return map_values(source, "text", _FOUND, _scan(spark.sparkContext.broadcast(only), width))
    # Rows get a number of their own, as ids may be null or repeat.
    source = materialise(source.withColumn("_row", F.monotonically_increasing_id()), "texts")
    merged = _scan_blocks(source.select("_row", "text"), parts, width)
    return source.select("doc_id", "_row").join(merged, "_row").select("doc_id", "n_words", "n_hit", "spans", "offsets", "items")


def _blocks_ahead(benchmark: DataFrame, limit: int) -> tuple[list[tuple[str, str]] | None, Iterator[list[tuple[str, str]]]]:
    """The only block, or None and all blocks; they are taken one by one."""
    if limit < 1:
        raise ValueError("a block holds at least one character")
    parts = blocks(benchmark, limit)
    ahead = list(itertools.islice(parts, 2))
    return (ahead[0] if len(ahead) == 1 else None), itertools.chain(ahead, parts)


def _scan_blocks(source: DataFrame, parts: Iterator[list[tuple[str, str]]], width: int) -> DataFrame:
    """Rows (_row, n_words, n_hit, spans, offsets, items), one for each row of source (_row, text).

    Each block's hits are written before the next block is taken, and its broadcast is released.
    """
    found = []
    for k, part in enumerate(parts):
        shared = source.sparkSession.sparkContext.broadcast(part)
        hits = map_values(source, "text", _FOUND, _scan(shared, width))
        # The first block brings every row, the others those that they hit.
        found.append(materialise(hits.where("n_hit > 0") if k else hits, "hits"))
        shared.destroy()
    union = found[0]
    for f in found[1:]:
        union = union.union(f)
    merged = union.groupBy("_row").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.flatten(F.collect_list("offsets")).alias("offsets"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def joined(column: str):
        """Sorted spans, overlapping and touching ones joined."""
        last = lambda acc: F.element_at(acc, -1)
        grow = lambda acc, s: F.when((F.size(acc) > 0) & (s[0] <= F.element_at(last(acc), 2)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(last(acc)[0], F.greatest(F.element_at(last(acc), 2), s[1]))))).otherwise(F.concat(acc, F.array(s)))
        return F.aggregate(F.array_sort(column), F.lit([]).cast("array<array<long>>"), grow)

    merged = merged.withColumn("spans", joined("spans")).withColumn("offsets", joined("offsets"))
    return merged.select("_row", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0]).alias("n_hit"), "spans", "offsets", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, ratio: int = RATIO, limit: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, offsets), one for each row of docs (doc_id, text).

    A window is 13 consecutive words of a test item; an item of fewer words is one
    window, one without words none. Null and empty texts have no words and are
    clean. Repeated rows and null ids are each returned. Items of equal id are one
    item; a null item_id is named by the empty string. An empty benchmark leaves
    every document clean, and an empty table gives no rows. Other columns are
    ignored.
    """
    found = find_passages(docs, benchmark, width=width, limit=limit)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * ratio >= F.col("n_words"))).alias("contaminated"), "offsets",
    )


def _clean(shared, width: int, ratio: int):
    def keep(texts: list[str | None]) -> list[bool]:
        automaton = _automaton(shared.value, width)
        found = [words(t) for t in texts]
        hits = [sum(b - a for a, b in automaton.scan(f)[0]) for f in found]
        return [not (h and ratio * h >= len(f)) for h, f in zip(hits, found, strict=True)]

    return keep


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, ratio: int = RATIO, limit: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that aren't contaminated, columns as in docs.

    Every row is judged by its own text, whatever its id. A benchmark of more than
    one block is scanned block by block, and verdicts return by row number.
    """
    only, parts = _blocks_ahead(benchmark, limit)
    if only is not None:
        return filter_values(docs, "text", _clean(docs.sparkSession.sparkContext.broadcast(only), width, ratio))
    # Columns of docs stay in a struct, so that none can clash with the row's number.
    rows = materialise(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row")), "rows")
    found = _scan_blocks(rows.select("_row", F.col("doc.text").alias("text")), parts, width)
    bad = found.where((F.col("n_hit") > 0) & (F.col("n_hit") * ratio >= F.col("n_words"))).select("_row")
    return rows.join(bad, "_row", "left_anti").select("doc.*")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS r FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT item, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS k FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, k, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, ns WHERE len(ws) >= n)),
h AS (SELECT r, dw.n, k, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
c AS (SELECT r, count(DISTINCT p)::LONG AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(*)::LONG AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(ws)::LONG AS n_words, coalesce(n_hit, 0)::LONG AS n_hit, coalesce(n_items, 0)::LONG AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""
