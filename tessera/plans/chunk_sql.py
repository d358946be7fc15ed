"""Both chunkers in DuckDB's SQL, as recursive queries over a table ``src`` (doc_id, text)."""

from __future__ import annotations

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _finished(pieces: str, overlap: int) -> str:
    """From pieces (doc_id, low, text) in order of ``low``: stripped, numbered, and with overlap."""
    return f""",
stripped AS (SELECT doc_id, low + length(text) - length(ltrim(text, {SPACES})) AS pos, trim(text, {SPACES}) AS text FROM {pieces}),
numbered AS (SELECT *, row_number() OVER w - 1 AS chunk_index, lag(text) OVER w AS before FROM stripped WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ends_of AS (SELECT *, CASE WHEN before IS NULL THEN '' ELSE right(before, {overlap}) END AS raw FROM numbered),
tails AS (SELECT *, CASE WHEN contains(raw, ' ') THEN substr(raw, strpos(raw, ' ') + 1) ELSE raw END AS tail FROM ends_of)
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CASE WHEN tail <> '' THEN tail || ' ' || text ELSE text END AS text,
  CAST(greatest(0, pos - length(raw) - CASE WHEN tail <> '' THEN 1 ELSE 0 END) AS BIGINT) AS char_start, CAST(pos + length(text) AS BIGINT) AS char_end FROM tails"""


def recursive_sql(src: str, size: int, overlap: int) -> str:
    """Spans that are too long are cut at the farthest end of a separator that fits, else at the nearest one; the first part goes to the next finer separator, the rest stays."""
    separators = "CASE level WHEN 0 THEN chr(10) || chr(10) WHEN 1 THEN chr(10) WHEN 2 THEN '. ' ELSE ' ' END"
    return f"""WITH RECURSIVE src AS ({src}),
spans AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS low, CAST(length(text) AS BIGINT) AS high, 0 AS level FROM src WHERE trim(text, {SPACES}) <> ''
  UNION ALL SELECT doc_id, text, CASE WHEN side = 0 THEN low ELSE cut END, CASE WHEN side = 0 THEN cut ELSE high END, CASE WHEN side = 0 THEN level + 1 ELSE level END
  FROM (SELECT *, CASE WHEN contains(near, sep) THEN low + {size} - length(string_split(near, sep)[-1]) WHEN strpos(own, sep) > 0 THEN low + strpos(own, sep) - 1 + length(sep) ELSE high END AS cut
    FROM (SELECT *, {separators} AS sep, substr(text, low + 1, {size}) AS near, substr(text, low + 1, high - low) AS own FROM spans WHERE high - low > {size} AND level < 4)), (VALUES (0), (1)) sides(side)
  WHERE side = 0 OR cut < high),
pieces AS (SELECT doc_id, low, substr(text, low + 1, high - low) AS text FROM spans WHERE high - low <= {size}
  UNION ALL SELECT doc_id, k, substr(text, k + 1, least({size}, high - k)) FROM (SELECT doc_id, text, high, unnest(range(low, high, {size})) AS k FROM spans WHERE high - low > {size} AND level = 4))
{_finished('pieces', overlap)}"""


def paragraph_sql(src: str, size: int, overlap: int) -> str:
    """Items are paragraphs that fit, and the sentences of those that don't; one at a time, each is added to what is held or ends it, and an item that is too long leaves windows."""
    located = lambda column, sep, length: f"SELECT *, start0 + coalesce(CAST(sum(length(part) + {length}) OVER (PARTITION BY {column} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start"
    return f"""WITH RECURSIVE src AS ({src}),
split1 AS (SELECT doc_id, CAST(0 AS BIGINT) AS start0, unnest(string_split(text, chr(10) || chr(10))) AS part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n FROM src WHERE text IS NOT NULL),
paragraphs AS (SELECT doc_id, n AS p, trim(part, {SPACES}) AS para, start + length(part) - length(ltrim(part, {SPACES})) AS start0 FROM ({located('doc_id', 'nn', 2)} FROM split1) WHERE trim(part, {SPACES}) <> ''),
split2 AS (SELECT doc_id, p, start0, unnest(string_split(replace(para, '. ', '.' || chr(10)), chr(10))) AS part, generate_subscripts(string_split(replace(para, '. ', '.' || chr(10)), chr(10)), 1) AS n FROM paragraphs WHERE length(para) > {size}),
items AS (SELECT doc_id, p, 1 AS n, para AS part, start0 AS start, chr(10) || chr(10) AS glue, false AS opens FROM paragraphs WHERE length(para) <= {size}
  UNION ALL SELECT doc_id, p, n, part, start, ' ', n = 1 FROM ({located('doc_id, p', 'n', 1)} FROM split2)),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, n) AS i FROM items),
steps AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS held, CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(text VARCHAR, low BIGINT)[]) AS done FROM (SELECT DISTINCT doc_id FROM items)
  UNION ALL SELECT doc_id, i,
    CASE WHEN fits THEN CASE WHEN was <> '' THEN was || glue || part ELSE part END WHEN length(part) > {size} THEN substr(part, (length(part) - 1) // {size} * {size} + 1) ELSE part END,
    CASE WHEN fits THEN CASE WHEN was <> '' THEN pos ELSE start END WHEN length(part) > {size} THEN start + (length(part) - 1) // {size} * {size} ELSE start END,
    list_concat(CASE WHEN (opens OR NOT fits) AND trim(held, {SPACES}) <> '' THEN [{{'text': held, 'low': pos}}] ELSE [] END,
      CASE WHEN NOT fits AND length(part) > {size} THEN list_transform(range(0, (length(part) - 1) // {size}), lambda k: {{'text': substr(part, k * {size} + 1, {size}), 'low': start + k * {size}}}) ELSE [] END)
  FROM (SELECT *, length(was) + length(glue) + length(part) <= {size} AS fits FROM (SELECT x.*, s.held, s.pos, CASE WHEN x.opens THEN '' ELSE s.held END AS was FROM steps s JOIN placed x ON x.doc_id = s.doc_id AND x.i = s.i + 1))),
pieces AS (SELECT doc_id, d.low AS low, d.text AS text FROM (SELECT doc_id, unnest(done) AS d FROM steps)
  UNION ALL SELECT doc_id, pos, held FROM (SELECT doc_id, max_by(held, i) AS held, max_by(pos, i) AS pos FROM steps GROUP BY doc_id) WHERE trim(held, {SPACES}) <> '')
{_finished('pieces', overlap)}"""
