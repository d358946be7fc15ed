"""License scans by sentence rules, with DataFrame expressions alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised (lower case, runs of other characters as one space), and their identifiers.
SENTENCES: dict[str, int] = {
    "released under the mit license": 1,
    "licensed under the mit license": 1,
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": 2,
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": 3,
    "licensed under the apache license version 2 0": 4,
    "you may not use this file except in compliance with the license": 5,
    "this work is licensed under the gnu general public license version 3": 6,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": 7,
    "this program is distributed in the hope that it will be useful but without any warranty": 8,
    "licensed under cc by nc 4 0": 9,
    "licensed under cc by 4 0": 10,
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": 11,
    "this software is provided by the copyright holders and contributors as is": 12,
    "all rights reserved": 13,
}
# Ordered rules (licence, sentence identifiers that follow each other, whether use is permitted). The longest that fits a place takes it.
RULES: tuple[tuple[str, tuple[int, ...], bool], ...] = (
    ("Apache-2.0", (4, 5), True),
    ("Apache-2.0", (4,), True),
    ("MIT", (2, 3), True),
    ("MIT", (1,), True),
    ("BSD", (11, 12), True),
    ("BSD", (11,), True),
    ("GPL-3.0", (6,), False),
    ("GPL", (7, 8), False),
    ("GPL", (7,), False),
    ("CC-BY-NC-4.0", (9,), False),
    ("CC-BY-4.0", (10,), True),
    ("Proprietary", (13,), False),
)
#: Whole sentences of the standard notices that the table only begins, and the identifiers that they stand for.
NOTICES: dict[str, tuple[int, ...]] = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": (2,),
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": (3,),
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": (4, 5),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": (15,),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license": (15,),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": (14,),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": (14,),
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": (8,),
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": (12,),
}
#: Notices that name the version of the GPL have identifiers of their own.
NOTICE_RULES: tuple[tuple[str, tuple[int, ...], bool], ...] = (("GPL-3.0", (15, 8), False), ("GPL-3.0", (15,), False), ("GPL", (14, 8), False), ("GPL", (14,), False))
#: Marks of a line's end and of a sentence's end in a normalised text.
LINE, STOP = "\n", "\x01"


def _normalised(text: str) -> Column:
    """The text in lower case, runs of other characters as one space, LINE at a line's end, STOP at a stop followed by white space or the text's end and at a blank line."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + STOP, "abcdefghijklmnopqrstuvwxyz ")
    kept = F.regexp_replace(F.regexp_replace(lower, r"[.!?]+(?=\s|$)", STOP), r"[^0-9a-z\x{80}-\x{10FFFF}\n\x01]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r" ?([\n\x01]) ?", "$1"), r"\n{2,}", STOP))


def _joined(x: Column, flat: Column, forms: Mapping[str, str]) -> Column:
    """x, with every known sentence that runs over line ends in its stored form; flat is x with spaces for line ends."""
    out = x
    for s in sorted(forms, key=lambda s: (-len(s), s)):
        out = F.regexp_replace(out, rf"(?<=^|[\n\x01]){s.replace(' ', '[ \\n]')}(?=$|[\n\x01])", forms[s])
    some = F.lit(False)
    for s in forms:
        some = some | flat.contains(s)
    return F.when(some, out).otherwise(x)


def _longest_first(rules: Sequence[tuple[str, tuple[int, ...], bool]]) -> list[tuple[int, tuple[int, ...]]]:
    """Numbers and identifiers of the rules, the longest first; rules of one length in their order."""
    return sorted(((k, ids) for k, (_, ids, _) in enumerate(rules)), key=lambda r: -len(r[1]))


def _sequence(ids: Sequence[int]) -> str:
    return "".join(f"<{k}>" for k in ids)


def scan_licenses(docs: DataFrame, sentences: Mapping[str, int] = SENTENCES, rules: Sequence[tuple[str, tuple[int, ...], bool]] = RULES + NOTICE_RULES, notices: Mapping[str, tuple[int, ...]] = NOTICES) -> DataFrame:
    """Rows (doc_id, n_sentences, n_known, sentence_ids, licenses, primary_license, permitted), one for each row of docs.

    A sentence ends at a stop, a blank line or a line's end, but a known sentence
    may run over line ends; notices are longer forms of known sentences and count as these.
    Each sentence becomes its identifier, or 0; sentence_ids lists the known
    identifiers in order. A rule fits where its identifiers follow each other
    without another sentence between. licenses lists, in the order of the rules,
    all that fit; primary_license is the first of them and permitted says whether
    all of them permit use (null without a licence). Everything is an expression
    over one row: no shuffle, whatever holds the rows.

    Null and empty texts have no sentence and no licence. Rows of equal or null id
    are each returned, other columns are ignored, an empty table gives no rows.
    """
    stored = {}
    for s, k in sentences.items():
        stored.setdefault(k, s)
    forms = {s: s for s in sentences} | {s: STOP.join(stored.get(k, s) for k in ids) for s, ids in notices.items()}
    known = dict(sentences) | {s: ids[0] for s, ids in notices.items() if not set(ids) & set(stored)}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = docs.select("doc_id", _normalised("text").alias("x")).withColumn("flat", F.translate("x", LINE, " "))
    found = found.select("doc_id", F.filter(F.split(_joined(F.col("x"), F.col("flat"), forms), r"[\n\x01]"), lambda s: s != "").alias("s"))
    found = found.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.transform("s", lambda s: F.coalesce(F.try_element_at(table, s), F.lit(0))).alias("ids"))
    line = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x.cast("string"), F.lit(">"))), "")
    for k, ids in _longest_first(rules):
        line = F.replace(line, F.lit(_sequence(ids)), F.lit(f"{{{k}}}"))
    found = found.select("doc_id", "n_sentences", F.filter("ids", lambda x: x > 0).alias("sentence_ids"), line.alias("line"))
    fits = [(name, ok, F.col("line").contains(f"{{{k}}}")) for k, (name, _, ok) in enumerate(rules)]
    named = F.filter(F.array(*[F.when(hit, F.struct(F.lit(name).alias("name"), F.lit(ok).alias("ok"))) for name, ok, hit in fits]), lambda x: x.isNotNull())
    found = found.withColumn("named", named)
    return found.select(
        "doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join(F.transform("sentence_ids", lambda x: x.cast("string")), ",").alias("sentence_ids"),
        F.array_join(F.array_distinct(F.transform("named", lambda x: x["name"])), ",").alias("licenses"), F.try_element_at("named", F.lit(1))["name"].alias("primary_license"),
        F.when(F.size("named") > 0, F.forall("named", lambda x: x["ok"])).alias("permitted"),
    )


def _oracle() -> str:
    known = ", ".join(f"('{s}', {n})" for s, n in SENTENCES.items())
    rules = ", ".join(f"({k}, '{name}', '{{{k}}}', {str(ok).lower()})" for k, (name, _, ok) in enumerate(RULES))
    line = "string_agg('<' || coalesce(id, 0)::VARCHAR || '>', '' ORDER BY p)"
    for k, ids in _longest_first(RULES):
        line = f"replace({line}, '{_sequence(ids)}', '{{{k}}}')"
    return rf"""
WITH k(s, id) AS (VALUES {known}), rules(o, name, mark, ok) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.!?]+(\s|$)', chr(10), 'g'), '\n'),
  lambda x: trim(regexp_replace(x, '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'))), lambda x: x <> '') AS s FROM documents),
u AS (SELECT r, unnest(s) AS s, unnest(range(len(s))) AS p FROM d),
m AS (SELECT r, {line} AS line, count(id) AS n_known, string_agg(id::VARCHAR, ',' ORDER BY p) FILTER (id IS NOT NULL) AS ids FROM u LEFT JOIN k ON u.s = k.s GROUP BY r),
f AS (SELECT r, name, min(o) AS o, bool_and(ok) AS ok FROM m JOIN rules ON contains(line, rules.mark) GROUP BY r, name),
g AS (SELECT r, string_agg(name, ',' ORDER BY o) AS licenses, arg_min(name, o) AS primary_license, bool_and(ok) AS permitted FROM f GROUP BY r)
SELECT doc_id, len(s)::LONG AS n_sentences, coalesce(n_known, 0)::LONG AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, primary_license, permitted
FROM d LEFT JOIN m USING (r) LEFT JOIN g USING (r)
"""


ORACLE = _oracle()
