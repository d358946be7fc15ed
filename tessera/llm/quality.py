"""Quality rules on repetition, from a suffix array over each text's words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_values, utf8

#: Words sorted at a time; texts are sorted together up to this many, and a longer text alone.
CHUNK = 1 << 18
#: A repeat counts towards the covered share from this many words on.
MIN_REPEAT = 8
#: Most that repeats may cover, in hundredths of the words, and the longest repeat allowed, in words.
MAX_COVERED, MAX_LONGEST = 30, 100
MIN_WORDS, MAX_REPEAT_WORDS, WIDTH = 50, 50, 3


def repeat_lengths(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place the longest run of symbols from there that also starts elsewhere in the same text.

    ids are the texts' symbols, one text after the other; ends[i] is the end of
    the text that holds place i. Suffixes are sorted by prefix doubling, only those
    still tied; the ranks of each doubling then give the common prefixes of
    neighbours, from long to short. The result is the larger of a suffix's two.
    """
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    key = ends.astype(np.int64) * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    first = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank.astype(np.int32)], 1
    while True:
        sizes = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(sizes[rank] > 1)
        if not len(tied):
            break
        after = tied + step
        second = np.where(after < ends[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        by = tied[np.lexsort((second, rank[tied]))]
        after = by + step
        second = np.where(after < ends[by], rank[np.minimum(after, n - 1)] + 1, 0)
        old = rank[by]
        at = np.arange(len(by))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        part = np.maximum.accumulate(np.where(np.r_[True, (old[1:] != old[:-1]) | (second[1:] != second[:-1])], at, 0))
        rank[by] = old + part - group
        step *= 2
        levels.append(rank.astype(np.int32))
    suffixes = np.argsort(rank)
    i, j = suffixes[:-1], suffixes[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + common, j + common
        inside = (a < ends[i]) & (b < ends[j])
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        common[same] += 1 << k
    longest[i] = common
    longest[j] = np.maximum(longest[j], common)
    return longest


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def repetition(texts: list[list[bytes]], width: int = WIDTH, least: int = MIN_REPEAT) -> list[tuple[int, int, int]]:
    """Per text: words in repeated windows of ``width``, words in maximal repeats of at least ``least`` words, and the longest repeat."""
    lengths = np.array([len(t) for t in texts], np.int64)
    total = int(lengths.sum())
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    ids = np.fromiter((number(w, len(numbers)) for t in texts for w in t), np.int64, total)
    stops = np.cumsum(lengths)
    ends = np.repeat(stops, lengths)
    longest = repeat_lengths(ids, ends)
    in_window = np.flatnonzero(longest >= width)
    repeated = _covered(in_window, np.full(len(in_window), width), total)
    # A repeat that is the tail of the one a place before isn't maximal and adds nothing.
    tail = np.r_[False, (longest[:-1] == longest[1:] + 1) & (ends[:-1] == ends[1:])] if total else np.zeros(0, bool)
    maximal = np.flatnonzero((longest >= least) & ~tail)
    covered = _covered(maximal, longest[maximal], total)
    one, two = np.r_[0, np.cumsum(repeated)], np.r_[0, np.cumsum(covered)]
    starts = stops - lengths
    return [(int(one[b] - one[a]), int(two[b] - two[a]), int(longest[a:b].max()) if b > a else 0) for a, b in zip(starts, stops, strict=True)]


def _measure(width: int, least: int):
    def make(bodies: list[bytes]) -> list[list[int]]:
        found: list[tuple[int, int, int, int]] = []
        group: list[list[bytes]] = []
        held = 0
        for body in [*bodies, None]:
            words = body.split() if body is not None else []
            if group and (body is None or held + len(words) > CHUNK):
                found += [(len(t), *r) for t, r in zip(group, repetition(group, width, least), strict=True)]
                group, held = [], 0
            if body is not None:
                group.append(words)
                held += len(words)
        return [list(x) for x in zip(*found, strict=True)] or [[]] * 4

    return make


def quality_rules(docs: DataFrame, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST, least: int = MIN_REPEAT) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat, base_failed, kept), one for each row of docs.

    A suffix array over a text's words gives its maximal repeats. A text is
    rejected if repeats of at least ``least`` words cover over max_covered
    hundredths of its words, or if one is longer than max_longest words, or by the
    base rules. Places of a repeat may overlap.

    Null and empty texts have no words and fail the base rules. Repeated rows and
    null ids are each returned, other columns are ignored, an empty table gives no
    rows. Nothing is shuffled; a task holds one batch of texts and the suffixes of
    CHUNK words, or those of one longer text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = docs.select(
        "doc_id", utf8().alias("body"), F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    measured = map_values(counts, "body", "n_words long, n_repeat_words long, n_covered long, longest_repeat long", _measure(WIDTH, least))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_WORDS * F.col("n_words"))
    fine = (100 * F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", base.alias("base_failed"), (~base & fine).alias("kept"))
