"""Token ids in a binary format: a range coder driven by a mix of order-0 to order-2 predictions, in independent blocks."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import scratch_root

#: Ids of one block at most, ids of one of its lanes about, and lanes coded together about, one array element each.
BLOCK, LANE, LANES = 1 << 16, 512, 8192
#: A block begins with these bytes, the numbers of its ids, of distinct ids, of bytes of their table and of all bytes behind the head, the crc32 of the ids, and that of all else in the block.
MAGIC, HEAD = b"TTK3", struct.Struct("<4sIIIIII")
END_ID = 0
#: Slots of a block's order-1 and order-2 tables, and confidence levels of a prediction.
SLOTS, LEVELS = 1 << 12, 8
#: The weights of a mix end at 1 << BITS, of which order 0 has LEAST or more; order-0 frequencies end at 1 << ORDER0, which gives each id of a block one or more.
BITS, ORDER0 = 15, 16
TOTAL = 1 << BITS
LEAST = TOTAL >> 6
#: Bytes of text that a part holds about, and bytes that are tokenized together.
PART_BYTES, GROUP_BYTES = 16 << 20, 8 << 20
#: Pieces of text whose ids a Python worker remembers at most.
KNOWN_PIECES = 1_000_000

_LOW = (1 << 32) - 1


class _Contexts:
    """Order-1 and order-2 predictions of all lanes; coder and decoder update them alike.

    A context's slot holds an id and a confidence. The lanes of a block share its slots, and of several that write one
    slot in a step the last stays; their order is the same whichever blocks are coded together. Ids are numbers in the block's alphabet, from 1; 0 is none.
    """

    def __init__(self, block: np.ndarray, blocks: int):
        self.base = block * SLOTS
        self.tables = [np.zeros(blocks * SLOTS, np.int32) for _ in range(2)]
        self.one = self.two = np.zeros(len(block), np.int32)

    def shrink(self, lanes: int) -> None:
        """Go on with the first lanes only."""
        self.base, self.one, self.two = self.base[:lanes], self.one[:lanes], self.two[:lanes]

    def predict(self) -> np.ndarray:
        """8 times the order-2 confidence and the order-1 confidence, which choose the weights of the mix."""
        first = self.one * np.int32(40503)
        second = first + self.two
        first >>= 4
        second *= np.int32(-1640531535)
        second >>= 17
        first &= SLOTS - 1
        second &= SLOTS - 1
        # Indexes of 64 bits, as numpy would turn others into these each time.
        self.at = (first + self.base, second + self.base)
        self.had = [t.take(at, mode="clip") for t, at in zip(self.tables, self.at, strict=True)]
        self.level = [e & LEVELS - 1 for e in self.had]
        self.guess = [e >> 3 for e in self.had]
        both = self.level[1] << 3
        both += self.level[0]
        return both

    def learn(self, ids: np.ndarray) -> None:
        """A hit raises the confidence, a miss halves it; without confidence, the slot takes the new id."""
        fresh = ids << 3
        for table, at, had, level, guess in zip(self.tables, self.at, self.had, self.level, self.guess, strict=True):
            less = had - level
            less += level >> 1
            new = np.where(level > 1, less, fresh)
            hit = np.flatnonzero(guess == ids)
            new[hit] = np.minimum(had.take(hit) + 1, fresh.take(hit) | LEVELS - 1)
            table[at] = new
        self.two, self.one = self.one, ids


def _many_lanes(n: int) -> int:
    """Lanes of a block of n ids."""
    return -(-n // LANE)


class _Layout:
    """Lanes of blocks of so many ids: each block's ids in runs of equal length, one behind the other. Longest lanes come first."""

    def __init__(self, sizes: list[int]):
        self.sizes, self.many = sizes, [_many_lanes(n) for n in sizes]
        self.long = [-(-n // max(1, k)) for n, k in zip(sizes, self.many, strict=True)]
        block = np.repeat(np.arange(len(sizes)), self.many)
        size, many, long = (np.array(x, np.int64)[block] for x in (sizes, self.many, self.long))
        number = np.arange(len(block)) - (np.cumsum(self.many) - self.many)[block]
        length = np.minimum(long, size - number * long)
        #: order: the lane, block by block, that stands at each place; column: the place of each lane.
        self.order = np.argsort(-length, kind="stable")
        self.column = np.argsort(self.order)
        self.block, self.length = block[self.order], length[self.order]
        self.steps = int(length.max(initial=0))
        #: Lanes that still have ids at each step.
        self.live = (len(length) - np.searchsorted(self.length[::-1], np.arange(self.steps), side="right")).tolist()

    def places(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each block's steps, and where its lanes stand."""
        at = 0
        for long, many in zip(self.long, self.many, strict=True):
            yield long, self.column[at : at + many]
            at += many


def _groups(sizes: list[int]) -> Iterator[list[int]]:
    """Numbers of blocks that are coded together, longest first, in groups of about as many lanes."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    total = sum(_many_lanes(n) for n in sizes)
    wanted = -(-total // max(1, -(-total // LANES)))
    part, lanes = [], 0
    for k in order:
        part.append(k)
        lanes += max(1, _many_lanes(sizes[k]))
        if lanes >= wanted:
            yield part
            part, lanes = [], 0
    if part:
        yield part


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and each id's number among them, from 1."""
    top = int(ids.max(initial=0))
    if not len(ids) or top >= 1 << 20:
        names, number = np.unique(ids, return_inverse=True)
        return names.astype(np.int64), (number + 1).astype(np.int32)
    seen = np.zeros(top + 1, bool)
    seen[ids] = True
    return np.flatnonzero(seen), np.cumsum(seen, dtype=np.int32).take(ids)


def _weights(counts: np.ndarray) -> np.ndarray:
    """Where the order-2 and the order-1 share of a mix end, from how many ids each order foresaw and how many were left to order 0."""
    n = np.maximum(counts.sum(axis=1), 1)
    two = np.clip(counts[:, 0] * TOTAL // n, 1, TOTAL - LEAST - 1)
    one = np.clip((counts[:, 0] + counts[:, 1]) * TOTAL // n, two + 1, TOTAL - LEAST)
    return np.stack([two, one], axis=1)


def _order0(counts: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each id begins in the order-0 frequencies of its block, and its frequency; base is where the blocks' alphabets begin and end."""
    total = np.r_[0, np.cumsum(counts)]
    sizes = np.diff(base)
    begin = np.repeat(total[base[:-1]], sizes)
    many = np.repeat(np.maximum(total[base[1:]] - total[base[:-1]], 1), sizes)
    start = (total[:-1] - begin << ORDER0) // many
    return start, (total[1:] - begin << ORDER0) // many - start


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32, their lowest bytes first."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(body: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Blocks of up to BLOCK ids below 2**32 as bytes, each readable alone. Blocks are coded together, longest first."""
    if any(len(b) > BLOCK for b in blocks):
        raise ValueError(f"a block of more than {BLOCK} token ids")
    out: list[bytes] = [b""] * len(blocks)
    for part in _groups([len(b) for b in blocks]):
        for k, body in zip(part, _encode([blocks[k] for k in part]), strict=True):
            out[k] = body
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    layout = _Layout([len(b) for b in blocks])
    block, n, lanes, live = layout.block, layout.steps, len(layout.block), layout.live
    # The predictions of all steps come first, as the weights and the frequencies follow from them.
    names, ids = [], np.zeros((n, lanes), np.int32)
    for b, (long, places) in zip(blocks, layout.places(), strict=True):
        found, numbers = _alphabet(b)
        names.append(found)
        ids[:long, places] = np.r_[numbers, np.zeros(long * len(places) - len(b), np.int32)].reshape(len(places), long).T
    mix, order = np.zeros((n, lanes), np.int32), np.zeros((n, lanes), np.int8)
    contexts = _Contexts(block, len(blocks))
    for t in range(n):
        w = live[t]
        if w < len(contexts.base):
            contexts.shrink(w)
        x = ids[t, :w]
        mix[t, :w] = contexts.predict()
        missed = (x != contexts.guess[1]).view(np.int8)
        order[t, :w] = missed + (missed & (x != contexts.guess[0]).view(np.int8))
        contexts.learn(x)
    mix += (block * LEVELS * LEVELS).astype(np.int32)
    on = np.arange(n)[:, None] < layout.length
    weights = _weights(np.bincount((mix * 3 + order)[on], minlength=3 * LEVELS * LEVELS * len(blocks)).reshape(-1, 3))
    base = np.r_[0, np.cumsum([len(x) for x in names])]
    ids += (base[block] - 1).astype(np.int32)
    left = on & (order == 2)
    counts = np.bincount(ids[left], minlength=base[-1])
    start0, size0 = _order0(counts, base)
    # A mix's shares of order 2, 1 and 0 begin and end at these four.
    edges = np.pad(weights, ((0, 0), (1, 1)), constant_values=((0, 0), (0, TOTAL))).ravel()
    mix <<= 2
    mix += order
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    who: list[np.ndarray] = []
    words: list[np.ndarray] = []
    for t in range(n):
        w = live[t]
        l, s, share = low[:w], span[:w], mix[t, :w].astype(np.int64)
        step = s >> BITS
        start = edges.take(share, mode="clip")
        share += 1
        size = edges.take(share, mode="clip")
        size -= start
        start *= step
        l += start
        step *= size
        rest = np.flatnonzero(left[t, :w])
        s[:] = step
        x, step = ids[t, :w].take(rest).astype(np.int64), step.take(rest)
        step >>= ORDER0
        l[rest] += step * start0.take(x)
        s[rest] = step * size0.take(x)
        full = np.flatnonzero(s <= _LOW)
        while len(full):
            # Words go out until every span is wide again. The seventeenth bit is a carry into the word before, settled at the end.
            part = low[full]
            who.append(full.astype(np.int16))
            words.append((part >> 32).astype(np.int32))
            low[full] = (part & _LOW) << 16
            wide = span[full] << 16
            span[full] = wide
            full = full[wide <= _LOW]
    for shift in (32, 16, 0):
        who.append(np.arange(lanes, dtype=np.int16))
        words.append((low >> shift if shift == 32 else low >> shift & 0xFFFF).astype(np.int32))
    owner, body = layout.order.astype(np.int16).take(np.concatenate(who)), np.concatenate(words)
    body = body[np.argsort(owner, kind="stable")]
    while (carry := body >> 16).any():
        body &= 0xFFFF
        body[:-1] += carry[1:]
    used, flat = np.bincount(owner, minlength=lanes), body.astype("<u2")
    ends = np.r_[0, np.cumsum(used)]
    out, at, rows = [], 0, LEVELS * LEVELS
    for k, (b, many) in enumerate(zip(blocks, layout.many, strict=True)):
        table = zlib.compress(_planes(np.diff(names[k], prepend=0)) + _planes(counts[base[k] : base[k + 1]]))
        coded = weights[rows * k : rows * (k + 1)].astype("<u2").tobytes() + used[at : at + many].astype("<u2").tobytes() + table + flat[ends[at] : ends[at + many]].tobytes()
        head = HEAD.pack(MAGIC, len(b), len(names[k]), len(table), len(coded), zlib.crc32(b.astype("<u4").tobytes()), 0)[:-4]
        out.append(head + struct.pack("<I", zlib.crc32(coded, zlib.crc32(head))) + coded)
        at += many
    return out


def decode_blocks(bodies: list[bytes]) -> list[np.ndarray]:
    """The ids of blocks; a block that isn't whole, or whose checksum differs, raises ValueError."""
    heads = []
    for b in bodies:
        if len(b) < HEAD.size or (h := HEAD.unpack_from(b))[0] != MAGIC or len(b) != HEAD.size + h[4] or zlib.crc32(memoryview(b)[HEAD.size :], zlib.crc32(b[: HEAD.size - 4])) != h[6]:
            raise ValueError("not a whole block of token ids")
        heads.append(h)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(bodies)
    for part in _groups([h[1] for h in heads]):
        for k, ids in zip(part, _decode([bodies[k] for k in part], [heads[k] for k in part]), strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != heads[k][5]:
                raise ValueError("the checksum of a block of token ids differs")
            out[k] = ids
    return out


def _decode(bodies: list[bytes], heads: list[tuple]) -> list[np.ndarray]:
    layout = _Layout([h[1] for h in heads])
    block, n, lanes, live = layout.block, layout.steps, len(layout.block), layout.live
    names, counts, weights, used, words = [], [], [], [], []
    for b, h, many in zip(bodies, heads, layout.many, strict=True):
        at = HEAD.size + 4 * LEVELS * LEVELS
        weights.append(np.frombuffer(b[HEAD.size : at], "<u2"))
        used.append(np.frombuffer(b[at : at + 2 * many], "<u2"))
        at += 2 * many
        table = zlib.decompress(b[at : at + h[3]])
        names.append(np.cumsum(_unplanes(table, h[2])).astype(np.uint32))
        counts.append(_unplanes(table[4 * h[2] :], h[2]))
        words.append(np.frombuffer(b[at + h[3] :], "<u2"))
    base = np.r_[0, np.cumsum([len(x) for x in names])]
    start0, size0 = _order0(np.concatenate(counts), base)
    # Which id of its block's alphabet holds each order-0 slot.
    holds = np.zeros(len(bodies) << ORDER0, np.uint16)
    for k, (at, end) in enumerate(itertools.pairwise(base.tolist())):
        slots = np.repeat(np.arange(end - at), size0[at:end])
        holds[k << ORDER0 : (k << ORDER0) + len(slots)] = slots
    packed = start0 << ORDER0 + 1 | size0
    edges = np.concatenate(weights).astype(np.int32)
    edges = edges[::2] << 16 | edges[1::2]
    used = np.concatenate(used).astype(np.int64)
    flat = np.concatenate([*words, np.zeros(8, np.uint16)])
    at = (np.cumsum(used) - used)[layout.order]
    code = flat.take(at).astype(np.int64) << 32 | flat.take(at + 1).astype(np.int64) << 16 | flat.take(at + 2)
    at += 3
    span = np.full(lanes, 1 << 48, np.int64)
    out = np.zeros((n, lanes), np.int32)
    contexts = _Contexts(block, len(bodies))
    row, slot, first = block * LEVELS * LEVELS, block << ORDER0, base[block]
    for t in range(n):
        w = live[t]
        if w < len(contexts.base):
            contexts.shrink(w)
            row, slot, first = row[:w], slot[:w], first[:w]
        c, s = code[:w], span[:w]
        mix = contexts.predict()
        edge = edges.take(mix + row, mode="clip")
        one = edge & 0xFFFF
        step = s >> BITS
        # Values below 2**48 and quotients below 2**17 keep floats exact, which divide faster.
        share = (c / step).astype(np.int32)
        hit = np.flatnonzero(share < one)
        wide, two = step.take(hit), edge.take(hit) >> 16
        second = share.take(hit) < two
        hit_code = c.take(hit) - np.where(second, 0, wide * two)
        wide *= np.where(second, two, one.take(hit) - two)
        hit_id = np.where(second, contexts.guess[1].take(hit), contexts.guess[0].take(hit))
        # All lanes as if order 0 held their id, then those that a guess foresaw.
        c -= step * one
        step *= TOTAL - one
        step >>= ORDER0
        k = holds.take((c / step).astype(np.int64) + slot, mode="clip").astype(np.int64)
        place = packed.take(k + first, mode="clip")
        c -= step * (place >> ORDER0 + 1)
        place &= (1 << ORDER0 + 1) - 1
        place *= step
        s[:] = place
        k += 1
        x = k.astype(np.int32)
        c[hit], s[hit], x[hit] = hit_code, wide, hit_id
        full = np.flatnonzero(s <= _LOW)
        while len(full):
            here = at[full]
            code[full] = code[full] << 16 | flat.take(here, mode="clip")
            at[full] = here + 1
            wide = span[full] << 16
            span[full] = wide
            full = full[wide <= _LOW]
        out[t, :w] = x
        contexts.learn(x)
    return [found.take(out[:long, places].T.ravel()[:size] - 1) for found, size, (long, places) in zip(names, layout.sizes, layout.places(), strict=True)]


#: The only pre-tokenizer whose words may be learnt one by one: it never joins what stands before a space to what follows.
_BY_WORDS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: White space other than line ends inside of words and single spaces between them: such a text is tokenized as it stands. A pattern of Arrow, like the next two.
_ODD = r"  | \n|\n |\n\n|^[ \n]|[ \n]\z|[\x00\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Latin letters, with the space before them: what the tokenizer's rules always take as one piece, and the signs behind them, which they take as another.
_LETTERS, _SIGNS = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+\z", "!#$%&*,-./:;<>?@|"
#: Bytes of a text that is tokenized as it stands, as its pieces may not fit an Arrow array.
_HUGE = 1 << 28


def by_words(tokenizer) -> bool:
    """Whether the tokenizer's rules never join what stands before a space to what follows."""
    spec = json.loads(tokenizer.to_str())
    return spec["pre_tokenizer"] == _BY_WORDS and not spec["normalizer"] and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])


def _strings(x: pa.Array) -> list[str]:
    """The strings of an array; far faster than to_pylist."""
    return x.to_numpy(zero_copy_only=False).tolist()


def _copied(x: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Runs of x, which lie one behind the other and are of these sizes, in the order of the numbers given."""
    many = size.take(number)
    at = np.repeat((np.cumsum(size) - size).take(number) - np.cumsum(many) + many, many)
    at += np.arange(len(at))
    return x.take(at)


class _Tokenizer:
    """Ids of texts as little-endian bytes; distinct pieces of texts are tokenized once and remembered, where that can't change the ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        from tessera.llm.alignment import byte_level

        self.whole = Tokenizer.from_file(path)
        newline = self.ids(["\n"])[0]
        #: The id of a line end, which no word without one can have.
        self.newline = int.from_bytes(newline, "little") if by_words(self.whole) and len(newline) == 4 else None
        # Letters are one piece to the byte-level rules, so they are given to the same merges without them, as signs that stand for bytes.
        self.sign_of = {byte: sign for sign, byte in byte_level().items() if byte != 10}
        self.letters = Tokenizer.from_file(path)
        self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.length = np.array([len(self.whole.id_to_token(i) or "") for i in range(self.whole.get_vocab_size())])
        added = [t["content"] for t in json.loads(self.whole.to_str())["added_tokens"]]
        self.by_letters = not any(pc.match_substring_regex(pa.array([t, t.rstrip(_SIGNS)]), _LETTERS).to_pylist() != [False, False] for t in added)
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        """Remember pieces (each with the space before it, if any), tokenized many at a time, a line end between them."""
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            body = np.array(self.whole.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(body == self.newline)
            self._keep(part, np.delete(body, cuts), np.r_[cuts - np.arange(len(cuts)), len(body) - len(cuts)])

    def learn_letters(self, pieces: list[str]) -> None:
        """Remember pieces of letters; the lengths of their tokens tell where each piece's end."""
        for at in range(0, len(pieces), 1024):
            part = pieces[at : at + 1024]
            signs = "\n".join(part).encode().decode("latin-1").translate(self.sign_of)
            body = np.array(self.letters.encode_batch_fast([signs], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(x) for x in signs.split("\n")])
            tokens = np.cumsum(self.length.take(body))
            cuts = np.searchsorted(tokens, ends) + 1
            if not np.array_equal(tokens.take(cuts - 1, mode="clip"), ends):
                raise ValueError("tokens don't give back their pieces")
            self._keep(part, body, cuts)

    def _keep(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        body, start = ids.tobytes(), 0
        for w, end in zip(pieces, (ends * 4).tolist(), strict=True):
            self.known[w] = body[start:end]
            start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        flat, ends = self.encode_array(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(flat, ends[:-1])] if texts else []

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and where each text's ids end."""
        if self.newline is None:
            odd = np.ones(len(texts), bool)
        else:
            odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.greater(pc.binary_length(texts), _HUGE)).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._by_pieces(texts)
        plain = self._by_pieces(texts.filter(pa.array(~odd))) if not odd.all() else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        rest, each = iter(np.split(plain[0], plain[1][:-1])), iter(self.ids(texts.filter(pa.array(odd)).to_pylist()))
        bodies = [np.frombuffer(next(each), "<u4") if x else next(rest) for x in odd.tolist()]
        return np.concatenate(bodies), np.cumsum([len(x) for x in bodies])

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts are cut before spaces and around line ends; of each distinct word, the letters and the signs behind them are looked up apart."""
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 "), "\0")
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary
        stems = pc.ascii_rtrim(distinct, characters=_SIGNS)
        lettered = pc.match_substring_regex(stems, _LETTERS) if self.by_letters else pa.array(np.zeros(len(stems), bool))
        begin = pc.if_else(lettered, stems, distinct)
        ended = np.flatnonzero(pc.binary_length(distinct).to_numpy() > pc.binary_length(begin).to_numpy())
        ends = [w[len(x) :] for w, x in zip(*(_strings(y.take(pa.array(ended))) for y in (distinct, begin)), strict=True)]
        signs = list({"": None} | dict.fromkeys(ends))
        begin = begin.dictionary_encode()
        pieces = _strings(begin.dictionary)
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        self.known["\n"], self.known[""] = self.newline.to_bytes(4, "little"), b""
        others = set(signs).union(_strings(distinct.filter(pc.invert(lettered))))
        self.learn([w for w in others if w not in self.known])
        self.learn_letters([w for w in pieces if w not in self.known and w not in others])
        found = [*map(self.known.__getitem__, pieces), *map(self.known.__getitem__, signs)]
        held = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        # What each distinct word begins and ends with, then the words of the texts.
        both = np.full((len(distinct), 2), len(pieces))
        both[:, 0] = begin.indices.to_numpy()
        place = {x: k for k, x in enumerate(signs, len(pieces))}
        both[ended, 1] = [place[x] for x in ends]
        held, size = _copied(held, size, both.ravel()), size.take(both).sum(axis=1)
        number = words.indices.to_numpy().astype(np.int64)
        last = np.cumsum(pc.list_value_length(cut).to_numpy())
        return _copied(held, size, number), np.r_[0, np.cumsum(size.take(number))].take(last)


@functools.cache
def _tokenizer(path: str) -> _Tokenizer:
    return _Tokenizer(path)


_END = np.array([END_ID], "<u4")


def _token_ids(tokenizer: _Tokenizer, texts: pa.Array) -> Iterator[np.ndarray]:
    """Ids of each text with the end id, texts of GROUP_BYTES at a time."""
    texts = pc.fill_null(texts, "")
    sizes, at = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES, "right")))
        flat, ends = tokenizer.encode_array(texts.slice(at, end - at))
        # Each text's ids and the end id behind them.
        closed = np.insert(flat, ends, _END)
        ends = ends + np.arange(1, len(ends) + 1)
        yield from np.split(closed, ends[:-1])
        at = end


def _write(path: str, kind: pa.DataType):
    """Blocks of a part's ids, in order; a row's documents are those that begin in its block."""
    out = pa.schema({"part": pa.int32(), "block": pa.int32(), "doc_ids": pa.list_(kind), "lengths": pa.list_(pa.int32()), "body": pa.binary()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        blocks: list[np.ndarray] = []
        docs: list[tuple[list, list]] = []
        open_ids: list[np.ndarray] = []
        names: tuple[list, list] = ([], [])
        held = 0

        def rows() -> pa.RecordBatch:
            nonlocal number, blocks, docs
            bodies = encode_blocks(blocks)
            made = pa.RecordBatch.from_arrays(
                [pa.array([part] * len(bodies), pa.int32()), pa.array(range(number, number + len(bodies)), pa.int32()), pa.array([d[0] for d in docs], pa.list_(kind)), pa.array([d[1] for d in docs], pa.list_(pa.int32())), pa.array(bodies, pa.binary())],
                schema=out,
            )
            number += len(bodies)
            blocks, docs = [], []
            return made

        tokenizer = _tokenizer(path)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), _token_ids(tokenizer, batch.column(1)), strict=True):
                names[0].append(doc)
                names[1].append(len(ids))
                at = 0
                while at < len(ids):
                    piece = ids[at : at + BLOCK - held]
                    open_ids.append(piece)
                    held += len(piece)
                    at += len(piece)
                    if held == BLOCK:
                        blocks.append(np.concatenate(open_ids))
                        docs.append(names)
                        open_ids, names, held = [], ([], []), 0
                        if len(blocks) * _many_lanes(BLOCK) >= LANES:
                            yield rows()
        if held:
            blocks.append(np.concatenate(open_ids))
            docs.append(names)
        if blocks:
            yield rows()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, part_bytes: int = PART_BYTES) -> None:
    """Write the ids of docs (doc_id, text) under path, in ascending doc_id order, as a table of blocks.

    Each part holds a range of doc_ids, of about part_bytes of text, so parts grow in number and not in size. A row has
    the part's and the block's number, ids and lengths of the documents
    that begin in the block, and the coded block. The table is Spark's, so that lost
    tasks are done again and no half file stays.
    """
    kind = docs.schema["doc_id"].dataType
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = F.col("doc_id").asc_nulls_first()
    ranged = docs.select("doc_id", "text").repartitionByRange(max(1, -(-size // part_bytes)), order, F.xxhash64("text")).sortWithinPartitions(order, "text")
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = ranged.mapInArrow(_write(tokenizer, to_arrow_type(kind)), f"part int, block int, doc_ids array<{kind.simpleString()}>, lengths array<int>, body binary")
    blocks.write.option("compression", "none").parquet(path)


def _read(kind: pa.DataType):
    """Documents of a part from its blocks in order; a document may go over many blocks."""
    out = pa.schema({"doc_id": kind, "part": pa.int32(), "within": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, start = -1, 0, 0
        doc, left, crc, length = None, 0, 0, 0
        for batch in batches:
            found = batch.to_pydict()
            decoded = decode_blocks(found["body"])
            rows: list[tuple] = []
            for p, ids, names, lengths in zip(found["part"], decoded, found["doc_ids"], found["lengths"], strict=True):
                if p != part:
                    if left:
                        raise ValueError("a document's last block is missing")
                    part, start = p, 0
                body, at = ids.astype("<u4"), 0
                if left:
                    n = min(left, len(body))
                    crc, left, at = zlib.crc32(body[:n].tobytes(), crc), left - n, n
                    if not left:
                        rows.append((doc, part, start, length, crc))
                        start += length
                for doc, length in zip(names, lengths, strict=True):
                    n = min(length, len(body) - at)
                    crc, left, at = zlib.crc32(body[at : at + n].tobytes()), length - n, at + n
                    if not left:
                        rows.append((doc, part, start, length, crc))
                        start += length
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)
        if left:
            raise ValueError("a document's last block is missing")

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of what write_tokens wrote, from the decoded blocks."""
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType
    # One row for each part: all that the window without partitions runs over.
    sums = blocks.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    begins = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    parts = max(1, blocks.agg(F.max("part")).first()[0] or 0) + 1
    dealt = blocks.repartition(parts, "part").sortWithinPartitions("part", "block")
    found = dealt.mapInArrow(_read(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, part int, within long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(begins), "part").select("doc_id", (F.col("begin") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32), one for each row of docs, read back from the written blocks.

    Every text's ids end with id 0. Null texts are empty: one id. Null ids come
    first; rows of equal id follow each other by their text. Other columns are
    ignored, and an empty table writes no block.
    """
    path = path or f"{scratch_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex[:12]}"
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
