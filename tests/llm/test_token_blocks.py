"""Token blocks of many lanes, and pieces of texts that are tokenized once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tessera.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_blocks_of_many_lanes_are_readable_alone_and_near_their_entropy():
    rng = np.random.default_rng(3)
    blocks = [np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint32) for n in (tokens.BLOCK, 40_001, tokens.LANE, tokens.LANE + 1, 7, 0)]
    blocks += [rng.integers(0, 1 << 32, tokens.BLOCK).astype(np.uint32), np.zeros(tokens.BLOCK, np.uint32), np.arange(tokens.BLOCK, dtype=np.uint32)]
    coded = tokens.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, tokens.decode_blocks(coded), strict=True))
    assert all(np.array_equal(b, tokens.decode_blocks([c])[0]) for c, b in zip(coded, blocks, strict=True))
    share = np.bincount(blocks[0])[np.unique(blocks[0])] / len(blocks[0])
    assert len(coded[0]) < 1.2 * len(blocks[0]) * -(share * np.log2(share)).sum() / 8
    with pytest.raises(ValueError):
        tokens.encode_blocks([np.zeros(tokens.BLOCK + 1, np.uint32)])


def test_every_damaged_byte_of_a_block_is_seen():
    body = tokens.encode_blocks([np.arange(600, dtype=np.uint32) % 7])[0]
    for k in range(0, len(body), 5):
        damaged = bytearray(body)
        damaged[k] ^= 0x40
        with pytest.raises(ValueError):
            tokens.decode_blocks([bytes(damaged)])


def test_words_are_tokenized_once_whatever_signs_follow_them():
    tokenizer = tokens._Tokenizer(PATH)
    texts = ["the letter, the letter. the letter!?", "a letter;", "the letter"]
    flat, ends = tokenizer.encode_array(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, ends[:-1])] == [tokenizer.whole.encode(t).ids for t in texts]
    assert sorted(p for p in tokenizer.known if "letter" in p) == [" letter"]


def test_letters_and_signs_apart_give_the_tokenizer_s_ids():
    tokenizer = tokens._Tokenizer(PATH)
    rng = np.random.default_rng(9)
    signs = [*"aZéÿĀɏɐª×ǅ́ßñ中1²½.,;:!?%$#&*|@/-<>'\"()_=\n", " ", " ", " ", "the", "'s", "'ll", "<|endoftext|>", "endoftext", "İ", "﻿", "😀"]
    texts = ["".join(signs[k] for k in rng.integers(0, len(signs), n)) for n in rng.integers(0, 30, 4000)]
    assert tokenizer.encode(texts) == tokenizer.ids(texts)
    assert tokenizer.encode([]) == []
