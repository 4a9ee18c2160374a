from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from samples import edge_docs, edge_rows, empty_docs, with_clashing_columns

from envtally.llm import byte_bpe, pretokens, token_counts

RANKS_PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = pretokens.read_ranks(RANKS_PATH)
PIECES = ["a", "B", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "1", "²", "!!", "\x1c", "\x85", "\xa0", "日本", "😀", "\u0301", "œ", "the"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.model(RANKS), np.array(sorted(RANKS.values())), P.PATTERN)


def random_texts(n):
    rng = random.Random(2)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_ids_are_those_of_the_library(library, codec):
    for text in random_texts(4000):
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_each_character_is_in_the_class_the_library_has_it_in(library, codec):
    for c in [*range(0x3000), *range(0x3000, 0x110000, 101)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b {chr(c)}1 \n{chr(c)} "
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text), hex(c)


def test_long_runs(library, codec):
    text = "x" * 60_000 + " " * 20_000 + "ab" * 20_000
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_merges_reach_every_entry_of_the_vocabulary(codec):
    ids = codec.processor.encode([byte_bpe.mapped(piece) for piece in RANKS], out_type=int)
    assert ids == [[rank] for rank in RANKS.values()]


def test_the_cache_may_start_anew(monkeypatch, library, codec):
    monkeypatch.setattr(byte_bpe, "CACHE", 10)
    for text in random_texts(200):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("batch_bytes", [10, 1 << 24])
def test_encoded_table(spark, library, monkeypatch, batch_bytes):
    monkeypatch.setattr(byte_bpe, "_BATCH_BYTES", batch_bytes)
    docs = with_clashing_columns(edge_docs(spark))
    encoded = byte_bpe.encode(docs, ["doc_id", "lang"], RANKS_PATH, P.PATTERN)
    got = byte_bpe.digests(encoded, ["doc_id", "lang"]).collect()
    expected = []
    for r in edge_rows():
        ids = library.encode_ordinary(r[1] or "")
        packed = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((r[0], r[2], len(ids), packed, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert byte_bpe.encode(empty_docs(spark), ["doc_id"], RANKS_PATH, P.PATTERN).collect() == []


def brute_count(token, scores):
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        ways = [(best[s][0] + scores[token[s:end]], best[s][1] + 1) for s in range(end) if token[s:end] in scores]
        top = max(score for score, _ in ways)
        best.append((top, min(n for score, n in ways if score == top)))
    return best[-1][1]


def test_counts_of_a_trie_equal_those_of_single_tokens():
    scores = token_counts.zipf_scores(RANKS)
    pieces = token_counts.automaton(scores)
    tokens = sorted({t.encode() for text in random_texts(600) for t in regex.findall(P.PATTERN, text)} | {b"a" * 300, b"ab" * 99})
    assert token_counts.count_tokens(tokens, pieces).tolist() == [brute_count(t, scores) for t in tokens]


def test_equal_scores_take_the_fewest_tokens_and_unknown_bytes_count():
    scores = {b"a": -1.0, b"b": -1.0, b"ab": -2.0, b"aba": -3.0}
    pieces = token_counts.automaton(scores)
    assert token_counts.count_tokens([b"aab", b"ab", b"aba", b"a\xff"], pieces).tolist() == [2, 1, 1, 2]


@pytest.mark.parametrize("limit", [50, 1 << 17])
def test_counted_table(spark, monkeypatch, limit):
    monkeypatch.setattr(token_counts, "TRIE_TOKENS", limit)
    monkeypatch.setattr(token_counts, "CACHE", limit)
    docs = with_clashing_columns(edge_docs(spark))
    got = token_counts.token_counts(docs, ["doc_id"], RANKS_PATH, P.PATTERN).collect()
    scores, memo, expected = token_counts.zipf_scores(RANKS), {}, []
    for r in edge_rows():
        tokens = regex.findall(P.PATTERN, r[1] or "")
        for t in set(tokens) - memo.keys():
            memo[t] = brute_count(t.encode(), scores)
        expected.append((r[0], len(tokens), sum(memo[t] for t in tokens)))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert token_counts.token_counts(empty_docs(spark), ["doc_id"], RANKS_PATH, P.PATTERN).collect() == []


def test_long_texts_come_in_bounded_lists(monkeypatch):
    split = pretokens.splitter(P.PATTERN)
    text = "ab 12 !? " * 1000
    whole = [t for part in split(text) for t in part]
    monkeypatch.setattr(pretokens, "_LONG", 10)
    monkeypatch.setattr(pretokens, "_AT_ONCE", 7)
    parts = list(pretokens.splitter(P.PATTERN)(text))
    assert max(map(len, parts)) == 7 and [t for part in parts for t in part] == whole == regex.findall(P.PATTERN, text)
    assert re.sub(r"\s", "", "".join(whole)) == re.sub(r"\s", "", text)
