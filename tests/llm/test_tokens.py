from __future__ import annotations

import heapq
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lociweave.llm import tokens
from tests.llm.conftest import edge_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


ODD = [
    "a<|endoftext|>b it's we'll don't! x\x01y \x01 ...a,b, É́. é, \x1cfoo\x1d <|ENDOFTEXT|> 12.5%, ΑΣ. ΟΔΟΣ, ﬁne. İstanbul, 's. 't,",
    "x's, y're; (foo), [bar]. `baz` naïve, CAFÉ!! 'quoted'. can't've, rock'n'roll. <|startoftext|>, á,  . é.",
    "", " \t", "\x01", "\x01 end", "…", "a" * 5000,
]


def test_words_give_the_tokenizers_ids(tokenizer):
    own = tokens.WordEncoder(PATH, 2)
    for text in [*ODD, *ODD]:  # the second time, words are known
        assert own.encode(pa.array([text.encode()]))[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcDEé'.,!<|>1 \n\x01́ßσΣ中"), max_size=30), max_size=4))
def test_any_text(texts):
    own, tk = tokens._encoder(PATH, 2), Tokenizer.from_file(PATH)
    ids, counts = own.encode(pa.array([t.encode() for t in texts], pa.binary()))
    want = [[*tk.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))


def test_words_of_the_generation_before_are_kept(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 3)
    own = tokens.WordEncoder(PATH, 2)
    for text in [*ODD, "one two one.", "two, three", "one. two three four", *ODD]:
        assert own.encode(pa.array([text.encode()]))[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=200), st.integers(9, 20))
def test_code_lengths_are_a_prefix_code_and_optimal(counts, longest):
    counts = np.array(counts)
    lengths = tokens.code_lengths(counts, longest)
    used = counts > 0
    assert ((lengths > 0) == used).all() and lengths.max(initial=0) <= longest
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1.0
    heap, free = [int(c) for c in counts[used]], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        free += a + b
        heapq.heappush(heap, a + b)
    cost = int((lengths * counts).sum())
    assert cost >= free
    if longest == 20 and used.sum() > 1:
        assert cost <= free * 1.01 + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=900), st.sampled_from([1, 7, 64]))
def test_bits_round_trip(ids, stride):
    ids = np.array(ids, np.int64)
    lengths = tokens.code_lengths(np.bincount(ids, minlength=61) + np.arange(61) % 3, 20)
    bits, offsets = tokens.pack_bits(ids, tokens.canonical(lengths), lengths, stride)
    back = tokens.unpack_bits(bits, len(ids), offsets, tokens.decode_table(lengths), stride) if len(ids) else ids
    assert back.tolist() == ids.tolist()


def test_corpus_round_trip(edge, tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "PART_BYTES", 2000)
    path = tokens.write_corpus(edge, PATH, 2, block=200, stride=16)
    got = tokens.read_corpus(edge.sparkSession, path, stride=16).collect()
    rows = sorted(((i, t) for i, t, _, _ in edge_texts()), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    want, at = [], 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted((r["start"], r["key"], r["n_tokens"], bytes(r["ids"])) for r in got) == sorted((s, i, n, b) for i, s, n, b in want)
    digests = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in tokens.digests(edge, PATH, 2).collect()}
    assert digests == {(i, s): zlib.crc32(b) for i, s, _, b in want}


def test_empty(empty):
    assert tokens.digests(empty, PATH, 2).count() == 0
