"""Byte-level BPE against the tokenizer's library, and its lexicon against plain tables."""

import hashlib
import random

import numpy as np
import pytest
from test_operators import corpus, docs, empty  # noqa: F401
from tokenizers import Tokenizer

from wardlight.llm import byte_codec, queries
from wardlight.llm.transducer import Transducer, compile_words

FILE = queries.byte_tokenizer_file()
LETTERS = "abcdeé漢🙂'\n\t  12²̀<|>​ \rßÉ՘꟎"


@pytest.fixture(scope="module")
def vocabulary():
    return byte_codec.read_vocabulary(FILE)


def awkward():
    rng = random.Random(4)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return [*texts, "a" * 50_000, "ab" * 20_000, " " * 3000 + "x", "<|endoftext|>", "x<|endoftext|><|endoftext|> y<|endoftext", "don't we'll it's", "the " * 500, ""]


def by_states(words):
    """How many states the smallest automaton has: prefixes told apart by what may follow, with the outputs still to come."""
    futures = {}
    for word in words:
        for k in range(len(word) + 1):
            futures.setdefault(word[:k], set()).add(word[k:])
    return len({frozenset(x) for x in futures.values()})


def test_codec_equals_the_library(vocabulary):
    theirs = Tokenizer.from_file(FILE)
    codec = byte_codec.Codec(vocabulary)
    texts = awkward()
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        for text, ids in zip(part, codec.encode(part), strict=True):
            ids_there = theirs.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == ids_there
            assert codec.decode(ids) == theirs.decode(ids_there, skip_special_tokens=False)
    halves = [i for i in range(256) if i > 187] * 3  # ids of single bytes, no UTF-8 together
    assert codec.decode(np.array(halves, "<u4").tobytes()) == theirs.decode(halves, skip_special_tokens=False)


def test_words_of_every_character(vocabulary):
    pre, words = Tokenizer.from_file(FILE).pre_tokenizer, byte_codec.Words(vocabulary["classes"])
    for a in range(0, 0x110000, 64):
        text = "".join(f"a{c}1{c}!{c} x\n" for c in map(chr, range(a, a + 64)) if not 0xD800 <= ord(c) < 0xE000)
        assert words(text) == [text[x:y] for _, (x, y) in pre.pre_tokenize_str(text)]


def test_heap_and_search_agree(vocabulary, monkeypatch):
    codec, rng = byte_codec.Codec(vocabulary), random.Random(6)
    words = [bytes(rng.choice(b"theinrs ao") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    monkeypatch.setattr(byte_codec, "HEAPED", 1000)
    searched = [codec.merged(w) for w in words]
    monkeypatch.setattr(byte_codec, "HEAPED", 1)
    assert [codec.merged(w) for w in words] == searched


def test_transducer():
    rng = random.Random(2)
    table = {bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randint(0, 7))): tuple(rng.randint(0, 3) for _ in range(rng.randint(0, 4))) for _ in range(3000)}
    machine = Transducer(compile_words(sorted(table.items())))
    asked = [*table, b"abcabcabc", b"zz", b"\xff" * 6, b"a" * 200, *table]
    found, ids, bounds = machine.look_up(asked)
    assert found.tolist() == [i for i, w in enumerate(asked) if w in table]
    assert [tuple(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])] == [table[w] for w in asked if w in table]
    for nothing in ([], [b"x"]):
        found, ids, bounds = Transducer(compile_words([])).look_up(nothing)
        assert len(found) == len(ids) == 0 and bounds.tolist() == [0]
    with pytest.raises(ValueError, match="rising"):
        compile_words([(b"b", (1,)), (b"a", (2,))])


def test_transducer_is_minimal():
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    words = sorted({(s + e).encode() for s in stems for e in ("", "ing", "ings", "ed", "er", "ers")})
    machine = Transducer(compile_words((w, ()) for w in words))
    assert len(machine.finals) == by_states(words)
    # A stem's id stands before the endings, which stay shared with their ids.
    stems = sorted({s for s in stems if len(s) == 5})
    words = {(s + e).encode(): (100 + k, n) for k, s in enumerate(stems) for n, e in enumerate(("ing", "ings", "ed", "er", "ers"))}
    own = Transducer(compile_words(sorted(words.items())))
    assert len(own.finals) < len({w[:k] for w in words for k in range(len(w) + 1)}) / 2


@pytest.mark.parametrize("lexicon", [0, 3, 100_000])
def test_encode_bytes(spark, docs, empty, monkeypatch, lexicon):  # noqa: F811
    for name in ("MEMO", "COUNTED"):
        monkeypatch.setattr(byte_codec, name, 50)
    theirs = Tokenizer.from_file(FILE)
    got = byte_codec.encode_bytes(docs, FILE, lexicon=lexicon, keep_ids=True).collect()
    wanted = []
    for row in corpus():
        ids = theirs.encode(row[1] or "", add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False)
        wanted.append((row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
    assert byte_codec.encode_bytes(empty, FILE, lexicon=lexicon).count() == 0


def test_counts_are_whole(spark, docs, vocabulary, monkeypatch):  # noqa: F811
    monkeypatch.setattr(byte_codec, "COUNTED", 20)
    words, wanted = byte_codec.Words(vocabulary["classes"]), {}
    for row in corpus():
        for w in words(row[1] or ""):
            if len(w.encode()) <= byte_codec.LONGEST:
                wanted[w] = wanted.get(w, 0) + 1
    assert {r["word"]: r["n"] for r in byte_codec.count_words(docs, vocabulary).collect()} == wanted


def test_frequent_words(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 2), ("e", 1)], "word string, n long")
    got = lambda most: {r["word"] for r in byte_codec.frequent_words(counts, most).collect()}
    assert [got(k) for k in (0, 1, 2, 3, 4, 9)] == [set(), {"a"}, {"a"}, {"a", "b", "c"}, {"a", "b", "c", "d"}, {"a", "b", "c", "d"}]
