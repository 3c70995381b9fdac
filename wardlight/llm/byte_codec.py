"""Byte-level BPE encoding and decoding, without the tokenizer's library on the rows' path.

Method: a lexicon. The words (pre-tokens) of all texts are counted on Spark; the most frequent ones are merged once, and
compiled with their ids into a minimal acyclic transducer (`transducer`). Its bytes go to a file in the shared folder;
each executor fetches it once and its workers memory-map it, so they share one copy. Words that a task meets for the
first time are walked through the transducer together; words it doesn't know are merged exactly, the pair of least rank
first, of equal ones the leftmost, in time n log n for n bytes. So the lexicon saves time only: any lexicon, also an
empty one, gives the library's ids. Decoding gathers the ids' bytes.

What belongs to one word is told by character classes that are read off the tokenizer itself, as its Unicode version is
not that of Python. Added tokens are cut out of a text first, as the library does.

Rows: null text counts as empty; the empty text has no ids and decodes to ''. Repeated rows repeat; an empty table gives
an empty table. Very long words take time n log n. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, send_fewer_texts, slices, tidied, write_file
from .transducer import Transducer, compile_words

#: Words in the lexicon at most, and the bytes of the longest one.
LEXICON, LONGEST = 100_000, 48
#: Words that a task keeps in each of two generations; when the young one is full, it becomes the old one. Longer words are not kept.
MEMO, MEMO_CHARS = 200_000, 48
#: Distinct words that a counting task holds before it hands on their counts.
COUNTED = 200_000
#: From so many bytes on, words are merged by a heap instead of by looking through their pairs.
HEAPED = 40
#: Ids that are decoded at once.
IDS_TOGETHER = 1 << 20


def byte_letters() -> list[str]:
    """The character by which vocabulary files write each byte: itself if it is a visible one of Latin-1, else the next from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or b >= 0xA1 and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _classes(pre_tokenizer) -> list[list[tuple[int, int]]]:
    """Ranges of letters, of numbers and of blanks, as the pre-tokenizer parts them from an exclamation mark, a letter and a digit."""

    def parted(mark: str, chars: list[str]) -> set[str]:
        out = set()
        for at in range(0, len(chars), 5000):
            own = chars[at : at + 5000]
            starts = {a for _, (a, _) in pre_tokenizer.pre_tokenize_str("".join(mark + c for c in own))}
            out |= {c for k, c in enumerate(own) if 2 * k + 1 in starts}
        return out

    def ranges(chars: list[str]) -> list[tuple[int, int]]:
        codes = np.array([ord(c) for c in chars])
        ends = np.flatnonzero(np.diff(codes) > 1)
        return list(zip(codes[np.concatenate([[0], ends + 1])].tolist(), codes[np.concatenate([ends, [len(codes) - 1]])].tolist(), strict=True))

    named = sorted(parted("!", [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    no_letter, no_number = parted("a", named), parted("1", named)
    return [ranges([c for c in named if c not in no_letter]), ranges([c for c in named if c not in no_number]), ranges([c for c in named if c in no_letter and c in no_number])]


@functools.cache
def read_vocabulary(tokenizer_file: str) -> dict:
    """Bytes of each id, merges, added tokens and character classes of a byte-level BPE tokenizer; small, so that it can travel with tasks."""
    from tokenizers import Tokenizer

    with open(tokenizer_file, encoding="utf-8") as f:
        said = json.load(f)
    model, pre, decoder = said["model"], said["pre_tokenizer"], said["decoder"]
    if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or said["normalizer"]:
        raise ValueError("not a plain byte-level BPE model")
    if pre["type"] != "ByteLevel" or decoder["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError("not a byte-level pre-tokenizer and decoder without a prefix")
    added = {x["content"]: x["id"] for x in said["added_tokens"]}
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in said["added_tokens"]):
        raise ValueError("added tokens that look at their neighbours")
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    raw = lambda token: bytes(byte_of[c] for c in token)
    bytes_of = {i: raw(token) for token, i in model["vocab"].items()} | {i: token.encode() for token, i in added.items()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in pairs]
    return {"bytes": bytes_of, "byte_ids": [model["vocab"][letter] for letter in byte_letters()], "merges": merges, "added": added, "classes": _classes(Tokenizer.from_file(tokenizer_file).pre_tokenizer)}


class Words:
    """Parts texts into words: endings after an apostrophe, letters, numbers and other signs, each with one blank before it at most, and blanks."""

    def __init__(self, classes: list[list[tuple[int, int]]]):
        def pattern(top: int) -> re.Pattern:
            letter, number, blank = ("".join(f"\\U{a:08x}-\\U{min(b, top):08x}" for a, b in x if a <= top) for x in classes)
            # Fixed value: the tokenizer's pattern of words.
            return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+")

        # The fewer characters a pattern knows, the faster it is.
        self.ascii, self.basic, self.all = (pattern(top).findall for top in (0x7F, 0xFFFF, 0x10FFFF))

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        return (self.basic if len(text.encode("utf-16-le")) == 2 * len(text) else self.all)(text)


class Codec:
    def __init__(self, vocabulary: dict, lexicon: Transducer | None = None):
        self.words = Words(vocabulary["classes"])
        self.byte_ids, self.added, self.lexicon = vocabulary["byte_ids"], vocabulary["added"], lexicon
        self.merges = {(a, b): (rank, made) for rank, (a, b, made) in enumerate(vocabulary["merges"])}
        self.cuts = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        n = max(vocabulary["bytes"]) + 1
        held = [vocabulary["bytes"].get(i, b"") for i in range(n)]
        self.pool = np.frombuffer(b"".join(held), np.uint8)
        self.sizes = np.array([len(x) for x in held], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of least rank merges first, of equal ones the leftmost."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) >= HEAPED:
            return self._merged_by_heap(ids)
        none, get = (len(self.merges), -1), self.merges.get
        found = [get(pair, none) for pair in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k < len(found):
                found[k] = get((ids[k], ids[k + 1]), none)
            if k:
                found[k - 1] = get((ids[k - 1], ids[k]), none)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, k) for k in range(n - 1) if (m := get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, made, k = heapq.heappop(heap)
            on = after[k]
            if ids[k] < 0 or on >= n or get((ids[k], ids[on])) != (rank, made):
                continue  # one of the two has merged since
            ids[k], ids[on], after[k] = made, -1, after[on]
            if after[k] < n:
                before[after[k]] = k
                if m := get((made, ids[after[k]])):
                    heapq.heappush(heap, (*m, k))
            if (left := before[k]) >= 0 and (m := get((ids[left], made))):
                heapq.heappush(heap, (*m, left))
        return [i for i in ids if i >= 0]

    def _entries(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian ids of words, from the lexicon or by merging."""
        raw, out, known = [w.encode() for w in words], {}, set()
        if self.lexicon is not None:
            found, ids, bounds = self.lexicon.look_up(raw)
            held, at = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
            known = set(found.tolist())
            out = {words[i]: held[at[k] : at[k + 1]] for k, i in enumerate(found.tolist())}
        for i, word in enumerate(words):
            if i not in known:
                out[word] = np.array(self.merged(raw[i]), "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian 32-bit numbers."""
        parted: list[list[str]] = []
        for text in texts:
            if self.cuts is None or self.cuts.search(text) is None:
                parted.append(self.words(text))
            else:
                parts = self.cuts.split(text)
                parted.append([w for k, part in enumerate(parts) for w in ([None, part] if k % 2 else self.words(part))])
        special = any(None in words for words in parted)
        wanted = set().union(*parted) - ({None, *self.added} if special else set())
        missing = wanted - self.memo.keys()
        if len(self.memo) + len(missing) > MEMO:
            self.old, self.memo = self.memo, {}
            missing = wanted
        memo, old = self.memo, self.old
        again = missing & old.keys()
        memo.update((w, old[w]) for w in again)
        fresh = self._entries([*(missing - again)])
        long = {w: x for w, x in fresh.items() if len(w) > MEMO_CHARS}
        memo.update(fresh if not long else ((w, x) for w, x in fresh.items() if w not in long))
        held = memo if not long else memo | long
        if not special:
            return [b"".join([held[w] for w in words]) for words in parted]
        return [b"".join(self._with_added(words, held)) for words in parted]

    def _with_added(self, words: list[str | None], held: dict[str, bytes]) -> Iterator[bytes]:
        """A None announces that the next word is an added token."""
        rest = iter(words)
        for word in rest:
            yield held[word] if word is not None else np.array([self.added[next(rest)]], "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """What little-endian ids decode to; bytes that are no UTF-8 become replacement characters."""
        every, out = np.frombuffer(ids, "<u4").astype(np.int64), []
        for at in range(0, len(every), IDS_TOGETHER):
            own = every[at : at + IDS_TOGETHER]
            n = self.sizes[own]
            out.append(self.pool[np.repeat(self.starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def count_words(docs: DataFrame, vocabulary: dict, text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(word, n) of all texts' words of at most `longest` bytes; tasks add up their own first."""
    send_fewer_texts(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary["classes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Words(shared.value), Counter()

        def handed_on() -> pa.RecordBatch:
            own = [(w, n) for w, n in held.items() if len(w) <= longest and len(w.encode()) <= longest]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(words(text.as_py()))
                if len(held) > COUNTED:
                    yield handed_on()
        yield handed_on()

    told = docs.select(text_col).where(F.col(text_col) != "").mapInArrow(tidied(run), "word string, n long")
    return told.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The words of (word, n) that come twice or more, from the count on at which `most` words or fewer are left.

    The cutoff comes from a row per distinct count, so no task sorts or hands on all words.
    """
    counts = cut(counts.where("n > 1"))
    by_count = counts.groupBy("n").agg(F.count("*").alias("words"))
    so_far = F.sum("words").over(W.orderBy(F.desc("n")))
    least = by_count.withColumn("so_far", so_far).where(F.col("so_far") <= most).agg(F.min("n")).first()[0]
    return counts.where(F.col("n") >= least) if least is not None else counts.limit(0)


def build_lexicon(docs: DataFrame, vocabulary: dict, text_col: str = "text", most: int = LEXICON) -> bytes:
    """The transducer of the most frequent words, `most` at most; so many rows reach the driver."""
    rows = frequent_words(count_words(docs, vocabulary, text_col), most).select("word").collect()
    codec = Codec(vocabulary)
    return compile_words((w, tuple(codec.merged(w))) for w in sorted(x["word"].encode() for x in rows))


def share_lexicon(docs: DataFrame, image: bytes) -> str:
    """Puts the lexicon in the shared folder and lets every executor fetch it; returns its name there."""
    spark = docs.sparkSession
    name = f"lexicon-{hashlib.sha256(image).hexdigest()[:24]}.bin"
    path = f"{checkpoint_dir(spark)}/{name}"
    write_file(spark, path, image)
    spark.sparkContext.addFile(path)
    return name


_CODECS: dict[str, Codec] = {}


def _codec(name: str, vocabulary) -> Codec:
    if name not in _CODECS:  # a Python worker serves many tasks
        _CODECS.clear()
        with open(SparkFiles.get(name), "rb") as f:
            _CODECS[name] = Codec(vocabulary.value, Transducer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
    return _CODECS[name]


def encode_bytes(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", lexicon: int = LEXICON, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also the ids and the decoded text.

    A pass counts words, then a narrow one encodes; its memory is bounded by the memo, the lexicon and the longest text.
    """
    send_fewer_texts(docs.sparkSession)
    known = read_vocabulary(tokenizer_file)
    name = share_lexicon(docs, build_lexicon(docs, known, text_col, lexicon))
    vocabulary = docs.sparkSession.sparkContext.broadcast(known)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, vocabulary)
        for batch in batches:
            for part in slices(batch, 100):
                coded = codec.encode([x or "" for x in part.column(1).to_pylist()])
                decoded = [codec.decode(x) for x in coded]
                digests = [[hashlib.sha256(x).hexdigest() for x in coded], [hashlib.sha256(x.encode()).hexdigest() for x in decoded]]
                columns = [part.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()), *(pa.array(x, pa.string()) for x in digests)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in coded], pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(tidied(run), schema)
