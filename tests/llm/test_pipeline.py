import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardlight.llm import suffix_index


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: rng.choice("the of house walks slowly green river over hills with bread water stone cloud".split()) + rng.choice(["", "s", "ed", "ing"])
    text = [" ".join(word() for _ in range(150)) for _ in range(30)]
    passage = " ".join(word() for _ in range(90))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(text)]
    rows += [(100, text[0], "en", "s0", 1), (101, text[1] + " extra", "en", "s1", 1), (102, None, "en", "s0", 0), (103, "123 !!", None, None, 6), (None, text[2], "en", "s1", 5), (7, text[7], "en", "s1", 1)]
    rows += [(200 + i, " ".join(word() for _ in range(120)) + " " + passage, "en", "s2", 1) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.select("doc_id", *(["text"] if "text" in docs.columns else [])).collect()
    ids = {k: sorted((r.doc_id for r in v), key=str) for k, v in kept.items()}
    assert 102 not in ids["language_id"] and 103 not in ids["language_id"] and len(ids["language_id"]) == len(rows) - 2
    assert not {100, 101, None} & set(ids["near_dedup"]) and ids["near_dedup"].count(7) == 1 and set(range(30)) <= set(ids["near_dedup"])
    assert not any(passage in r.text for r in kept["suffix_dedup"]) and len(kept["suffix_dedup"]) == len(kept["near_dedup"])
    assert set(ids["source_mix"]) <= set(ids["suffix_dedup"]) and len(ids["sentencepiece"]) == len(ids["source_mix"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids["sentencepiece"])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnoprstuw") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.mark.parametrize("n_words", [51, 53, 56, 60, 90])
def test_passages_of_over_fifty_words_go(spark, n_words):
    rng = random.Random(n_words)
    passages = [prose(rng, n_words) for _ in range(6)]
    rows = [(10 * k + i, f"{prose(rng, 80)} {p} {prose(rng, 80)}", "en", "s", 1) for k, p in enumerate(passages) for i in range(3)]
    clean = [(900 + i, prose(rng, 200), "en", "s", 1) for i in range(20)]
    shorter = prose(rng, 46)  # found as a repeat, but no passage
    clean += [(950 + i, f"{prose(rng, 80)} {shorter} {prose(rng, 80)}", "en", "s", 1) for i in range(3)]
    left = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, spark.createDataFrame(rows + clean, COLUMNS), "").collect()}
    assert len(left) == len(rows) + len(clean) and all(left[i] == t for i, t, *_ in clean)
    assert not any(p[20:-20] in left[10 * k + i] for k, p in enumerate(passages) for i in range(3))


def test_whole_words():
    text = "one two  three\tfour".encode()
    for start, stop, n in ((0, len(text), 4), (1, len(text), 3), (0, 2, 0), (3, 8, 1), (4, 7, 1), (5, 7, 0), (4, 9, 1), (0, 0, 0), (3, 4, 0), (8, 9, 0)):
        assert suffix_index.whole_words(text, start, stop) == n
    cuts = range(len(text) + 1)
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    assert all(suffix_index.whole_words(text, a, b) == sum(a <= x and y <= b for x, y in words) for a in cuts for b in cuts if a <= b)


def test_rows_that_share_an_id(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 100) for _ in range(3))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "en", "s", 1), (2, a + " end", "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=repr)
    assert [x for x in left if x[1] == b] == [(1, b)] and [x for x in left if x[1] == c] == [(None, c)] and (None, None) in left
    assert len([x for x in left if x[1] in (a, a + " end")]) == 1 and len(left) == 4
    mixed = corpus_pipeline.source_mix(spark, docs.where("text IS NOT NULL"), "").collect()
    assert all(1 <= sum(r.text == t for r in mixed) <= 2 * n for t, n in ((a, 1), (b, 2), (c, 2)))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, name, stage):
    """Columns of clashing names, a text over the 256 KB step, and a table without rows."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 60), "en", f"s{i % 2}", 1) for i in range(12)] + [(50, prose(rng, 60_000), "en", "s0", 1), (51, None, "en", "s0", 0), (52, "", None, None, 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for extra in ("copy", "copies", "row_key", "id_is_shared", "kept", "score", "row", "size", "taken", "id", "u1", "component_id", "t"):
        docs = docs.withColumn(extra, F.lit("mine"))
    out = stage(spark, docs, "").collect()
    assert {0, 50} <= {r.doc_id for r in out}
    if name != "sentencepiece":
        assert all(r["copy"] == r["copies"] == r["row_key"] == r["taken"] == r["row"] == "mine" for r in out)
        assert next(r for r in out if r.doc_id == 50).text == rows[12][1]
    assert stage(spark, docs.limit(0), "").count() == 0


def test_rare_script_is_kept(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("the of house walks slowly green river over hills".split()) for _ in range(1000)), "en", "s", 1) for i in range(60)]
    rows.append((99, "Ο ήλιος λάμπει πάνω από τα βουνά", "el", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language_id(spark, docs, "").where("doc_id = 99").count() == 1
