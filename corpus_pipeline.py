"""Training-data pipeline: five stages, each over all that its predecessor kept, written as Parquet between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import language_profiles, minhash, mixing, suffix_index
from wardlight.llm.common import Tables, cut
from wardlight.llm.piece_codec import encode_documents
from wardlight.llm.queries import piece_model_file

#: A text this far from every language's profile is in none of them.
LEAST_SCORE = 0.2
#: Words of a passage that must not repeat, and the bytes by which repeats are found: a passage of so many words is shorter only if
#: its words have two letters on average; such ones stay.
PASSAGE_WORDS, FOUND_BYTES = 51, 160
#: Ids of dropped documents that are sent to all tasks at most.
MOST_SENT = 200_000


def _own_name(docs: DataFrame, wish: str) -> str:
    """A column name that docs doesn't have."""
    while wish.lower() in {c.lower() for c in docs.columns}:
        wish += "_"
    return wish


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near a language's profile; null texts, texts without letters and far ones go."""
    profiles = language_profiles.learn_profiles(docs)
    found = language_profiles.predict(docs, profiles, [], keep_row=True)
    kept = found.where((F.col("lang_pred") != language_profiles.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.drop("lang_pred", "score").toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles at a similarity of 0.8.

    Rows are judged one by one: rows that share an id, or have none, are told apart by their texts, so a text goes only if
    its own words are near another's. Of equal rows one stays.
    """
    repeated = cut(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    key, shared = _own_name(docs, "row_key"), _own_name(docs, "id_is_shared")
    if repeated.isEmpty():
        marked = docs.withColumn(shared, F.col("doc_id").isNull())
    else:
        ids = repeated.withColumn(shared, F.lit(True))
        marked = docs.join(F.broadcast(ids) if repeated.count() <= MOST_SENT else ids, "doc_id", "left").select(*docs.columns, (F.col("doc_id").isNull() | F.coalesce(shared, F.lit(False))).alias(shared))
    # Keys of shared ids are above 2^62, so that of a group the least unshared id stays.
    of_row = F.xxhash64("doc_id", "text", F.col("doc_id").isNull()).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    rows = marked.withColumn(key, F.when(F.col(shared), of_row).otherwise(F.col("doc_id").cast("long")))
    found = minhash.near_duplicates(rows, id_col=key, width=5, percent=80)
    gone = cut(found.where("NOT kept").select(key).distinct())
    left = rows.join(F.broadcast(gone) if gone.count() <= MOST_SENT else gone, key, "left_anti")
    once = left.where(~F.col(shared)).select(*docs.columns)
    return once.union(left.where(F.col(shared)).dropDuplicates([key]).select(*docs.columns))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated passages: stretches of PASSAGE_WORDS whole words or more that are covered by strings of
    FOUND_BYTES bytes that come twice or more. Texts without blanks have no such stretches and stay whole.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(*rest).alias("row"))
    left = suffix_index.remove_repeats(rows, match=FOUND_BYTES, keep_text=True, carried="row", least_words=PASSAGE_WORDS)
    back = {c: F.col(f"row.`{c}`") for c in rest} | {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return left.select(*[back[c].alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded up or down by a hash of its id and text.

    Rows that repeat id and text share what is taken of them evenly; texts without words go, as nothing is taken of them.
    """
    key, copies, copy = (_own_name(docs, x) for x in ("row_key", "n_copies", "copy"))
    rows = docs.withColumn(key, F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("doc_id", "text", F.col("doc_id").isNull()).alias("text")))
    taken = mixing.mix_sources(rows, id_col=key).where("taken > 0")
    chance = F.pmod(F.xxhash64(F.col(key), F.lit("copies")), F.lit(1 << 20)) / (1 << 20)
    share = taken.groupBy(key).agg(F.avg(F.col("taken") / F.col("size")).alias(copies))
    times = share.select(key, F.floor(F.col(copies) + chance).cast("int").alias(copies)).where(F.col(copies) > 0)
    return rows.join(times, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    return encode_documents(docs, piece_model_file())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: Near duplicates, byte removal, drawn blocks and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir))
        tables.drop_all_but(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
