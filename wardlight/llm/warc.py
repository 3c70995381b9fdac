"""WARC archives: written from pages with revisit records for repeated payloads, and read back by boundary chains.

Writing. A record per page goes through Spark's own text sink (its commit protocol survives lost executors, on any file
system Spark can write), after a warcinfo record at each file's start. Of pages with equal payloads of at least
`least_bytes`, the one of largest id is the response and the others are revisits that refer to it and carry no payload.

Reading. Files are read in byte ranges, as Spark splits them; a record, or its header, may lie in several. A payload may
hold anything, also a whole record, so a record's magic proves nothing. Tasks emit, for every place where the magic
stands and a header follows, the offset at which its successor would begin; headers that the range's end cuts are
completed from the next ranges' beginnings. Only what the chain of successors reaches from the file's start is a record.
Each task follows chains inside its range, so a candidate knows where its chain leaves it; pointer jumping over those
exits, in a number of rounds that is the logarithm of the ranges in a file, tells the ranges' true entries, and each
range then walks from its entries alone. A file whose chain doesn't end where the file does fails the job.

A response's payload is digested by the task that has all of it; those that lie in several ranges are put together from
their lines. Digests must equal the headers'. Revisits get payload length and page from the record they refer to, by a join.

Rows: a null html is the empty payload; null urls are left out of the header, line ends in them become blanks. Pages
without an id are responses unless a page with an id has their payload. Rows that repeat id and payload are all
responses. An empty table gives an empty archive and an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, cut, tidied
from .components import dealt_anew

MAGIC = b"WARC/1.0\r\n"
#: Header fields that reading needs.
FIELDS = {"content-length", "warc-type", "warc-payload-digest", "warc-record-id", "warc-refers-to"}
#: What a block's length may be: no file has more bytes than that, so whatever is longer is no record.
LENGTH = re.compile("[0-9]{1,15}")
#: Size of an archive, about.
ARCHIVE_BYTES = 64 << 20
#: Rows (repeated payloads, ranges, records that others refer to) that are sent to all tasks at most.
MOST_SENT = 100_000
#: Bytes of the bins by which records and ranges of a file find each other.
BIN_BYTES = 1 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: The format's names.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
INFO = "software: wardlight\r\nformat: WARC File Format 1.0\r\n"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four times 40 bits as eight digits, renamed to base32's letters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _sent(small: DataFrame) -> DataFrame:
    """For a join: sent to all tasks behind a count, else dealt out."""
    small = cut(small)
    return F.broadcast(small) if small.count() <= MOST_SENT else dealt_anew(small)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> int:
    """Writes the archives below folder; returns how many records of pages they have. date: of capture, as WARC-Date."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    known = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.col(url_col), "[\r\n]", " ").alias("url"), payload.alias("payload"))
    known = known.withColumns({"n": F.octet_length("payload").cast("long"), "digest": payload_digest(F.col("payload").cast("binary"))})
    keys = cut(known.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("response"), F.count("*").alias("pages")))
    records = known.agg(F.count("*"), F.sum(F.col("n") + F.coalesce(F.octet_length("url"), F.lit(0)))).first()
    rows = known.join(_sent(keys.where("pages > 1 AND response IS NOT NULL").select("digest", "n", "response")), ["digest", "n"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    name = lambda i, d: F.concat(F.lit("<urn:sha1:"), d, F.lit(":"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit("\r\n")), F.lit(""))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "payload"))
    record = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}\r\n"),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("response"), F.col("digest"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block, F.lit("\r\n"),
    )
    per_file = max(1, int(ARCHIVE_BYTES // max(1, (records[1] or 0) / max(1, records[0]) + 500)))
    # A task's rows are numbered in the order in which it writes them, so the first of each of its files is known.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    file_name = F.concat(F.lit("<urn:wardlight:archive:"), F.monotonically_increasing_id().cast("string"), F.lit(">"))
    info = F.concat(F.lit(f"{MAGIC.decode()}WARC-Type: warcinfo\r\nWARC-Record-ID: "), file_name, F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(INFO)}\r\n\r\n{INFO}\r\n\r\n"))
    whole = F.concat(F.when(place % per_file == 0, info).otherwise(F.lit("")), record)
    rows.select(whole.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", per_file).text(folder)
    return records[0]


def _headers(data: bytes) -> Iterator[tuple[int, dict[str, str], int]]:
    """For each place where the magic stands and a header follows: its offset, the header's fields, and where its block begins.

    A header may be of any length. Magics before the same blank line share its lines, which are read once, from the last
    backwards, so the time is linear however many magics a payload holds. Of a repeated field the last counts.
    """
    at, end = data.find(MAGIC), -1
    while at >= 0:
        if end < at:
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                return
            low, stop, whole = at + len(MAGIC), end, end  # all lines from `whole` on have a colon
            fields: dict[str, tuple[int, str]] = {}
            while stop >= low:
                start = max(low, data.rfind(b"\r\n", low, stop) + 2)
                if (colon := data.find(b":", start, stop)) < 0:
                    break
                if (key := data[start:colon].decode("utf-8", "replace").lower()) in FIELDS:
                    fields.setdefault(key, (start, data[colon + 1 : stop].strip().decode("utf-8", "replace")))
                whole, stop = start, start - 2
        if at + len(MAGIC) >= whole:
            own = {key: value for key, (start, value) in fields.items() if start >= at + len(MAGIC)}
            if LENGTH.fullmatch(own.get("content-length", "")) and "warc-type" in own:
                yield at, own, end + 4
        at = data.find(MAGIC, at + 1)


CANDIDATE = "at long, successor long, leaves long, body long, record_type string, record_id string, refers_to string, said string, payload_bytes long, payload_digest string"
RANGES = f"file string, start long, n_bytes long, head binary, goes_on boolean, tail_at long, tail binary, found array<struct<{CANDIDATE.replace(' long', ':long').replace(' string', ':string')}>>"


def _candidate(at: int, fields: dict[str, str], body: int) -> dict:
    successor = body + int(fields["content-length"]) + 4
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return {"at": at, "successor": successor, "leaves": successor, "body": body, "record_type": fields["warc-type"], "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "said": said, "payload_bytes": None, "payload_digest": None}


def _head(data: bytes) -> tuple[bytes, bool]:
    """What may end a header that an earlier range began: lines with a colon up to a blank line; whether it may go on still."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n", at)
        if end == at:
            return data[: at + 2], False
        if data.find(b":", at, end) < 0:
            return b"", False
        at = end + 2
    return data, True


def _range(file: str, start: int, data: bytes) -> dict:
    """All candidates of a range, with offsets in it; its beginning and the header that its end cuts."""
    found = [_candidate(*x) for x in _headers(data)]
    for x in found:
        stop = x["successor"] - 4
        if stop <= len(data) and x["record_type"] == "response":
            payload = data[data.find(b"\r\n\r\n", x["body"], stop) + 4 : stop]
            x["payload_bytes"], x["payload_digest"] = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    leaves: dict[int, int] = {}
    for x in reversed(found):
        x["leaves"] = leaves[x["at"]] = leaves.get(x["successor"], x["successor"])
    tail_at = data.find(MAGIC, data.rfind(b"\r\n\r\n") + 1)
    cut_off = tail_at >= 0
    head, goes_on = _head(data)
    return {"file": file, "start": start, "n_bytes": len(data), "head": head, "goes_on": goes_on, "tail_at": tail_at if cut_off else None, "tail": data[tail_at:] if cut_off else None, "found": found}


def _of_ranges(make, types: pa.Schema):
    """Applies make(file, start, lines) to the lines of each range, which come in order and together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lines = None, []
        for batch in batches:
            for line, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != key:
                    if key:
                        yield pa.RecordBatch.from_pylist(make(*key, lines), types)
                    key, lines = (file, start), []
                lines.append(line)
        if key:
            yield pa.RecordBatch.from_pylist(make(*key, lines), types)

    return run


def _completed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates whose header a range's end cut; offsets from the cut header's own place."""
    for batch in batches:
        for file, start, place, tail, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = [_candidate(*x) for x in _headers(tail + head) if x[0] < len(tail)]
            yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "base": place} | x for x in rows], _arrow(f"file string, start long, base long, {CANDIDATE}"))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def reachable_entries(jumps: DataFrame, starts: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(file, at) that chains of (file, at) -> leaves reach from the starts, by pointer jumping."""
    reached, jump = cut(starts.select("file", "at")), cut(jumps.select("file", "at", F.col("leaves").alias("to")))
    n = reached.count()
    for _ in range(most_rounds):
        further = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = cut(reached.union(further).distinct())
        if (now := reached.count()) == n:
            return reached
        n = now
        after = jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = cut(jump.join(after, ["file", "to"], "left").select("file", "at", F.coalesce("beyond", "to").alias("to")))
    raise RuntimeError(f"chains did not end in {most_rounds} rounds")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(line, file, start of the byte range): Spark's own splits of the files."""
    return spark.read.option("lineSep", "\r\n").text(folder).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _found(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranges with their base, the offset at which their first line begins; candidates with offsets in the file)."""
    types = pa.schema([*_arrow("file string, start long, n_bytes long, head binary, goes_on boolean, tail_at long, tail binary"), ("found", pa.list_(pa.struct(_arrow(CANDIDATE))))])
    make = lambda file, start, own: [_range(file, start, b"\r\n".join(own) + b"\r\n")]
    seen = cut(lines.mapInArrow(tidied(_of_ranges(make, types)), RANGES))
    in_file = W.partitionBy("file").orderBy("start")
    base = F.coalesce(F.sum("n_bytes").over(in_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = cut(seen.select("file", "start", "n_bytes", "goes_on", "head", "tail_at", "tail").withColumn("base", base))
    heads, further = cut(ranges.select("file", "start", "base", "tail_at", "tail", "head", F.col("head").alias("own"), F.col("goes_on").alias("open"), (F.col("goes_on") & F.lead("head").over(in_file).isNotNull()).alias("goes_on"))), 1
    while not heads.where("goes_on").isEmpty():  # what may be a header spans whole ranges
        more, still = F.lead("own", further).over(in_file), F.lead("open", further).over(in_file) & F.lead("own", further + 1).over(in_file).isNotNull()
        heads, further = cut(heads.withColumns({"head": F.when(F.col("goes_on"), F.concat("head", more)).otherwise(F.col("head")), "goes_on": F.col("goes_on") & F.coalesce(still, F.lit(False))})), further + 1
    opened = heads.withColumn("after", F.lead("head").over(in_file)).where("tail IS NOT NULL AND after IS NOT NULL")
    whole = opened.select("file", "start", F.col("base") + F.col("tail_at"), "tail", "after").mapInArrow(tidied(_completed), f"file string, start long, base long, {CANDIDATE}")
    own = seen.select("file", "start", F.inline("found")).join(_sent(ranges.select("file", "start", "base")), ["file", "start"])
    offsets = {c: F.col(c) + F.col("base") for c in ("at", "successor", "leaves", "body")}
    return ranges, cut(own.unionByName(whole).withColumns(offsets).drop("base"))


def _payloads(lines: DataFrame, ranges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, at, payload) of records (file, at, body, stop) that lie in several ranges, put together from their lines."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / BIN_BYTES), F.floor((b - 1) / BIN_BYTES)))
    there = ranges.select("file", "start", "base", bins(F.col("base"), F.col("base") + F.col("n_bytes")).alias("bin"))
    met = wanted.withColumn("bin", bins(F.col("at"), F.col("stop"))).join(there, ["file", "bin"]).drop("bin").distinct()
    by_range = met.groupBy("file", "start", "base").agg(F.collect_list(F.struct("at", "body", "stop")).alias("records"))

    def placed(file: str, start: int, own: list[bytes]) -> list[dict]:
        out, at = [], 0
        for x in own:
            out.append({"file": file, "start": start, "offset": at, "line": x})
            at += len(x) + 2
        return out

    ddl = "file string, start long, offset long, line binary"
    rows = lines.mapInArrow(tidied(_of_ranges(placed, _arrow(ddl))), ddl).join(_sent(by_range), ["file", "start"])
    rows = rows.withColumn("offset", F.col("offset") + F.col("base")).select("file", "offset", "line", F.explode("records").alias("x"))
    inside = rows.where((F.col("offset") < F.col("x.stop")) & (F.col("offset") + F.octet_length("line") + 2 > F.col("x.body")))
    whole = inside.groupBy("file", "x").agg(F.sort_array(F.collect_list(F.struct("offset", F.col("line").cast("string").alias("line")))).alias("lines"))
    text = F.concat(F.array_join(F.col("lines.line"), "\r\n"), F.lit("\r\n")).cast("binary")
    block = F.substring(text, F.col("x.body") - F.col("lines")[0].offset + 1, F.col("x.stop") - F.col("x.body"))
    after = F.locate("\r\n\r\n", F.col("block").cast("string"))  # the lines before it are ASCII, so places are bytes
    return whole.select("file", F.col("x.at").alias("at"), block.alias("block")).select("file", "at", F.substring("block", after + 4, F.octet_length("block")).alias("payload"))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each true response and revisit."""
    lines = _lines(spark, folder)
    ranges, found = _found(lines)
    files = ranges.groupBy("file").agg(F.sum("n_bytes").alias("at"))
    entries = reachable_entries(found, files.select("file", F.lit(0).cast("long").alias("at")))
    if bad := files.join(entries, ["file", "at"], "left_anti").first():
        raise RuntimeError(f"the chain of records of {bad['file']} does not end at its {bad['at']} bytes")

    def walked(rows: pd.DataFrame) -> pd.DataFrame:
        next_of = dict(zip(rows["at"], rows["successor"], strict=True))
        true = set()
        for at in rows.loc[rows["entry"], "at"]:
            while at in next_of and at not in true:
                true.add(at)
                at = next_of[at]
        return rows.loc[rows["at"].isin(true), ["file", "at"]]

    marked = found.join(entries.withColumn("entry", F.lit(True)), ["file", "at"], "left").select("file", "at", "successor", F.coalesce("entry", F.lit(False)).alias("entry"), "start")
    true = marked.groupBy("file", "start").applyInPandas(walked, "file string, at long")
    records = cut(found.join(true, ["file", "at"], "left_semi").where("record_type IN ('response', 'revisit')"))

    split = records.where("record_type = 'response' AND payload_digest IS NULL").select("file", "at", "body", (F.col("successor") - 4).alias("stop"))
    if not split.isEmpty():
        made = _payloads(lines, ranges, split).select("file", "at", F.octet_length("payload").cast("long").alias("made_bytes"), payload_digest(F.col("payload")).alias("made_digest"))
        records = records.join(_sent(made), ["file", "at"], "left").withColumns({"payload_bytes": F.coalesce("payload_bytes", "made_bytes"), "payload_digest": F.coalesce("payload_digest", "made_digest")})
    page = F.regexp_extract("record_id", ":(-?\\d+)>$", 1)
    records = cut(records.withColumn("page_id", F.when(page != "", page.cast("long"))))
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'")
    if wrong := responses.where("payload_digest IS NULL OR payload_digest <> said").first():
        raise RuntimeError(f"the payload of {wrong['record_id']} has another digest than its header says")
    named = revisits.select(F.col("refers_to").alias("record_id")).distinct()
    referred = responses.join(_sent(named), "record_id", "left_semi").groupBy("record_id").agg(F.max("payload_bytes").alias("n"), F.max("page_id").alias("page"))
    again = revisits.join(_sent(referred.withColumnRenamed("record_id", "refers_to")), "refers_to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns)
    return first.union(again.select("page_id", F.col("n").alias("payload_bytes"), F.col("said").alias("payload_digest"), "record_type", F.col("page").alias("refers_to")))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes all pages as archives in the shared folder and reads them back; fails if not as many records come back.

    The archives are deleted once their records are read; write_archives and read_archives keep them.
    """
    tables = Tables(pages.sparkSession)
    folder = f"{tables.root}/archives"
    written = write_archives(pages, folder, least_bytes=least_bytes)
    found = cut(read_archives(pages.sparkSession, folder))
    if (n := found.count()) != written:
        raise RuntimeError(f"{written} records were written and {n} read")
    tables.delete(folder)
    return found


def oracle() -> str:
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, list_aggregate(list_transform(range(0, 160, 5), lambda i: substr('{digits}', 1 + list_sum(list_transform(range(0, 5), lambda j:
    CASE WHEN (instr('0123456789abcdef', substr(sha1(h), 1 + ((i + j) // 4)::INTEGER, 1)) - 1) & (1 << (3 - (i + j) % 4)::INTEGER) > 0 THEN 1 << (4 - j)::INTEGER ELSE 0 END))::INTEGER, 1)), 'string_agg', '') AS digest FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY digest) AS m FROM d)
"""
