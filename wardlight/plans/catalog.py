"""Registered queries over the given tables, with the SQL that checks them.

The tables are generic, so each query shapes some of their columns like a hospital extract and applies one operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import clock_time, parse_wall_clock
from ..functions.text import id_list, is_id_list, is_limit_message
from ..operators import batches, columns, documents, intervals, labs, links, nested, stays
from ..operators.acts import unpivot

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def diag_tokens(spark, sf_dir):
    token = F.concat(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(":"), "l_returnflag", F.col("l_partkey").cast("string"))
    lists = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(token), " ").alias("dall"))
    return stays.diagnoses(lists, "dall")


DIAG_TOKENS = """
WITH d AS (SELECT l_orderkey, string_agg(lpad(l_linenumber::VARCHAR, 2, '0') || ':' || l_returnflag || l_partkey, ' ') AS dall FROM lineitem GROUP BY 1),
t AS (SELECT l_orderkey, unnest(string_split(dall, ' ')) AS tok FROM d)
SELECT l_orderkey, nullif(regexp_extract(tok, ':(.+)', 1), '') AS diag, substring(tok, 1, 2) AS type_diag FROM t WHERE regexp_matches(tok, '[0-9]')
"""


def _raw_date():
    d, k = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"), F.col("o_orderkey") % 7
    french, compact = F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yyyy"), F.date_format(F.col("o_orderdate").cast("date"), "yyyyMMdd")
    forms = {0: d, 1: F.concat(d, F.lit("T08:30:00")), 2: F.concat(french, F.lit(" 13:45")), 3: F.concat(compact, F.lit(" 134500")), 4: F.concat(d, F.lit(" 13:45")), 5: F.lit("x")}
    out = F.lit(None).cast("string")
    for n, form in forms.items():
        out = F.when(k == n, form).otherwise(out)
    return out


def parse_dates(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", _raw_date().alias("raw"))
    ts = parse_wall_clock(F.col("raw"))
    return rows.select("o_orderkey", "raw", ts.alias("ts"), clock_time(ts, F.col("raw")).alias("clock"))


PARSE_DATES = """
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T08:30:00'
    WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') || ' 13:45' WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') || ' 134500' WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 13:45' WHEN 5 THEN 'x' END AS raw FROM orders),
p AS (SELECT *, try_strptime(raw, ['%Y-%m-%d', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M', '%d/%m/%Y %H:%M', '%Y%m%d %H%M%S']) AS ts FROM r)
SELECT o_orderkey, raw, ts, CASE WHEN ts IS NOT NULL AND regexp_matches(raw, '[0-9]{2}:[0-9]{2}') THEN strftime(ts, '%H:%M:%S') END AS clock FROM p
"""


def order_periods(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    spans = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(d).alias("s"), F.max(d).alias("e"))
    rows = batches.period_rows(spans, ["o_custkey"], "s", "e", months=1, overlap_days=1)
    return rows.select("o_custkey", F.col("period_start").cast("string"), F.col("period_end").cast("string"))


ORDER_PERIODS = """
WITH w AS (SELECT o_custkey, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY 1),
p AS (SELECT o_custkey, e, (date_trunc('month', s) + to_months(i::INTEGER) + to_days((day(s) - 1)::INTEGER))::DATE AS period_start FROM w, range(0, 200) r(i)
    WHERE (date_trunc('month', s) + to_months(i::INTEGER) + to_days((day(s) - 1)::INTEGER))::DATE <= e)
SELECT o_custkey, period_start::VARCHAR AS period_start, least((coalesce(lead(period_start) OVER (PARTITION BY o_custkey ORDER BY period_start) - 1, e) + 1)::DATE, e)::DATE::VARCHAR AS period_end FROM p
"""


def act_unpivot(spark, sf_dir):
    """Lines of an order by number, one to seven; lines that share a number stand in one array."""
    lines = _t(spark, sf_dir, "lineitem")
    line = F.struct(F.col("l_partkey").cast("string").alias("p"), F.col("l_suppkey").cast("string").alias("s"))
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("l_linenumber") == k, line)))
    listed = lines.groupBy("l_orderkey").agg(*[of(k).alias(f"x{k}") for k in range(1, 8)])
    wide = listed.select("l_orderkey", *[F.col(f"x{k}.{c}").alias(f"{v}{k}") for k in range(1, 8) for v, c in (("CODEACTE", "p"), ("UFPRO", "s"))])
    return unpivot(wide, ["l_orderkey"], ["CODEACTE", "UFPRO"])


ACT_UNPIVOT = """
SELECT l_orderkey, l_partkey::VARCHAR AS "CODEACTE", l_suppkey::VARCHAR AS "UFPRO" FROM lineitem WHERE coalesce(l_partkey, l_suppkey) IS NOT NULL
"""


def act_arrays(spark, sf_dir):
    """Stays of orders whose acts are arrays below a path, through the stay tables."""
    line = F.struct(F.col("l_partkey").cast("string").alias("CODEACTE"), F.col("l_shipdate").cast("date").cast("string").alias("DATEACTE"), F.col("l_suppkey").cast("string").alias("UFPRO"))
    lists = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("PATID")).agg(F.collect_list(line).alias("x"))
    stay = lists.select("PATID", F.struct(*[F.col(f"x.{c}").alias(c) for c in ("CODEACTE", "DATEACTE", "UFPRO")]).alias("sejour"))
    return stays.act_table(stays.prepare(stay)).select("PATID", "CODEACTE", "DATEACTE", "UFPRO")


ACT_ARRAYS = """
SELECT DISTINCT l_orderkey::VARCHAR AS "PATID", l_partkey::VARCHAR AS "CODEACTE", strftime(l_shipdate, '%Y-%m-%d') AS "DATEACTE", l_suppkey::VARCHAR AS "UFPRO" FROM lineitem
"""


def act_paths(spark, sf_dir):
    """Stays of orders whose acts stand in records at several depths, next to wide columns; through the stay tables.

    Line 1 is wide, 2 and 3 are an array of records, 4 and 5 one below a path, 6 and 7 one inside records of an array.
    """
    act = F.struct(F.col("l_partkey").cast("string").alias("CODEACTE"), F.col("l_shipdate").cast("date").cast("string").alias("DATEACTE"), F.struct(F.col("l_linenumber").alias("n")).alias("x"), F.col("l_suppkey").cast("string").alias("UFPRO"))
    of = lambda a, b: F.collect_list(F.when(F.col("l_linenumber").between(a, b), act))
    first = F.collect_list(F.when(F.col("l_linenumber") == 1, F.struct(F.col("l_partkey").alias("p"), F.col("l_shipdate").cast("date").alias("d"), F.col("l_suppkey").alias("s"))))
    lists = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("PATID")).agg(first.alias("w"), of(2, 3).alias("ACTES"), of(4, 5).alias("deep"), of(6, 7).alias("inner"))
    units = F.array(F.struct(F.lit(None).cast(lists.schema["inner"].dataType).alias("ACTES")), F.struct(F.col("inner").alias("ACTES")))
    stay = lists.select("PATID", F.col("w.p").alias("CODEACTE1"), F.col("w.d").alias("DATEACTE1"), F.col("w.s").alias("UFPRO1"), "ACTES", F.struct(F.col("deep").alias("ACTES")).alias("sejour"), units.alias("unites"))
    return stays.act_table(stays.prepare(stay)).select("PATID", "CODEACTE", "DATEACTE", "UFPRO")


ACT_PATHS = ACT_ARRAYS


def json_shapes(spark, sf_dir):
    """Events as nested JSON texts of four unlike shapes, flattened without a schema."""
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("x")))  # noqa: E731  a text with its escapes, as {"x":…}
    k, props = F.get_json_object("props", "$.k"), F.col("props")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    n, user = F.col("event_id"), F.col("user_id")
    forms = [
        text('{"id":', n, ',"by":{"user":', user, ',"parts":[', k, ",", n, ']},"raw":', props, "}"),
        text('{"id":', n, ',"by":"nobody","tags":["', k, '"]}'),
        text('{"by":{"user":"u', user, '","parts":[', k, ",", k, ",", user, ']},"kind":', quoted("event_type"), "}"),
        text('{"id":[', n, '],"list":[{"k":', k, '},{"u":', user, "}]}"),
    ]
    json = F.when(n % 4 == 0, forms[0]).when(n % 4 == 1, forms[1]).when(n % 4 == 2, forms[2]).otherwise(forms[3])
    return nested.flatten_json(_t(spark, sf_dir, "events").select("event_id", json.alias("payload")), "payload")


JSON_SHAPES = """
WITH e AS (SELECT event_id, user_id::VARCHAR AS u, event_type, json_extract_string(props, '$.k') AS k, event_id % 4 AS m, event_id::VARCHAR AS n FROM events)
SELECT event_id, CASE WHEN m = 1 THEN 'nobody' END AS "by", CASE m WHEN 0 THEN k WHEN 2 THEN k END AS "by.parts1", CASE m WHEN 0 THEN n WHEN 2 THEN k END AS "by.parts2", CASE m WHEN 2 THEN u END AS "by.parts3",
    CASE m WHEN 0 THEN u WHEN 2 THEN 'u' || u END AS "by.user", CASE WHEN m IN (0, 1, 3) THEN n END AS id, CASE m WHEN 2 THEN event_type END AS "kind.x",
    CASE m WHEN 3 THEN k END AS "list1.k", NULL::VARCHAR AS "list1.u", NULL::VARCHAR AS "list2.k", CASE m WHEN 3 THEN u END AS "list2.u", CASE m WHEN 0 THEN k END AS "raw.k", CASE m WHEN 1 THEN k END AS tags FROM e
"""


def lab_results(spark, sf_dir):
    """A user's events in arrays of bounded size: one per user and bucket of event ids, so that no user is one row."""
    result = F.struct(F.col("event_type").alias("ANALYTE"), F.col("value").alias("VALEUR"), F.col("event_id").alias("NUM"))
    exams = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("PATID"), F.floor(F.col("event_id") / 1000).alias("bucket")).agg(F.collect_list(result).alias("RESULTATS"))
    return labs.results_of(exams).select("PATID", "ANALYTE", F.col("VALEUR").cast("double").alias("valeur"), "NUM")


LAB_RESULTS = """
WITH e AS (SELECT user_id, list({'a': event_type, 'v': value, 'n': event_id}) AS r FROM events GROUP BY 1), u AS (SELECT user_id, unnest(r) AS r FROM e)
SELECT user_id::VARCHAR AS "PATID", r.a AS "ANALYTE", r.v AS valeur, r.n::VARCHAR AS "NUM" FROM u
"""


def stay_links(spark, sf_dir):
    """Events, nine of ten without a stay's id, linked to stays made of orders: up to five days from a day of January 2024, some open."""
    k = F.col("o_orderkey")
    begins = F.timestamp_add("DAY", (k * 7 % 30).cast("int"), F.timestamp_add("HOUR", (k % 24).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")))
    stay = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("PATID"), k.alias("EVTID"), begins.alias("DATENT"), F.when(k % 17 != 0, F.timestamp_add("DAY", (1 + k % 5).cast("int"), begins)).alias("DATSORT"))
    exam = _t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("PATID"), F.col("ts").alias("DATEXAM"), F.when(F.col("event_id") % 10 == 0, -F.col("event_id")).alias("EVTID"))
    return intervals.with_stay_ids(exam, stay).select("event_id", "EVTID")


STAY_LINKS = """
WITH b AS (SELECT o_custkey AS p, o_orderkey AS k, TIMESTAMP '2024-01-01' + to_hours(o_orderkey % 24) + to_days((o_orderkey * 7 % 30)::INTEGER) AS f FROM orders),
s AS (SELECT p, k, f, CASE WHEN k % 17 <> 0 THEN f + to_days((1 + k % 5)::INTEGER) ELSE (SELECT max(ts) FROM events WHERE event_id % 10 <> 0) END AS t FROM b)
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -event_id ELSE k END AS "EVTID" FROM events LEFT JOIN s ON p = user_id AND ts BETWEEN f AND t
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY t - f, k) = 1
"""


def time_batches(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    span = orders.agg(F.min("d").alias("s"), F.max("d").alias("e"))
    windows = batches.period_rows(span, [], "s", "e", months=1, overlap_days=1)
    return batches.assign_windows(orders, "d", windows).groupBy(F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end")).agg(F.count("*").alias("n_rows"), documents.distinct_with_null(F.nullif("o_orderpriority", F.lit("1-URGENT"))).alias("units"))


TIME_BATCHES = """
WITH w AS (SELECT min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders),
p AS (SELECT e, (date_trunc('month', s) + to_months(i::INTEGER) + to_days((day(s) - 1)::INTEGER))::DATE AS period_start FROM w, range(0, 200) r(i)
    WHERE (date_trunc('month', s) + to_months(i::INTEGER) + to_days((day(s) - 1)::INTEGER))::DATE <= e),
q AS (SELECT period_start, least((coalesce(lead(period_start) OVER (ORDER BY period_start) - 1, e) + 1)::DATE, e)::DATE AS period_end FROM p),
x AS (SELECT nullif(o_orderpriority, '1-URGENT') AS u, * FROM orders JOIN q ON o_orderdate::DATE BETWEEN period_start AND period_end)
SELECT period_start::VARCHAR AS period_start, period_end::VARCHAR AS period_end, count(*) AS n_rows, count(DISTINCT u) + max((u IS NULL)::INTEGER) AS units FROM x GROUP BY 1, 2
"""


def stay_main(spark, sf_dir):
    orders, customers = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    raw = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(
        F.col("o_custkey").alias("PATID"), F.date_format("o_orderdate", "yyyy").alias("PATAGE"), F.col("c_mktsegment").alias("GHM"), F.col("o_orderstatus").alias("SRC"), "o_orderkey"
    )
    return columns.pick(stays.main_table(stays.prepare(raw)), ["PATID", "PATAGE", "GHM", "SRC"])


STAY_MAIN = """
SELECT DISTINCT o_custkey::VARCHAR AS "PATID", strftime(o_orderdate, '%Y') AS "PATAGE", c_mktsegment AS "GHM", o_orderstatus AS "SRC" FROM orders JOIN customer ON o_custkey = c_custkey
"""


def stack_missing(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    a = orders.where("o_orderkey % 5 < 3").select("o_orderkey", "o_custkey")
    b = orders.where("o_orderkey % 5 > 1").select("o_orderkey", "o_orderstatus")
    return columns.stack(columns.as_text(a), columns.as_text(b), distinct=True)


STACK_MISSING = """
SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, NULL::VARCHAR AS o_orderstatus FROM orders WHERE o_orderkey % 5 < 3
UNION SELECT o_orderkey::VARCHAR, NULL, o_orderstatus FROM orders WHERE o_orderkey % 5 > 1
"""


def id_triplets(spark, sf_dir):
    ids = F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("e"), F.col("l_partkey").cast("string").alias("p"), F.col("l_suppkey").cast("string").alias("s")))
    lists = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ids.alias("x"))
    return links.triplets(lists.select(F.col("x.e").alias("eltId"), F.col("x.p").alias("evtId"), F.array(F.col("l_orderkey").cast("string")).alias("patId")), external=None)


ID_TRIPLETS = """
SELECT DISTINCT l_linenumber::VARCHAR AS "ELTID", l_partkey::VARCHAR AS "EVTID", l_orderkey::VARCHAR AS "PATID" FROM lineitem
"""


def id_split(spark, sf_dir):
    k = F.col("o_orderkey")
    text = lambda n: (k * 4 + n).cast("string")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(text(0), F.lit(" OR "), text(1), F.lit(", "), text(2), F.lit(";"), text(3)).alias("ids"))
    return rows.select("o_orderkey", is_id_list(F.col("ids")).alias("listed"), F.explode(id_list(F.col("ids"))).alias("id"))


ID_SPLIT = """
WITH s AS (SELECT o_orderkey, (o_orderkey * 4) || ' OR ' || (o_orderkey * 4 + 1) || ', ' || (o_orderkey * 4 + 2) || ';' || (o_orderkey * 4 + 3) AS ids FROM orders)
SELECT o_orderkey, regexp_matches(ids, '[\\s,;]') AS listed, unnest(list_filter(regexp_split_to_array(regexp_replace(ids, '\\s+OR\\s+', ' ', 'g'), '[\\s,;]+'), lambda x: x <> '')) AS id FROM s
"""


def id_chunks(spark, sf_dir):
    ids = batches.chunked(_t(spark, sf_dir, "orders"), "o_custkey", 350)
    return ids.groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_custkey").alias("first_id"), F.max("o_custkey").alias("last_id"))


ID_CHUNKS = """
SELECT chunk, count(*) AS n, min(o_custkey) AS first_id, max(o_custkey) AS last_id FROM (SELECT o_custkey, (row_number() OVER (ORDER BY o_custkey) - 1) // 350 + 1 AS chunk FROM (SELECT DISTINCT o_custkey FROM orders)) GROUP BY 1
"""


def id_semi(spark, sf_dir):
    ids = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return batches.restrict(_t(spark, sf_dir, "orders"), ids, "o_custkey").select("o_orderkey", "o_custkey")


ID_SEMI = "SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_mktsegment = 'BUILDING') USING (o_custkey)"

#: Bounds as requests write them.
BOUNDS = ["{1996-01-01,1996-12-31}", ">1998-06-30", "<1995-02-01", "1997"]


def range_bounds(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    orders = _t(spark, sf_dir, "orders")

    tagged = orders.select("o_orderstatus", F.explode(F.filter(F.array(*[F.when(batches.within(d, t), F.lit(t)) for t in BOUNDS]), lambda x: x.isNotNull())).alias("bounds"))
    return tagged.groupBy("bounds", "o_orderstatus").agg(F.count("*").alias("n"))


RANGE_BOUNDS = """
SELECT b AS bounds, o_orderstatus, count(*) AS n FROM orders, (VALUES ('{1996-01-01,1996-12-31}'), ('>1998-06-30'), ('<1995-02-01'), ('1997')) t(b)
WHERE CASE b WHEN '{1996-01-01,1996-12-31}' THEN o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' WHEN '>1998-06-30' THEN o_orderdate::DATE > DATE '1998-06-30'
    WHEN '<1995-02-01' THEN o_orderdate::DATE < DATE '1995-02-01' ELSE true END GROUP BY 1, 2
"""


def limit_errors(spark, sf_dir):
    kind = F.col("event_type")
    message = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Too many results for "), kind)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Connection refused by "), kind)).when(F.col("event_id") % 4 == 2, F.lit("maximum allowed size reached"))
    rows = _t(spark, sf_dir, "events").select("event_type", message.alias("m"))
    return rows.groupBy("event_type").agg(F.count_if(is_limit_message(F.col("m"))).alias("n_limit"), F.count("m").alias("n_messages"))


LIMIT_ERRORS = """
WITH m AS (SELECT event_type, CASE event_id % 4 WHEN 0 THEN 'Too many results for ' || event_type WHEN 1 THEN 'Connection refused by ' || event_type WHEN 2 THEN 'maximum allowed size reached' END AS m FROM events)
SELECT event_type, count(*) FILTER (WHERE regexp_matches(lower(m), 'too many|limit|quota|max results|max rows|allowed size')) AS n_limit, count(m) AS n_messages FROM m GROUP BY 1
"""


def out_units(spark, sf_dir):
    joined = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(documents.distinct_with_null(F.col("quality")).alias("units"))


OUT_UNITS = "SELECT lang, count(DISTINCT quality) + max((quality IS NULL)::INTEGER) AS units FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"


def json_flatten(spark, sf_dir):
    return nested.json_leaves(_t(spark, sf_dir, "events"), "props", {"k": "$.k"}).select("event_id", F.col("k").try_cast("long").alias("k"))


JSON_FLATTEN = "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events"


def id_key_pick(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select(k, F.when(k % 3 == 0, k).alias("ELTID"), F.when(k % 2 == 0, F.col("o_custkey")).alias("EVTID"), F.lit(7).cast("long").alias("PATID"))
    return rows.select("o_orderkey", batches.most_specific_id(rows.columns).alias("id"))


ID_KEY_PICK = "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, 7) AS id FROM orders"


def queries() -> dict[str, Query]:
    found = [diag_tokens, parse_dates, order_periods, act_unpivot, act_arrays, act_paths, json_shapes, lab_results, stay_links, time_batches, stay_main, stack_missing, id_triplets, id_split, id_chunks, id_semi, range_bounds, limit_errors, out_units, json_flatten, id_key_pick]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {name: globals()[name.upper()] for name in queries()}
