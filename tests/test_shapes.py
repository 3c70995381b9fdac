import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from wardlight.functions.dates import clock_time, parse_wall_clock
from wardlight.functions.text import id_list, is_id_list, is_limit_message, limit_message, looks_like_id_list, split_ids
from wardlight.operators import batches, columns, intervals, labs, links, nested, stays
from wardlight.plans.windows import bounds_of
from wardlight.operators.documents import distinct_with_null, document_rows, document_table, out_units

DATES = [
    ("2024-01-01", datetime(2024, 1, 1), None),
    ("2024-01-01 13:45", datetime(2024, 1, 1, 13, 45), "13:45:00"),
    ("2024-01-01 13:45:10", datetime(2024, 1, 1, 13, 45, 10), "13:45:10"),
    ("2020-01-01T08:30:00", datetime(2020, 1, 1, 8, 30), "08:30:00"),
    ("01/02/2024 08:00", datetime(2024, 2, 1, 8), "08:00:00"),
    ("20240101", datetime(2024, 1, 1), None),
    ("20240101 134500", datetime(2024, 1, 1, 13, 45), None),
    ("20240101 1345", datetime(2024, 1, 1, 13, 45), None),
    ("2024-1-5", datetime(2024, 1, 5), None),
    *[(x, None, None) for x in ("2024-02-30", "x", "", None, "2024-01-01T08:30:00Z", "01022024", "2024-01-01 25:00")],
    ("2024-03-31 02:30", datetime(2024, 3, 31, 2, 30), "02:30:00"),
]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris", "America/New_York"])
def test_dates_in_any_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(DATES)], "i int, raw string")
        ts = parse_wall_clock(F.col("raw"))
        got = df.select("i", ts.alias("ts"), clock_time(ts, F.col("raw")).alias("clock")).orderBy("i").collect()
        assert [(r.ts, r.clock) for r in got] == [x[1:] for x in DATES]
        gap = df.where("raw = '2024-03-31 02:30'").select(parse_wall_clock(F.col("raw"), "Europe/Paris")).first()[0]
        assert gap is None
        assert df.where("i = 1").select(parse_wall_clock(F.col("raw"), "Europe/Paris")).first()[0] == DATES[1][1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_diagnosis_tokens(spark):
    cases = ["01:A41 02:I10", "01:A41  02:I10 ", "01:A:41", "01A41", "01:", "AB:CD", None]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = sorted(map(tuple, stays.diagnoses(df, "t").collect()), key=str)
    want = [(0, "A41", "01"), (0, "I10", "02"), (1, "A41", "01"), (1, "I10", "02"), (2, "A:41", "01"), (3, None, "01"), (4, None, "01")]
    assert got == sorted(want, key=str)


STAY = {"PATID": "P1", "EVTID": "E1", "ELTID": "L1", "DATENT": "2020-01-01T08:30:00", "DATSORT": "2020-01-02T10:15:00", "PATAGE": "40", "PATSEX": "M", "DALL": "01:AA 02:B2", "CODEACTE1": "A123", "DATEACTE1": "2020-01-01T09:00:00", "UFPRO1": "01", "NBACTES": "3"}


def test_stay_tables_and_their_duplicates(spark):
    df = spark.createDataFrame([STAY, STAY])
    t = stays.stay_tables(df)
    main = t.main.collect()
    assert t.main.columns == stays.MAIN and len(main) == 1
    assert (main[0].DATENT, main[0].HEURE_DATENT, main[0].HEURE_DATSORT) == (datetime(2020, 1, 1, 8, 30), "08:30:00", "10:15:00")
    acts = t.acts.collect()
    assert len(acts) == 1 and (acts[0].CODEACTE, acts[0].UFPRO, acts[0].NOMENCLATURE, acts[0].NBACTES) == ("A123", "01", None, "3")
    assert sorted((r.diag, r.type_diag) for r in t.diagnoses.collect()) == [("AA", "01"), ("AA", "01"), ("B2", "02"), ("B2", "02")]


def test_stays_of_any_shape_have_the_fixed_columns(spark):
    t = stays.stay_tables(spark.createDataFrame([("P1",)], "PATID string"))
    assert t.main.columns == stays.MAIN and t.main.count() == 1
    assert t.acts.count() == 0 and t.diagnoses.count() == 0
    empty = stays.stay_tables(spark.createDataFrame([], "PATID string, DALL string"))
    assert empty.main.count() == empty.acts.count() == empty.diagnoses.count() == 0


def test_acts_pair_by_suffix_or_position(spark):
    df = spark.createDataFrame([("c1", "c2", "d2")], "CODEACTE1 string, CODEACTE2 string, DATEACTE2 string")
    rows = lambda pairing: sorted(((r.CODEACTE, r.DATEACTE) for r in stays.act_table(stays.prepare(df), pairing).collect()), key=str)
    assert rows("suffix") == [("c1", None), ("c2", "d2")]
    assert rows("position") == [("c1", "d2"), ("c2", None)]
    dense = spark.createDataFrame([("c1", "c2", "d1", "d2")], "CODEACTE1 string, CODEACTE2 string, DATEACTE1 string, DATEACTE2 string")
    by = {p: sorted((r.CODEACTE, r.DATEACTE) for r in stays.act_table(stays.prepare(dense), p).collect()) for p in ("suffix", "position")}
    assert by["suffix"] == by["position"]


def test_acts_of_an_array(spark):
    df = spark.createDataFrame([("P", [("a", "d"), ("b", None), (None, None)])], "PATID string, ACTES array<struct<CODEACTE:string,DATEACTE:string>>")
    assert sorted((r.CODEACTE, r.DATEACTE) for r in stays.act_table(stays.prepare(df)).collect()) == [("a", "d"), ("b", None)]


def acts_of(df, columns=("CODEACTE", "DATEACTE", "UFPRO")):
    return sorted((tuple(r[c] for c in columns) for r in stays.stay_tables(df).acts.collect()), key=str)


def test_scalar_array_and_nested_acts_agree(spark):
    scalar = spark.createDataFrame([("P", "A1", "A2", "d1", "d2", "u1", "u2")], "PATID string, CODEACTE1 string, CODEACTE2 string, DATEACTE1 string, DATEACTE2 string, UFPRO1 string, UFPRO2 string")
    arrays = spark.createDataFrame([("P", ["A1", "A2"], ["d1", "d2"], ["u1", "u2"])], "PATID string, CODEACTE array<string>, DATEACTE array<string>, UFPRO array<string>")
    nested_ = spark.createDataFrame([("P", (("A1", "d1", "u1"), ("A2", "d2", "u2")))], "PATID string, s struct<a:struct<CODEACTE:string,DATEACTE:string,UFPRO:string>,b:struct<CODEACTE:string,DATEACTE:string,UFPRO:string>>")
    both = spark.createDataFrame([("P", (["A1", "A2"], ["d1", "d2"], ["u1", "u2"]))], "PATID string, s struct<CODEACTE:array<string>,DATEACTE:array<string>,UFPRO:array<string>>")
    want = [("A1", "d1", "u1"), ("A2", "d2", "u2")]
    assert acts_of(scalar) == acts_of(arrays) == acts_of(nested_) == acts_of(both) == want


def test_acts_of_unlike_arrays(spark):
    schema = "PATID string, CODEACTE array<string>, DATEACTE array<string>, UFPRO string, NBACTES array<string>"
    rows = [("P", ["A1", "A2", "A3"], ["d1", "d2"], "u", ["3"]), ("Q", None, ["d"], None, None), ("R", [], [], None, None), ("S", ["A"], None, "u", None)]
    assert acts_of(spark.createDataFrame(rows, schema)) == sorted([("A1", "d1", "u"), ("A2", "d2", "u"), ("A3", None, "u"), (None, "d", None), ("A", None, "u")], key=str)


def test_diagnoses_of_nested_ids_and_arrays(spark):
    df = spark.createDataFrame([("P", ("x", 1), ["01:A41", "02:I10"])], "PATID string, s struct<SUBID:string,UFDEM:int>, DALL array<string>")
    t = stays.stay_tables(df)
    assert sorted((r["s.SUBID"], r.diag) for r in t.diagnoses.collect()) == [("x", "A41"), ("x", "I10")]
    assert t.main.count() == 1 and t.acts.count() == 1  # a unit alone is a row


def test_timestamps_pass_unchanged(spark):
    t = datetime(2024, 1, 1, 10, 30, 15, 250_000)
    df = spark.createDataFrame([("P", t, date(2024, 1, 2))], "PATID string, DATENT timestamp_ntz, DATSORT date")
    row = stays.stay_tables(df).main.first()
    assert (row.DATENT, row.HEURE_DATENT, row.DATSORT, row.HEURE_DATSORT) == (t, "10:30:15", datetime(2024, 1, 2), None)
    exams = spark.createDataFrame([("e", t, [("Hb",)])], "BIOL_ID string, DATEXAM timestamp, RESULTATS array<struct<ANALYTE:string>>")
    assert labs.lab_table(exams).first().DATEXAM == t


def test_bounds_and_ids_as_columns(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-10')) AS d UNION ALL SELECT NULL")
    for text in ("{2024-01-03,2024-01-05}", ">2024-01-07", "<2024-01-03", "2024"):
        got = [r.d for r in days.where(batches.within(F.col("d"), text)).collect()]
        assert {*got} == {*[date(2024, 1, i) for i in range(1, 11) if bounds_of(text).holds(date(2024, 1, i))], *([None] if text == "2024" else [])}
    ids = spark.createDataFrame([("e", None, "p"), (None, None, "p"), (None, None, None)], "EVTID string, ELTID string, PATID string")
    assert [r[0] for r in ids.select(batches.most_specific_id(ids.columns)).collect()] == ["e", "p", None]


def test_flatten(spark):
    df = spark.createDataFrame([(("x", ("y", 1)), ["a", "b"], [("k",)])], "s struct<p:string,q:struct<r:string,n:int>>, SOME array<string>, o array<struct<k:string>>")
    plain = nested.flatten(df)
    assert plain.columns == ["s.p", "s.q.r", "s.q.n", "SOME", "o"] and plain.first()["s.q.n"] == "1"
    assert nested.flatten(df, collapse=";").first()["SOME"] == "a;b"
    wide = nested.flatten(df, widen={"SOME": 3}).first()
    assert (wide["SOME1"], wide["SOME2"], wide["SOME3"]) == ("a", "b", None)
    keys = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, "no json"), (3, None)], "i int, j string")
    assert {(r.i, r.key, r.value) for r in nested.unknown_leaves(keys, "j", ["i"]).where("key IS NOT NULL").collect()} == {(1, "a", "1"), (1, "b", "x")}
    assert [r.v for r in nested.json_leaves(keys, "j", {"v": "$.a"}).orderBy("i").collect()] == ["1", None, None]


def test_flatten_keeps_what_clashes(spark):
    df = spark.createDataFrame([(("s",), "top", ("low",), "C", ["x", "y"], "one")], "a struct<b:string>, `a.b` string, c struct<d:string>, `C.D` string, S array<string>, S1 string")
    assert nested.flatten(df).first().asDict() == {"a.b": "s", "a.b_2": "top", "c.d": "low", "C.D_2": "C", "S": ["x", "y"], "S1": "one"}
    assert nested.flatten(df, widen=True).first().asDict() == {"a.b": "s", "a.b_2": "top", "c.d": "low", "C.D_2": "C", "S1": "x", "S2": "y", "S1_2": "one"}


def test_widths_come_from_the_data(spark):
    df = spark.createDataFrame([("P", (["a"], ["u"]), None), ("Q", (["b", "c", "d"], None), [])], "PATID string, s struct<x:array<string>,y:array<string>>, z array<int>")
    assert nested.widths(df) == {"s.x": 3, "s.y": 1, "z": 1}
    wide = nested.flatten(df, widen=True)
    assert wide.columns == ["PATID", "s.x1", "s.x2", "s.x3", "s.y", "z"]
    assert sorted(tuple(r) for r in wide.collect()) == [("P", "a", None, None, "u", None), ("Q", "b", "c", "d", None, None)]
    acts = spark.createDataFrame([("P", ["A", "B"], ["d1", "d2"])], "PATID string, CODEACTE array<string>, DATEACTE array<string>")
    assert {(r.CODEACTE, r.DATEACTE) for r in stays.stay_tables(acts, widen=True).acts.collect()} == {("A", "d1"), ("B", "d2")}
    with pytest.raises(ValueError, match="over 5000 columns"):
        nested.flatten(df, widen={"z": 6000})


JSONS = [
    '{"id":1,"a":{"b":"x","c":[1,2]},"w q":{"e\\u0027f":{"g\\"h":3,"k\\u0027\\"l":4}}}',
    '{"id":2,"a":"plain","t":["z"]}',
    '{"a":{"b":1.5,"c":[7,8,9]},"o":[{"k":1},{"k":[1,2]},5]}',
    None,
    "bad{",
    '{"t":"alone","a.b":"dot","m":[[1],[2,3]],"n":null,"e":{},"z":[]}',
    "[1,2]",
    '"s"',
]


def test_json_of_unknown_shapes(spark):
    df = spark.createDataFrame([(i, j, "kept") for i, j in enumerate(JSONS)], "i int, j string, N string")
    out = nested.flatten_json(df, "j")
    assert [*out.columns[:2], *sorted(out.columns[2:])] == ["i", "N", *sorted(["a", "a.b", "a.c1", "a.c2", "a.c3", "a.b_2", "id", "m11", "m12", "m21", "m22", "n_2", "o1", "o1.k1", "o1.k2", "o2", "o2.k1", "o2.k2", "o3", "o3.k1", "o3.k2", "t", "w q.e'f.g\"h", "w q.e'f.k'\"l", "z", "j1", "j2"])]
    got = {r.i: {k: v for k, v in r.asDict().items() if v is not None and k not in ("i", "N")} for r in out.collect()}
    assert got == {
        0: {"id": "1", "a.b": "x", "a.c1": "1", "a.c2": "2", "w q.e'f.g\"h": "3", "w q.e'f.k'\"l": "4"},
        1: {"id": "2", "a": "plain", "t": "z"},
        2: {"a.b": "1.5", "a.c1": "7", "a.c2": "8", "a.c3": "9", "o1.k1": "1", "o2.k1": "1", "o2.k2": "2", "o3": "5"},
        3: {}, 4: {}, 6: {"j1": "1", "j2": "2"}, 7: {"j1": "s"},
        5: {"t": "alone", "a.b_2": "dot", "m11": "1", "m21": "2", "m22": "3"},
    }
    assert nested.flatten_json(df.limit(0), "j").columns == ["i", "N"]
    assert nested.flatten_json(df.where("i IN (3, 4)"), "j").columns == ["i", "N"]
    known = nested.shape_of(df, "j")  # a shape serves other rows of the same kind
    assert nested.flatten_json(df.where("i = 2"), "j", known).first()["o3"] == "5"


def test_stays_of_json_texts(spark):
    texts = ['{"PATID":"P","DATENT":"2020-01-01 08:30","ACTES":[{"CODEACTE":"A","UFPRO":"1"},{"CODEACTE":"B"}],"CODEACTE1":"W","DALL":["01:A41","02:I10"]}', '{"PATID":"Q","DALL":"01:I10"}']
    t = stays.stay_tables(spark.createDataFrame([(x,) for x in texts], "payload string"), json_col="payload")
    assert {(r.PATID, r.CODEACTE, r.UFPRO) for r in t.acts.collect()} == {("P", "A", "1"), ("P", "B", None), ("P", "W", None)}
    assert sorted((r.PATID, str(r.HEURE_DATENT)) for r in t.main.collect()) == [("P", "08:30:00"), ("Q", "None")]


ACT = "struct<CODEACTE:string,DATEACTE:string,UFPRO:string>"
SHAPES = {
    "ACTES": (f"array<{ACT}>", lambda acts: acts),
    "sejour": (f"struct<ACTES:array<{ACT}>>", lambda acts: (acts,)),
    "sejours": (f"array<struct<n:int,ACTES:array<{ACT}>>>", lambda acts: [(1, acts[:1]), (2, None), None, (3, [*acts[1:], None])]),
    "par_unite": (f"map<string,struct<u:struct<ACTES:array<{ACT}>>>>", lambda acts: {"x": ((acts,),), "y": None}),
    "listes": (f"array<array<{ACT}>>", lambda acts: [acts[:1], None, [], acts[1:]]),
    "detail": ("array<struct<x:struct<CODEACTE:string,DATEACTE:string>,x2:struct<CODEACTE:string,DATEACTE:string>>>", None),
}


@pytest.mark.parametrize("path", [p for p in SHAPES if SHAPES[p][1]])
@pytest.mark.parametrize("wide", [False, True])
def test_acts_at_any_path(spark, path, wide):
    acts = [("A", "d1", "u"), ("B", None, "v"), (None, "d3", None), (None, None, None)]
    kind, made = SHAPES[path]
    schema = f"PATID string, {path} {kind}" + ", CODEACTE1 string, DATEACTE1 string, NBACTES int" * wide
    rows = [("P", made(acts), *("W", "d9", 3)[: 3 * wide]), ("Q", None, *(None,) * 3 * wide)]
    got = stays.stay_tables(spark.createDataFrame(rows, schema)).acts
    wanted = {("P", *a) for a in acts[:3]} | ({("P", "W", "d9", None)} if wide else set())
    assert {(r.PATID, r.CODEACTE, r.DATEACTE, r.UFPRO) for r in got.collect()} == wanted
    assert got.count() == len(wanted) and ("NBACTES" in got.columns) == wide


def test_acts_pair_inside_their_record(spark):
    df = spark.createDataFrame([("P", [(("A", "d1"), ("B", None)), ((None, "d2"), ("C", "d3"))])], f"PATID string, detail {SHAPES['detail'][0]}")
    assert {(r.CODEACTE, r.DATEACTE) for r in stays.stay_tables(df).acts.collect()} == {("A", "d1"), ("B", None), (None, "d2"), ("C", "d3")}


def test_select_by_name_and_stack(spark):
    a = spark.createDataFrame([(1, "x")], "id int, MyACTE string")
    b = spark.createDataFrame([("1", "x"), ("1", "x")], "id string, other string")
    assert columns.containing(a, "acte") == ["MyACTE"] and columns.ending(a, "ID") == ["id"]
    assert columns.pick(a, ["none", "id"]).columns == ["id"] and columns.pick(a, ["none", "id"], "string").columns == ["none", "id"]
    both = columns.stack(columns.as_text(a), b)
    assert both.columns == ["id", "MyACTE", "other"] and both.count() == 3
    assert columns.stack(columns.as_text(a), b, distinct=True).count() == 2


def test_labs(spark):
    schema = "BIOL_ID string, PATID string, DATEXAM string, RESULTATS array<struct<ANALYTE:string,VALEUR:double,DATEXAM:string>>"
    df = spark.createDataFrame([("examA", "P1", "2020-01-01 08:30", [("Hb", 13.2, "r")]), ("examB", "P2", None, []), ("examC", "P3", None, None)], schema)
    out = labs.lab_table(df)
    rows = out.collect()
    assert out.columns == [*labs.EXAM, "ANALYTE", "VALEUR", "DATEXAM_RESULT", "HEURE_DATEXAM"] and len(rows) == 1
    assert (rows[0].BIOL_ID, rows[0].VALEUR, rows[0].HEURE_DATEXAM, rows[0].DATEXAM_RESULT) == ("examA", "13.2", "08:30:00", "r")
    flat = labs.lab_table(spark.createDataFrame([("P1", "Hb")], "PATID string, ANALYTE string"))
    assert flat.columns == ["PATID", "ANALYTE"]
    by_map = labs.from_map(spark.createDataFrame([({"examA": ("P1",)},)], "m map<string,struct<PATID:string>>"), "m")
    by_list = labs.from_list(spark.createDataFrame([([("P1",), ("P2",)],)], "l array<struct<PATID:string>>"), "l")
    assert by_map.first().BIOL_ID == "examA" and [r.BIOL_ID for r in by_list.orderBy("BIOL_ID").collect()] == ["1", "2"]


def test_triplets(spark):
    schema = "eltExt array<string>, eltId array<string>, evtId array<string>, patId array<string>"
    df = spark.createDataFrame([(["x", "y"], ["1", "2"], ["e", "e"], ["p"]), (["x"], ["1"], ["e"], ["p"]), (["x"], ["3"], None, ["p"])], schema)
    assert {tuple(r) for r in links.triplets(df).collect()} == {("1", "e", "p"), ("2", "e", "p"), ("3", None, "p")}
    bad = spark.createDataFrame([(["x", "y"], ["1", "2", "3"], ["e"], ["p"])], schema)
    with pytest.raises(Exception, match="unlike lengths"):
        links.triplets(bad).collect()


def test_documents(spark):
    one = {"DOC_ID": "1"}
    assert document_rows([one]) == document_rows({"data": [one]}) == document_rows({"result": [one]}) == document_rows({"value": one}) == document_rows([[one]]) == [one]
    assert document_rows({"DOC_ID": ["1", "2"]}) == [{"DOC_ID": "1"}, {"DOC_ID": "2"}]
    assert document_rows("text") is None and document_rows([]) == []
    assert out_units("doceds", [one, one, {"DOC_ID": None}]) == 2 and out_units("pmsi", [1, 2]) == 2 and out_units("biol", None) == 0
    assert out_units("pmsi", [1, 2], "idtriplets") == 2 and out_units("doceds", {"x": 1}, "idtriplets") == 0
    a, b = spark.createDataFrame([(1,)], "DOC_ID int"), spark.createDataFrame([("1", "t")], "DOC_ID string, TEXT string")
    assert document_table(a, a, b).count() == 2
    df = spark.createDataFrame([("a",), (None,), ("a",)], "x string")
    assert df.agg(distinct_with_null(F.col("x"))).first()[0] == 2 and df.limit(0).agg(distinct_with_null(F.col("x"))).first()[0] == 0


def test_id_lists_and_messages(spark):
    for text, want in (("1 OR 2 OR 3", ["1", "2", "3"]), ("1,2;3 4", ["1", "2", "3", "4"]), ("1", ["1"]), (" ", [])):
        assert split_ids(text) == want
        row = spark.createDataFrame([(text,)], "t string").select(id_list(F.col("t")).alias("a"), is_id_list(F.col("t")).alias("b")).first()
        assert row.a == want and row.b == looks_like_id_list(text)
    assert split_ids(["10 OR 11", "12", None, ""]) == ["10", "11", "12"] and looks_like_id_list(["a", "b"]) and not looks_like_id_list(None)
    for message, want in (("Too many results, please narrow your query", True), (["Error:", "allowed size limit exceeded"], True), ("Connection refused", False), ("maximum allowed size reached", True), (None, False)):
        assert limit_message(message) is want
    df = spark.createDataFrame([("Quota used",), (None,)], "m string")
    assert [r[0] for r in df.select(is_limit_message(F.col("m"))).collect()] == [True, False]


def test_table_batches(spark):
    ids = spark.createDataFrame([(i,) for i in range(1000)] + [(5,), (None,)], "k long")
    chunks = batches.chunked(ids, "k", 350).groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in chunks] == [(1, 350), (2, 350), (3, 300)]
    assert batches.chunked(ids.limit(0), "k", 350).count() == 0
    assert batches.restrict(ids, spark.createDataFrame([(5,), (6,)], "k long"), "k").count() == 3
    d = spark.sql("SELECT DATE'2024-01-31' AS s, DATE'2024-06-30' AS e UNION ALL SELECT DATE'2024-02-02', DATE'2024-01-01'")
    rows = batches.period_rows(d, [], "s", "e", overlap_days=1).orderBy("period_start").collect()
    assert [str(r.period_start) for r in rows] == ["2024-01-31", "2024-03-02", "2024-03-31", "2024-05-01", "2024-05-31"]
    assert [str(r.period_end) for r in rows] == ["2024-03-02", "2024-03-31", "2024-05-01", "2024-05-31", "2024-06-30"]
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-31', DATE'2024-06-30')) AS day")
    closed = batches.period_rows(d, [], "s", "e")
    assert batches.assign_windows(days, "day", closed).count() == days.count()


def test_rows_find_the_stay_that_holds_them(spark):
    at = lambda text: datetime.fromisoformat(text) if text else None
    rng = random.Random(1)
    stays_ = [("P", "long", "2024-01-01 00:00", "2024-03-01 00:00"), ("P", "b", "2024-01-10 08:00", "2024-01-12 08:00"), ("P", "a", "2024-01-11 08:00", "2024-01-13 08:00"), ("P", "open", "2024-03-10 00:00", None)]
    stays_ += [("P", None, "2024-01-01 00:00", "2024-01-02 00:00"), (None, "x", "2024-01-01 00:00", "2024-01-02 00:00"), ("P", "back", "2024-02-02 00:00", "2024-02-01 00:00"), ("P", "none", None, "2024-02-01 00:00")]
    stays_ += [(f"R{i % 3}", f"s{i}", f"2024-01-{1 + i:02} 06:00", f"2024-01-{2 + i + i % 4:02} 06:00") for i in range(24)] + [("R0", "s0", "2024-01-01 06:00", "2024-01-02 06:00")]
    rows = [("P", t, None) for t in ("2024-01-10 08:00", "2024-01-11 08:00", "2024-01-12 08:00", "2024-01-12 08:01", "2024-02-01 12:00", "2024-03-01 00:01", "2024-03-10 00:00", "2024-04-01 00:00", None)]
    rows += [("P", "2024-01-10 09:00", "own"), (None, "2024-01-10 09:00", None), ("Q", "2024-01-10 09:00", None), ("P", "2024-01-12 08:00", None)]
    rows += [(f"R{rng.randrange(4)}", f"2024-01-{rng.randint(1, 28):02} {rng.randrange(24):02}:00", None) for _ in range(200)]
    exams = spark.createDataFrame([(i, p, at(t), e) for i, (p, t, e) in enumerate(rows)], "n int, PATID string, DATEXAM timestamp_ntz, EVTID string")
    table = spark.createDataFrame([(p, e, at(a), at(b)) for p, e, a, b in stays_], "PATID string, EVTID string, DATENT timestamp_ntz, DATSORT timestamp_ntz")
    last = max(t for _, t, e in rows if t and not e)

    def best(p, t):
        found = [(at(b or last) - at(a), e) for q, e, a, b in stays_ if p and t and q == p and e and a and a <= t <= (b or last)]
        return min(found)[1] if found else None

    for bin_days in (1, 7, 400):
        got = {r.n: r.EVTID for r in intervals.with_stay_ids(exams, table, bin_days=bin_days).collect()}
        assert got == {i: e or best(p, t) for i, (p, t, e) in enumerate(rows)}
    assert intervals.with_stay_ids(exams.drop("EVTID"), table).columns == ["n", "PATID", "DATEXAM", "EVTID"]
    assert intervals.with_stay_ids(exams, table.limit(0)).where("EVTID IS NOT NULL").count() == 1 and intervals.with_stay_ids(exams.limit(0), table).count() == 0


def test_digits_with_the_day_first(spark):
    cases = {"01022024": datetime(2024, 2, 1), "31122023 0915": datetime(2023, 12, 31, 9, 15), "20240102": datetime(2024, 1, 2), "32012024": None, "2024-01-02": datetime(2024, 1, 2), "19121912": datetime(1912, 12, 19)}
    df = spark.createDataFrame([(x,) for x in cases], "raw string")
    got = {r.raw: (r.a, r.b) for r in df.select("raw", parse_wall_clock(F.col("raw"), day_first_digits=True).alias("a"), parse_wall_clock(F.col("raw")).alias("b")).collect()}
    assert {k: a for k, (a, _) in got.items()} == cases and got["01022024"][1] is None
