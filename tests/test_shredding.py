import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webstrata.operators import shredding as S

NESTED = pa.struct([("k", pa.string()), ("xs", pa.list_(pa.struct([("v", pa.string()), ("ys", pa.list_(pa.string()))])))])
text = st.one_of(st.none(), st.sampled_from(["a", "b", ""]))
item = st.one_of(st.none(), st.fixed_dictionaries({"v": text, "ys": st.one_of(st.none(), st.lists(text, max_size=3))}))
record = st.one_of(st.none(), st.fixed_dictionaries({"k": text, "xs": st.one_of(st.none(), st.lists(item, max_size=3))}))


@settings(max_examples=150, deadline=None)
@given(st.lists(record, max_size=5))
def test_levels_rebuild_children(records):
    column = pa.array(records, NESTED)
    got = []
    x = S.shred_column(column, ["xs", "ys"])
    outer, inner = x.place(1), x.place(2)
    for i in range(len(x.row)):
        if x.present()[i]:
            got.append((int(x.row[i]), int(outer[i]), int(inner[i]), x.values[i].as_py()))
    want = [
        (r, i, j, y)
        for r, rec in enumerate(records)
        for i, it in enumerate((rec or {}).get("xs") or [], 1)
        for j, y in enumerate((it or {}).get("ys") or [], 1)
        if y is not None
    ]
    assert got == want


@settings(max_examples=80, deadline=None)
@given(st.lists(record, max_size=5))
def test_every_record_has_an_entry(records):
    x = S.shred_column(pa.array(records, NESTED), ["xs", "v"])
    assert sorted(set(x.row.tolist())) == list(range(len(records)))
    assert all(d <= x.max_def for d in x.definition)


def test_app_bodies():
    assert S.parse_app_body('{"1": {"data": {"dlc": [5, "6", null, 1.50]}}, "2": {"data": []}, "3": null}') == [
        {"app": "1", "dlc": ["5", "6", None, "1.50"]},
        {"app": "2", "dlc": None},
        {"app": "3", "dlc": None},
    ]
    assert [S.parse_app_body(x) for x in (None, "", "[1]", '{"a": NaN}', '{"a"')] == [None] * 5


def test_author_names(spark):
    rows = [("Smith J, Doe K.",), (" A B ; C D Jr; et al.",), ("",), (None,), ("One X",), ("A,,B",)]
    got = spark.createDataFrame(rows, "s STRING").select(S.author_names(F.col("s"))).collect()
    assert [r[0] for r in got] == [["Smith J", "Doe K"], ["A B", "C D Jr", None], [None], None, ["One X"], ["A", None, "B"]]


SCHEMAS = {
    "crossref": "response_id LONG, message STRUCT<DOI: STRING, license: ARRAY<STRUCT<URL: STRING>>>, child STRING, item STRING",
    "europepmc": "response_id LONG, resultList STRUCT<result: ARRAY<STRUCT<id: STRING, authorString: STRING>>>, child STRING",
    "appdetails": "response_id LONG, body STRING, apps STRING",
}


def test_linked_children(spark):
    crossref = spark.createDataFrame([(1, ("d", [("u",), None, (None,), ("w",)]), "x", "y")] * 2 + [(2, None, None, None), (None, (None, [("z",)]), None, None)], SCHEMAS["crossref"])
    europepmc = spark.createDataFrame([(5, ([("i", "A B, C."), None, ("j", None)],), None), (6, None, None)], SCHEMAS["europepmc"])
    apps = spark.createDataFrame([(9, json.dumps({"7": {"data": {"dlc": [1, None, 2]}}}), None), (10, None, None)], SCHEMAS["appdetails"])
    got = sorted((tuple(r) for r in S.linked_children(crossref, europepmc, apps).collect()), key=str)
    want = [
        ("author", 5, "i", 1, "A B"), ("author", 5, "i", 2, "C"), ("dlc", 9, "7", 1, "1"), ("dlc", 9, "7", 3, "2"),
        ("license", 1, "d", 1, "u"), ("license", 1, "d", 4, "w"), ("license", None, None, 1, "z"),
    ]
    assert got == sorted(want, key=str)
    empty = [spark.createDataFrame([], s) for s in SCHEMAS.values()]
    assert S.linked_children(*empty).count() == 0
