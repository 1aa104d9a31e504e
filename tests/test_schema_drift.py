import json

from parolumi.operators import schema_drift
from parolumi.operators.schema_drift import Drift, leaves, likenesses, matched, outline, shape

SCHEMA = "file_id bigint, run_dir string, run_no int, body string, path string, kind string, n int"


def files(spark, runs, folder="r"):
    rows = []
    for no, docs in runs.items():
        for i, d in enumerate(docs):
            rows.append((no * 100 + i, folder, no, d if d is None or isinstance(d, str) else json.dumps(d, ensure_ascii=False), "clash", "clash", 1))
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return sorted((r.run_no, r.change, r.field_path, r.new_path) for r in Drift(df).changes().collect())


def chunk(**kw):
    return {"source": "a.b_1.mp4", "chunks": [dict(kw), dict(kw)]}


def test_leaves():
    doc = {"a": {"b": [1, None, {"c": "x"}]}, "e": [], "f": {}, "g": True}
    assert [(p, k) for p, k, _, _ in leaves(doc)] == [("a.b[]", "number"), ("a.b[]", None), ("a.b[].c", "string"), ("g", "boolean")]


def test_changes(spark):
    runs = {
        1: [chunk(index=i + 1, cost=0.01 + i / 1000) for i in range(5)],
        2: [chunk(index=i + 1, cost=str(0.01 + i / 1000)) for i in range(5)] + ["{broken", None, ""],
        3: [chunk(index=i + 1, price=str(0.011 + i / 1000), latency=3.5 + i) for i in range(6)],
        5: [chunk(price=0.012, latency=None, note="x") for _ in range(4)],
        6: [chunk(price=0.012, latency=2.0) if i else chunk(price=0.012, latency=2.0, stray=1) for i in range(4)],
    }
    assert found(files(spark, runs)) == [
        (2, "retyped", "chunks[].cost", ""),
        (3, "added", "chunks[].latency", ""),
        (3, "renamed", "chunks[].cost", "chunks[].price"),
        (5, "added", "chunks[].note", ""),
        (5, "removed", "chunks[].index", ""),
        (5, "retyped", "chunks[].price", ""),
        (6, "removed", "chunks[].note", ""),
    ]


def test_half_is_not_enough(spark):
    runs = {1: [{"a": 1}] * 4, 2: [{"a": 1, "b": 1}] * 2 + [{"a": 1}] * 2, 3: [{"a": None, "b": 1}] * 3 + [{"a": None}]}
    assert found(files(spark, runs)) == [(3, "added", "b", "")]


def test_repeated_files_and_nulls(spark):
    df = files(spark, {1: [{"a": 1}, {"b": 1}, {"b": 2}], 2: [{"b": 1}, {"b": 2}]})
    again = df.where("file_id = 100")
    odd = spark.createDataFrame([(None, "r", 1, "{}", "", "", 0), (9, None, 1, "{}", "", "", 0), (8, "r", None, '{"z":1}', "", "", 0), (7, "r", 1, None, "", "", 0)], SCHEMA)
    assert found(df.union(again).union(again).union(odd)) == []


def test_empty(spark):
    d = Drift(spark.createDataFrame([], SCHEMA))
    c = d.changes()
    assert c.count() == 0 and d.schema(c) == [] and d.table([]).count() == 0


def test_long_text(spark):
    runs = {1: [{"t": "շատ երկար " * 50_000, "i": 1}] * 2, 2: [{"t": "ուրիշ երկար " * 50_000, "j": "x"}] * 2}
    assert found(files(spark, runs)) == [(2, "added", "j", ""), (2, "removed", "i", "")]


def test_table(spark):
    runs = {1: [{"duration": 2.5, "ok": True, "c": [{"t": "a"}, {"t": "b"}]}] * 4, 2: [{"seconds": "3.5", "ok": 1, "c": [{"t": "c"}]}] * 3 + ["nope"]}
    df = files(spark, runs)
    d = Drift(df)
    schema = d.schema(d.changes())
    t = d.table(schema)
    assert {n: k for n, k, _ in schema} == {"duration": "string", "ok": "string", "c_t": "array<string>"} and t.count() == 7
    rows = {r.file_id: r for r in t.collect()}
    assert rows[100].duration == "2.5" and rows[100].ok == "true" and rows[100].c_t == ["a", "b"]
    assert rows[200].duration == "3.5" and rows[200].ok == "1"


def test_likeness_needs_like_values(spark):
    cells = {
        "old": [("v1", 1), ("sarme+", 1), ("otext armenian", 1)],
        "same": [("v1", 1), ("sarme+", 1), ("otext armenian", 1)],
        "word": [("v2", 1), ("slati", 1), ("olatin", 1)],
        "old_n": [("m+3", 2), ("m+4", 2), ("i", 4)],
        "new_n": [("m+4", 4), ("i", 3), ("f", 1)],
    }
    rows = [("r", 2, "", "removed" if p.startswith("old") else "added", p, 0.5, b, n) for p, found in cells.items() for b, n in found]
    df = spark.createDataFrame(rows, "run_dir string, run_no int, parent string, change string, path string, place double, bin string, n bigint")
    got = {(r.old, r.new): (r.likeness, r.numeric) for r in likenesses(df, ["run_dir", "run_no", "parent"]).collect()}
    # magnitudes: m+3 holds 3/8, m+4 3/8, m+2 and m+5 1/8 each on one side; 1/4, 1/2, 1/4 at m+3 to m+5 on the other
    assert got == {("old", "same"): (1.0, False), ("old_n", "new_n"): (round((1 / 4 + 3 / 8 + 1 / 8) * 3 / 4, 2), True)}
    assert shape("speaker_0") == "lati _ 9" and shape("մի երկու երեք։") == "arme+ ։"


def test_matching_takes_each_field_once(spark):
    rows = [("r", 2, "", a, b, s, False, x) for a, b, s, x in [("a", "x", 0.9, 0.5), ("a", "y", 0.9, 0.1), ("b", "y", 0.8, 0.0), ("b", "x", 0.6, 0.0), ("c", "z", 0.3, 0.0)]]
    df = spark.createDataFrame(rows, "run_dir string, run_no int, parent string, old string, new string, likeness double, numeric boolean, apart double")
    assert sorted((r.old, r.new) for r in matched(df, ["run_dir", "run_no", "parent"], 0.5, 0.35).collect()) == [("a", "y"), ("b", "x")]


def test_paths_without_a_column(spark):
    df = files(spark, {1: [{"a": 1, "b": {"c": "x", "d": [True, None]}}, {"a": 2}]})
    d = Drift(df)
    schema = d.schema(d.changes(), most_paths=1)
    rows = {r.file_id: r for r in d.table(schema).collect()}
    assert [n for n, _, _ in schema] == ["a", "other_fields"] and rows[101].other_fields is None
    assert rows[100].a == 1.0 and rows[100].other_fields == {"b.c": ["x"], "b.d[]": ["true", None]}


def test_patterns_of_whole_values():
    start = "բառ " * 50
    assert shape(start + "12:30") != shape(start)
    assert outline(start + "слово " * 100) == "text cyrillic" and outline(start) == "text armenian"


def test_only_a_bounded_table_goes_through_the_driver(spark, monkeypatch):
    plans, write = [], schema_drift.written

    def planned(df, label):
        plans.append((label, df._jdf.queryExecution().sparkPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(schema_drift, "written", planned)
    long = {r: {f"{r}{i}_{'x' * 1000}": f"v{i}" for i in range(20)} for r in "ab"}
    df = files(spark, {1: [long["a"]] * 2, 2: [long["b"]] * 2})
    for most, broadcast in ((1 << 20, ["value-cells"]), (20_000, [])):
        plans.clear()
        monkeypatch.setattr(schema_drift, "BROADCAST_BYTES", most, raising=False)
        got = Drift(df).changes()
        planned(got, "changes")
        assert [label for label, p in plans if "Broadcast" in p] == broadcast
        assert sorted((r.change, r.field_path, r.new_path) for r in got.collect()) == sorted(("renamed", f"a{i}_{'x' * 1000}", f"b{i}_{'x' * 1000}") for i in range(20))
