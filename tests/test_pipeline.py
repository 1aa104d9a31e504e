import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parolumi.functions import text as X
from parolumi.operators import labels as L, providers as P, sampling as S, segmenting as G
from parolumi.sources import files, sinks
from parolumi.streaming import sessions as SS


def tokens(spark, rows):
    return spark.createDataFrame([("v", i, *r) for i, r in enumerate(rows)], "stream string, pos int, text string, start_s double, end_s double, speaker string")


ROWS = [
    ("Բարև", 0.0, 0.5, "a"), ("ձեզ։", 0.6, 1.0, "a"), ("Այո", 1.1, 1.3, "a"), ("ոչ", 2.1, 2.2, "a"), ("հա", 2.99, 3.1, "a"), ("դե", 3.2, 3.3, "b"), ("լավ", None, None, "b"), ("…", None, 4.0, "b"), ("վերջ", 9.0, 9.1, None),
]
WANT = [("Բարև ձեզ։", 2), ("Այո", 1), ("ոչ հա", 2), ("դե լավ…", 3), ("վերջ", 1)]


def test_segments(spark):
    got = G.segments(tokens(spark, ROWS), ["stream"], "pos").orderBy("segment").collect()
    assert [(r.text, r.n_words) for r in got] == WANT
    assert [r.start_s for r in got] == [0.0, 1.1, 2.1, 3.2, 9.0] and sum(r.n_words for r in got) == len(ROWS)
    assert G.segments(tokens(spark, []), ["stream"], "pos").count() == 0


def test_stream_segments_equal_batch(spark, tmp_path):
    t = tokens(spark, ROWS).withColumn("ts", (F.lit(1_700_000_000) + F.col("pos")).cast("timestamp"))
    end = spark.createDataFrame([("end", 0, "x.", 0.0, 0.1, "a")], "stream string, pos int, text string, start_s double, end_s double, speaker string").withColumn("ts", F.lit(1_900_000_000).cast("timestamp"))
    for i, part in enumerate((t.where("pos < 4"), t.where("pos >= 4"), end)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    SS.drain(SS.stream_segments(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).where("stream = 'v'").orderBy("segment").collect()
    assert [(r.text, r.n_words) for r in got] == WANT


def test_speaker_runs(spark):
    rows = [(0, " ", "spacing", None), (1, "Ա", "word", "speaker_0"), (2, " ", "spacing", None), (3, "բ", "word", "speaker_0"), (4, "!", "audio_event", None), (5, "գ", "word", "speaker_1"), (6, "դ", "word", None)]
    df = spark.createDataFrame([("f", *r) for r in rows], "f string, pos int, text string, type string, speaker_id string")
    got = G.speaker_runs(df, ["f"], "pos").orderBy("run").collect()
    assert [(r.speaker, r.text) for r in got] == [("Speaker 1", "Ա բ!"), ("Speaker 2", "գ"), ("Speaker 1", "դ")]


@pytest.mark.parametrize("d,s,m,want", [(100, [25, 29, 61], 30, [29, 59, 61, 91]), (10, [], 30, []), (65, [], 30, [30, 60]), (31, [30.00049], 30, [30.0])])
def test_cut_points(d, s, m, want):
    assert G.cut_points(d, s, m) == want


def test_memo_and_upsert(spark):
    asked = spark.createDataFrame([("t", "m", "1"), ("t", "m", "2"), ("t", "n", "1"), ("t", "m", "2")], "task string, model string, key string")
    cache = spark.createDataFrame([("t", "m", "1", "old")], P.CACHE_SCHEMA)
    seen = []
    answers, fresh = P.memoised(asked, cache, lambda q: seen.append(q.count()) or q.withColumn("value", F.lit("new")))
    assert seen == [2] and {(r.model, r.key): r.value for r in answers.collect()} == {("m", "1"): "old", ("m", "2"): "new", ("n", "1"): "new"}
    new = spark.createDataFrame([("a", 9)], "k string, v int")
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, P.upsert(old, new, ["k"]).collect())) == [("a", 9), ("b", 2)]


class Flaky:
    name = "flaky"

    def __call__(self, prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return prompt.upper()


def test_calls_become_rows(spark):
    q = spark.createDataFrame([("t", "1", "good"), ("t", "2", "bad")], "task string, key string, prompt string")
    got = {r.key: (r.value, r.error) for r in P.call(q, Flaky(), P.Retry(tries=2, pause=0.0)).collect()}
    assert got == {"1": ("GOOD", None), "2": (None, "no")}
    assert [p.name for p in P.healthy([P.Echo(), Flaky()], "bad")] == ["echo"]


class Busy:
    """Fails with the status in the prompt."""

    name = "busy"

    def __call__(self, prompt):
        e = RuntimeError("status " + prompt)
        e.status = int(prompt)
        raise e


def test_only_passing_failures_are_tried_again(spark):
    q = spark.createDataFrame([("t", s, s) for s in ("400", "408", "429", "503")], "task string, key string, prompt string")
    retry = P.Retry(tries=3, pause=0.0, doubling=True, statuses=P.passing_status)
    assert {r.key: r.calls for r in P.call(q, Busy(), retry).collect()} == {"400": 1, "408": 3, "429": 3, "503": 3}
    assert [P.HTTP_RETRY.wait(i) for i in range(3)] == [1.0, 2.0, 4.0] and [P.Retry().wait(i) for i in range(3)] == [1.5, 3.0, 4.5]


def test_rescue_joins_pieces(spark):
    done = spark.createDataFrame([("a", None, "ok"), ("b", "loop", ""), ("c", "empty", "")], "k string, reason string, text string")
    pieces = spark.createDataFrame([("b", 2, "two"), ("b", 1, " one "), ("b", 3, None), ("a", 1, "no"), ("c", 1, " ")], "k string, i int, text string")
    got = {r.k: (r.text, r.reason, r.rescued) for r in P.rescued(done, pieces, ["k"], ["i"], "reason", "text").collect()}
    assert got == {"a": ("ok", None, False), "b": ("one two", None, True), "c": ("", "empty", False)}
    tries = spark.createDataFrame([("a", 1, 1, "loop", "x"), ("a", 1, 2, None, "y"), ("a", 2, 1, None, "z")], "k string, rung int, n int, reason string, text string")
    assert tuple(P.ladder(tries, ["k"], ["rung", "n"], "reason", "text").first()) == ("a", 1, 2, "y", None)


def test_content_of_replies(spark):
    say = lambda c: json.dumps({"choices": [{"message": {"content": c}}]}, ensure_ascii=False)
    rows = [("s", say(" [բարև] ")), ("p", say([{"type": "text", "text": "a"}, {"type": "x"}, "loose", {"text": "b"}])), ("n", say(None)), ("e", "{}"), ("b", "{broken"), ("0", None)]
    df = spark.createDataFrame(rows, "k string, j string")
    assert {r.k: r.t for r in df.select("k", P.content_text(F.col("j")).alias("t")).collect()} == {"s": "[բարև]", "p": "ab", "n": "", "e": "", "b": None, "0": None}


def test_names_and_records(spark):
    df = spark.createDataFrame([("songs__a__b",), ("plain",), (None,)], "s string")
    assert [tuple(r) for r in df.select(*[c.alias(n) for c, n in zip(X.clip_name(F.col("s")), "ab")]).collect()] == [("songs", "a__b"), (None, None), (None, None)]
    one = spark.createDataFrame([(1, 2, None, 4)], "a int, b int, c int, d int")
    assert one.select(*X.splat({"x": F.col("a"), "y": F.col("b")}, {"y": F.col("c"), "z": F.col("d")})).first().asDict() == {"x": 1, "y": 2, "z": 4}


def test_times_sidecars_silences_and_cache(spark, tmp_path):
    c = spark.createDataFrame([(1.0, None, 0.5)], "s double, e double, o double")
    assert tuple(G.shifted(c, "s", "e", "o").select("s", "e").first()) == (1.5, None)
    (tmp_path / "x.json").write_text('{"a": 1}')
    assert files.sidecars(spark, str(tmp_path / "*.json")).first().body == '{"a": 1}'
    log = spark.createDataFrame([("[x] silence_start: -0.5",), ("silence_end: 2.25 | silence_duration: 2.75",), ("frame=1",)], "value string")
    assert [tuple(r) for r in files.silences(log).collect()] == [(-0.5, None), (None, 2.25)]
    cache = str(tmp_path / "memo")
    for v in ("one", "two"):
        sinks.append_cache(spark.createDataFrame([("t", "m", v, v)], P.CACHE_SCHEMA), cache)
    assert sorted(r.value for r in spark.read.parquet(cache).collect()) == ["one", "two"]
    sinks.json_per_key(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int"), str(tmp_path / "by"), "k")
    assert sorted((r.k, r.v) for r in files.json_lines(spark, str(tmp_path / "by"), "k string, v int").collect()) == [("a", 1), ("b", 2), ("b", 3)]


def test_ladder_and_padding(spark):
    rows = [("c", 1, "loop", "x"), ("c", 2, None, "y"), ("d", 1, "loop", "z"), ("d", 2, "empty", "")]
    got = {r.k: (r.rung, r.text, r.reason) for r in P.ladder(spark.createDataFrame(rows, "k string, rung int, reason string, text string"), ["k"], ["rung"], "reason", "text").collect()}
    assert got == {"c": (2, "y", None), "d": (None, "", "empty")}
    df = spark.createDataFrame([(["a"], 3), (["a", "b", "c"], 2), (None, 1)], "g array<string>, n int")
    assert [r[0] for r in df.select(P.padded(F.col("g"), F.col("n"))).collect()] == [["a", "", ""], ["a", "b"], [""]]
    assert P.gate_passed(0.4) and not P.gate_passed(0.22) and not P.gate_passed(None)


def test_samples_respect_caps(spark):
    rows = [(f"v{i % 7}", i, 0, f"f{i % 3}", ["A"] if i % 2 else ["A", "B"]) for i in range(200)]
    df = spark.createDataFrame(rows, "video_id string, seg_index int, word_index int, form string, strata array<string>")
    key = ["video_id", "seg_index", "word_index"]
    got = S.stratified(df, {"A": 16, "B": 5}, key, "form", "s").collect()
    assert len({(r.video_id, r.seg_index) for r in got}) == len(got) == 11
    for name, cap in (("A", 2), ("B", 2)):
        forms = [r.form for r in got if r.stratum == name]
        assert all(forms.count(f) <= cap for f in forms)
    # the plain scan: in seeded order, what is not taken and below its cap
    taken, want = set(), []
    digest = lambda name, r: hashlib.md5(f"s{name}::{r[0]}::{r[1]}::{r[2]}".encode()).hexdigest()
    for name, k in (("A", 16), ("B", 5)):
        seen, n = Counter(), 0
        for r in sorted((r for r in rows if name in r[4]), key=lambda r: (digest(name, r), r[:3])):
            if r[:3] not in taken and seen[r[3]] < max(2, k // 8) and n < k:
                seen[r[3]] += 1
                n += 1
                taken.add(r[:3])
                want.append((name, *r[:3]))
    assert [(r.stratum, r.video_id, r.seg_index, r.word_index) for r in sorted(got, key=lambda r: r.place)] == want
    assert [r.place for r in sorted(got, key=lambda r: r.place)] == list(range(len(got)))
    pool = spark.createDataFrame([(f"v{i % 9}", f"w{i}", "n", ["grammar", "other"][i % 2]) for i in range(90)], "video_id string, word string, note string, claim_type string")
    q = S.quota_sample(pool, ["video_id", "word", "note"], "claim_type", "video_id", {"grammar": 6, "other": 6}, 14, 2, "s").collect()
    videos = [r.video_id for r in q]
    assert len(q) == 14 and all(videos.count(v) <= 2 for v in videos)


def test_buckets_and_claims(spark):
    df = spark.createDataFrame([("ok", True, None, None, ""), ("WiFi", False, None, None, "разговорное"), ("ա", False, "B_polysemy", None, "2 л. ед. числа"), ("ա", False, None, "n", "сокращение"), ("ա", False, None, "", None)], "w string, m boolean, s string, n string, note string")
    got = df.select(L.failure_bucket(F.col("w"), F.col("m"), F.col("s"), F.col("n")), L.claim_type(F.col("note"))).collect()
    assert [r[0] for r in got] == ["ASR-propagated", "code-switch/NER", "wrong-sense (polysemy)", "colloquial/slang", "translation/other"]
    assert [r[1] for r in got] == ["other", "register", "grammar", "derivation", "other"]


def test_files(spark, tmp_path):
    d = tmp_path / "tr" / "some.model_2.1.basic" / "songs"
    d.mkdir(parents=True)
    (d / "a.b_12.txt").write_text("տեքստ", encoding="utf-8")
    r = files.transcript_tree(spark, str(tmp_path / "tr")).first()
    assert tuple(r) == ("some.model_2.1", "basic", "songs", "a.b_12", "տեքստ")
    assert files.directory_dimension(spark, str(tmp_path / "tr"), "*.txt", ["formal", "songs"]).first().folder == "songs"
    assert files.json_documents(spark, str(tmp_path / "none.json"), "a int", optional=True).count() == 0
    assert files.assigned('window.X = {"a": "x=y"}; var Y = [1, "b;"];') == '[1, "b;"]'
    assert files.assigned(None) is None and files.assigned("[1]") == "[1]"
    page = spark.createDataFrame([("const DATA=[{\"a\":1}];const KEY=2",)], "h string")
    assert page.select(files.embedded_json(F.col("h"), "const DATA=", ";const KEY")).first()[0] == '[{"a":1}]'
    (tmp_path / "l.json").write_text('{"labels": {"w1": {"v": "ok"}}}')
    (tmp_path / "b.json").write_text('{"w2": {"v": "bad"}}')
    assert tuple(files.envelope(spark, str(tmp_path / "l.json"), "labels", "struct<v:string>").first()) == ("w1", "ok")
    assert tuple(files.envelope(spark, str(tmp_path / "b.json"), "labels", "struct<v:string>").first()) == ("w2", "bad")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5, 0.4, 0.6), ("c", None, None, None)], "n string, v double, l double, h double")
    assert "a\\|b" in sinks.markdown(df, "T") and "| c | - | - | - |" in sinks.markdown(df)
    assert sinks.bar_chart(df, "n", "v", "l", "h").count("<rect") == 1
    sinks.document(df, str(tmp_path / "d.json"))
    done = spark.createDataFrame([("a", "x"), ("b", "")], "k string, text string")
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert sorted(r.k for r in sinks.missing_only(todo, done, ["k"]).collect()) == ["b", "c"]
