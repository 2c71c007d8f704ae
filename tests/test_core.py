"""Worked examples, slow forms and invariants of the library's own operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions import vectors as V
from parlance.operators import chunks, intervals, matching, metrics, ordering, registry, rerun, search, transcripts, upkeep
from parlance.sources import files
from parlance.streaming import fold, machines


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", expression(F.col("x")).alias("y"))
    return [r["y"] for r in rows.orderBy("i").collect()]


# text


def test_clean(spark):
    cases = {
        ".": None, "...": None, "。": None, "—": None, "Yes": "Yes", "No.": "No.", "好": "好", "да": "да", "3": "3", "you": None, "Thank you.": None, "[BLANK_AUDIO]": None, "THANK YOU!": None,
        "thank you for sending those numbers over": "thank you for sending those numbers over", " ".join(["we agreed"] * 6): None,
        "the the plan is to defer hiring until October": "the plan is to defer hiring until October", " ".join(["thank you"] * 3): None, None: None, "   ": None, "": None,
    }
    assert column(spark, cases, T.cleaned) == list(cases.values())


def test_kept_decodes(spark):
    """By start whatever the order of rows; the floor itself stays; inventions, loops, nulls and low confidence go."""
    rows = [
        (1, "mic", 900, 1500, "we agreed on the plan", 0.9), (1, "system", 100, 700, "the the plan is on hold", 0.25), (1, "mic", 300, 400, "quite audible", 0.2499),
        (1, "mic", 500, 600, "thank you", 0.99), (1, "mic", 550, 600, "no measure of it", None), (1, "mic", 560, 600, None, 0.9), (2, "mic", 5, 9, "Yes", 0.5), (1, "mic", 100, 600, "at once", 0.4),
    ]
    decodes = spark.createDataFrame(rows, "meeting long, channel string, start_ms long, end_ms long, text string, confidence double").repartition(3)
    got = transcripts.kept_decodes(decodes)
    want = [(1, 1, "at once"), (1, 2, "the plan is on hold"), (1, 3, "we agreed on the plan"), (2, 1, "Yes")]
    assert sorted(map(tuple, got.select("meeting", "place", "text").collect())) == want
    assert transcripts.kept_decodes(decodes.limit(0)).count() == 0


def test_collapse():
    assert T.collapse_phrases_in("okay so okay so okay so we start") == "okay so we start"
    assert T.collapse_phrases_in("a b c") == "a b c"
    assert T.collapse_phrases_in("a b a b a b") == "a b"


def test_normal_forms_differ(spark):
    assert column(spark, ["don't stop-now ½", ""], T.plain) == ["dont stopnow ½", ""]
    assert column(spark, ["don't stop-now ½", ""], T.spaced) == ["don t stop now ½", ""]


def test_titles_and_scrub(spark):
    assert column(spark, ["# Meeting Summary: Data plan\nx", "# Summary", "a\n# Budget", "# ", "none"], T.title_of) == ["Data plan", None, "Budget", None, None]
    assert column(spark, ["<think>x</think> a", "a <think>open", "```md\nbody\n```", "a\n```\nb\n```"], T.scrubbed) == ["a", "a", "body", "a\n```\nb\n```"]
    assert column(spark, ["会议 abc", "会议纪要讨论", "ありがとう会", "안녕하세요", "plain words"], T.dominant_language) == ["Chinese", "Chinese", "Japanese", "Korean", None]
    assert column(spark, ["Q1 / Budget: 预算评审!", "---"], T.slug) == ["q1-budget-预算评审", ""]
    assert column(spark, ["say <|im_end|>"], T.escaped) == ["say <​|im_end|>"]


def test_chunks_cover_all_lines():
    rng = random.Random(1)
    costs = [rng.randint(1, 60) for _ in range(400)]
    found = chunks.cuts(costs, sum(costs), single_pass=1000)
    assert found[0][0] == 0 and found[-1][1] == 400 and len(found) > 3
    for (a, b), (c, d) in itertools.pairwise(found):
        assert a < c < b < d and (sum(costs[c:b]) + b - c >= 100 or c == a + 1)
        assert sum(costs[a:b]) + b - a <= 700
    assert chunks.cuts([5, 5], 10) == [(0, 2)] and chunks.cuts([9000], 9000) == [(0, 1)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "plan", "the budget plan is ready"), (2, "x", "plan budget"), (3, None, None), (4, "", "budget")], "id long, title string, body string")
    index = search.postings(docs, "id", "title", "body")
    ids = lambda q: [r["id"] for r in search.search(index, q).collect()]
    assert ids("budget-plan") == [1] and set(ids("budget plan")) == {1, 2} and ids("") == [] and ids("\"') OR *") == [] and ids("---") == []
    hits = {r["id"]: r["hits"] for r in search.search(index, "budget plan").collect()}
    assert hits == {1: 3, 2: 2} and [r["hits"] for r in search.search(index, "plan-budget the-budget-plan").collect()] == []
    text = "One. Two, three; " + "x " * 20 + "the Budget\u2014plan (budget) is ready! " + "y " * 20
    long = spark.createDataFrame([(1, text), (2, "budget."), (3, None), (4, "nothing")], "id long, body string")
    found = {r["id"]: r["snippet"] for r in search.snippets(long, long.select("id"), "budget plan", field="body", width=4).collect()}
    assert found == {1: "…Budget\u2014plan (budget) is…", 2: "budget."}


# transcripts


def test_newest_hint_wins_and_machine_value_stays(spark):
    s = spark.createDataFrame([(1, 0, "mic", 0, 1, "a", 5, "voice"), (1, 1, "system", 1, 2, "b", None, None), (2, 0, "mic", 0, 1, "c", None, None)], "meeting long, sequence long, channel string, start_ms long, end_ms long, text string, speaker_id long, attribution string")
    h = spark.createDataFrame([("a", 1, 0, 7, 1), ("b", 1, 0, 8, 2), ("c", 1, 0, 9, 2)], "id string, meeting long, sequence long, speaker_id long, created_at long")
    people = spark.createDataFrame([(9, None, False), (5, "Ann", False)], "id long, display_name string, is_operator boolean")
    rows = transcripts.labelled(transcripts.effective(s, h), people).orderBy("meeting", "sequence").collect()
    assert [(r["who"], r["speaker_id"], r["how"], r["label"]) for r in rows] == [(9, 5, "operator", "Speaker 1"), (None, None, None, "Unattributed"), (None, None, None, "You")]


def test_resolve(spark):
    ids = spark.createDataFrame([("01ab-cd",), ("01ab-ce",), ("02",)], "id string")
    assert [r["id"] for r in registry.resolve(ids, "01AB-CD").collect()] == ["01ab-cd"]
    assert registry.resolve(ids, "01a").count() == 2 and registry.resolve(ids, "xyz").count() == 0 and registry.resolve(ids, "bce", anywhere=True).count() == 1


# intervals


def test_merge_gap_is_inclusive(spark):
    rows = spark.createDataFrame([(1, 0, 100), (1, 500, 600), (1, 1001, 1100), (1, 50, 60), (1, 7, 7)], "k int, start_ms long, end_ms long")
    assert sorted((r["start_ms"], r["end_ms"]) for r in intervals.merged(rows, "k").collect()) == [(0, 600), (1001, 1100)]


def test_midpoints(spark):
    turns = spark.createDataFrame([(1, "system", 0, 5000, "c0"), (1, "system", 5000, 10000, "c1")], "meeting long, channel string, start_ms long, end_ms long, cluster string")
    segments = spark.createDataFrame([(1, 0, "system", 1000, 2000), (1, 1, "system", 7000, 8000), (1, 2, "system", 4000, 6000), (1, 3, "mic", 0, 10), (1, 4, "system", 0, 0)], "meeting long, sequence long, channel string, start_ms long, end_ms long")
    got = {r["sequence"]: (r["cluster"], r["straddles"]) for r in intervals.reconciled(segments, turns).collect()}
    assert got == {0: ("c0", False), 1: ("c1", False), 2: ("c1", True), 3: (None, False), 4: ("c0", False)}


@pytest.mark.parametrize("width", [7, 50, 100_000])
def test_bucketed_joins_against_slow_form(spark, width):
    rng = random.Random(width)
    make = lambda n: [(i, rng.randint(1, 2), a := rng.randint(0, 300), a + rng.randint(0, 60)) for i in range(n)]
    a, b = make(60), make(60)
    frame = lambda rows: spark.createDataFrame(rows, "id long, meeting long, start_ms long, end_ms long")
    got = {r["id"] for r in intervals.touching(frame(a), frame(b), "meeting", width=width).collect()}
    assert got == {x[0] for x in a for y in b if x[1] == y[1] and y[3] > y[2] and x[2] < y[3] and x[3] > y[2]}
    left, right = ([(m, str(i % 3), s, e) for i, m, s, e in rows] for rows in (a, b))
    spans = lambda rows: spark.createDataFrame(rows, "meeting long, speaker string, start_ms long, end_ms long")
    found = {(r["meeting"], r["left_speaker"], r["right_speaker"]): r["ms"] for r in intervals.overlap(spans(left), spans(right), width=width).collect()}
    want = {}
    for m, p, q in itertools.product((1, 2), "012", "012"):
        ms = lambda rows, who: {t for mm, w, s, e in rows if mm == m and w == who for t in range(s, e)}
        if n := len(ms(left, p) & ms(right, q)):
            want[m, p, q] = n
    assert found == want


# voices


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in rows.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0, 1, 0, 0]
    blob = np.array([1.5, -2.0], "<f4").tobytes()
    assert spark.createDataFrame([(bytearray(blob),), (None,)], "b binary").select(V.from_bytes("b")).collect()[0][0] == [1.5, -2.0]
    assert list(V.resampled(np.arange(8.0), 8, 4)) == [0, 2, 4, 6]
    s = spark.createDataFrame([([0.5, -0.5] * 40,), ([],)], "s array<double>").select(V.sound("s").alias("y")).select("y.*").collect()
    assert s[0]["rms"] == 0.5 and s[0]["crossings"] == 1 and s[1]["peak"] == 0


def test_gates(spark):
    scores = lambda rows: spark.createDataFrame(rows, "meeting long, cluster long, speaker_id long, confirmed boolean, score double")
    won = lambda rows: {(r["cluster"], r["speaker_id"]) for r in matching.resolved(scores(rows)).collect()}
    assert won([(1, 0, 7, False, 0.9)]) == {(0, 7)}
    assert won([(1, 0, 7, False, 0.9), (1, 0, 8, False, 0.85)]) == set()
    assert won([(1, 0, 7, True, 0.9), (1, 0, 8, False, 0.85)]) == {(0, 7)}
    assert won([(1, 0, 7, True, 0.9), (1, 0, 8, True, 0.85)]) == set()
    assert won([(1, 0, 7, False, 0.6)]) == set()
    assert won([(1, 0, 7, False, 0.9), (1, 1, 7, False, 0.95)]) == {(1, 7)}


def test_cap_spreads_over_meetings(spark):
    rows = [(i, 1, 0 if i < 40 else 1 if i < 43 else None, [1.0], 1, False) for i in range(45)]
    frame = spark.createDataFrame(rows, "id long, speaker_id long, meeting long, vector array<double>, voiced_ms long, is_negative boolean")
    got = [r["id"] for r in matching.capped(frame).orderBy("turn").collect()]
    assert got[:6] == [44, 42, 39, 43, 41, 38] and len(got) == 32 and set(range(40, 45)) <= set(got)


def test_agglomeration_against_slow_form():
    rng = np.random.default_rng(4)
    for trial in range(12):
        v = rng.standard_normal((3, 8))[rng.integers(0, 3, 14)] + 0.3 * rng.standard_normal((14, 8))
        v /= np.sqrt((v * v).sum(1, keepdims=True))
        bars = {0: {1, 2}, 1: {0}, 2: {0}} if trial % 2 else {}
        groups = [([i], v[i], set(bars.get(i, ()))) for i in range(14)]
        while True:
            best = max(((float(a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1]))), -i, -j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2) if not (a[2] & set(b[0]) or b[2] & set(a[0]))), default=(-1, 0, 0))
            if best[0] < 0.6:
                break
            a, b = groups[-best[1]], groups[-best[2]]
            c = (a[1] * len(a[0]) + b[1] * len(b[0])) / (len(a[0]) + len(b[0]))
            groups[-best[1]] = (a[0] + b[0], c / np.sqrt(c @ c), a[2] | b[2])
            del groups[-best[2]]
        want = {i: min(g[0]) for g in groups for i in g[0]}
        assert matching.grouped_ids(list(range(14)), v, 0.6, bars) == want


def test_two_voices():
    rng = np.random.default_rng(1)
    a, b = np.eye(8)[0] + 0.1 * rng.standard_normal((6, 8)), np.eye(8)[1] + 0.1 * rng.standard_normal((3, 8))
    agreement, minority, total = matching.split_in_two(np.concatenate([a, b]), np.ones(9))
    assert agreement < 0.5 and (minority, total) == (3, 9)
    assert matching.split_in_two(a[:1], np.ones(1)) is None


# metrics


DER = {
    "relabelled": ([("alice", 0, 1000), ("bob", 1000, 2000)], [("1", 0, 1000), ("0", 1000, 2000)], (2000, 0, 0, 0)),
    "optimal": ([("alice", 0, 1100), ("bob", 2000, 2550)], [("X", 0, 600), ("X", 2000, 2550), ("Y", 600, 1100)], (1650, 0, 0, 600)),
    "overlap": ([("alice", 0, 1000), ("bob", 0, 1000)], [("0", 0, 1000)], (2000, 1000, 0, 0)),
    "nothing": ([("alice", 0, 1000)], [("0", 5, 5)], (1000, 1000, 0, 0)),
}


@pytest.mark.parametrize("name", DER)
def test_der(spark, name):
    ref, hyp, want = DER[name]
    frame = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "meeting long, speaker string, start_ms long, end_ms long")
    r = metrics.der(frame(ref), frame(hyp)).first()
    assert (r["total_ms"], r["missed_ms"], r["false_alarm_ms"], r["confusion_ms"]) == want


def test_mapping_is_optimal():
    rng = np.random.default_rng(0)
    for shape in ((3, 5), (5, 3), (4, 4), (1, 6)):
        m = rng.integers(0, 20, shape) * rng.integers(0, 2, shape)
        got = metrics.best_mapping(m)
        wide = m if shape[0] <= shape[1] else m.T
        best = max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert sum(m[p] for p in got) == best and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    big = np.zeros((19, 19), int)
    big[0, 0], big[0, 1], big[1, 0] = 5, 4, 4
    assert metrics.best_mapping(big) == [(0, 0)]


def test_equal_error_against_slow_form(spark):
    rng = random.Random(3)
    for rows in ([(0.9, True), (0.8, True), (0.2, False), (0.1, False)], [(round(rng.random(), 2) * 4 - 2, rng.random() < 0.5) for _ in range(200)], [(0.5, True)]):
        got = metrics.equal_error(spark.createDataFrame(rows, "score double, same boolean")).collect()
        p, n = sum(s for _, s in rows), sum(not s for _, s in rows)
        if not p or not n:
            assert got == []
            continue
        slow = []
        for t in sorted({s for s, _ in rows}):
            far, frr = sum(s >= t and not y for s, y in rows) / n, sum(s < t and y for s, y in rows) / p
            slow.append((abs(far - frr), t, (far + frr) / 2))
        assert (got[0]["threshold"], round(got[0]["rate"], 9)) == (min(slow)[1], round(min(slow)[2], 9))


def test_edits():
    assert metrics.edits("a b c d".split(), "a x c".split()) == (1, 1, 0)
    assert metrics.edits([], ["a"]) == (0, 0, 1) and metrics.edits(["a"], []) == (0, 1, 0)
    rng = random.Random(2)

    def slow(r, h):
        if not r or not h:
            return len(r) + len(h)
        return min(slow(r[1:], h[1:]) + (r[0] != h[0]), slow(r[1:], h) + 1, slow(r, h[1:]) + 1)

    for _ in range(60):
        r, h = (rng.choices("ab", k=rng.randint(0, 5)) for _ in range(2))
        s, d, i = metrics.edits(r, h)
        assert s + d + i == slow(r, h) and len(r) - d + i == len(h)


# files and machines


def test_rttm(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER f 1 12.340 2.500 <NA> <NA> MEE014 <NA> <NA>\nSPKR-INFO f 1 <NA>\nSPEAKER f 1 1 2\n")
    r = files.read_rttm(spark, str(tmp_path / "a.rttm")).collect()
    assert [(x["file"], x["speaker"], x["start_ms"], x["end_ms"]) for x in r] == [("f", "MEE014", 12340, 14840)]
    turns = spark.createDataFrame([(7, "A", 0, 1000), (7, "A", 1300, 2000)], "meeting long, speaker string, start_ms long, end_ms long")
    files.write_rttm(turns, str(tmp_path / "out"))
    assert [(x["start_ms"], x["end_ms"]) for x in files.read_rttm(spark, str(tmp_path / "out")).collect()] == [(0, 2000)]


def test_record_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert sorted(map(tuple, files.upserted(old, old.where("k = 2").withColumn("v", F.lit("c")), "k").collect())) == [(1, "a"), (2, "c")]
    rows = spark.createDataFrame([(1, 0, 5, "x"), (1, 1, 9, "y")], "meeting long, sequence long, start_ms long, text string")
    fresh = spark.createDataFrame([(1, 30, "q"), (1, 20, "p"), (2, 1, "z")], "meeting long, start_ms long, text string")
    assert sorted((r["meeting"], r["sequence"], r["text"]) for r in files.appended(rows, fresh).collect()) == [(1, 2, "p"), (1, 3, "q"), (2, 0, "z")]
    o = spark.createDataFrame([("mic", [[0, 5]], [[1, 4]], [0.5])], files.OBSERVATIONS)
    files.write_observations(o, str(tmp_path / "o"))
    assert files.read_observations(spark, str(tmp_path / "o")).collect() == o.collect()


def play(machine, events):
    out = []
    for e in events:
        out += machine.on(e)
    return out + machine.end()


def test_speech_chunks():
    frames = lambda *parts: [{"p": p} for p, n in parts for _ in range(n)]
    assert play(machines.SpeechChunks(), frames((0.0, 100), (0.9, 100), (0.0, 40))) == [(2700, 6600, False)]
    assert play(machines.SpeechChunks(), frames((0.9, 1000))) == [(0, 25_020, True), (25_020, 30_000, False)]
    assert play(machines.SpeechChunks(), frames((0.0, 50), (0.9, 2))) == []


def test_noise_floor():
    floor = machines.NoiseFloor()
    p = [floor.on({"at_ms": t, "rms": rms, "crossings": c})[0][1] for t, (rms, c) in enumerate([(0.001, 0.1), (0.2, 0.5), (0.2, 0.1), (0.013, 0.1), (0.0146, 0.1), (0.001, 0.9)])]
    # both floors begin at 0.006, so 0.013 is not sound, and 2.5 times the noise is
    assert p == [0.0, 0.2, 1.0, 0.0, 0.55, 0.0] and floor.floor < 0.006


def test_two_channels():
    f = lambda c, s, e: {"channel": c, "start_ms": s, "end_ms": e}
    rows = play(machines.TwoChannels(), [f("mic", 0, 100), f("system", 0, 500), f("mic", 300, 500)])
    assert rows[0][0] == 0 and rows[-1][1] == 500 and sum(r[2] for r in rows) == 300 and sum(r[3] for r in rows) == 500
    late = play(machines.TwoChannels(), [f("system", 0, 1000), f("mic", 0, 500), f("mic", 550, 650)])
    assert late[0] == (0, 600, 0, 600) and sum(r[2] for r in late) == 50
    freed = machines.TwoChannels()
    assert freed.on(f("mic", 0, 300)) == [] and freed.on({"channel": "system", "finished": True}) == [(0, 300, 300, 0)]


def test_policy():
    e = lambda at, kind, **more: {"at_ms": at, "kind": kind, "app_id": "app0", **more}
    ticks = [e(t, "Tick") for t in range(1000, 40_000, 1000)]
    short = [e(0, "MicHeld"), e(10_000, "MicReleased"), e(20_000, "MicHeld"), e(30_000, "MicReleased")]
    final = [e(60_000, "Tick")]
    assert play(machines.RecordingPolicy(), [*short, *final]) == [(0, "start", "app0"), (60_000, "stop", "app0")]
    mixed = sorted([*short, *ticks], key=lambda x: x["at_ms"])
    assert play(machines.RecordingPolicy(), [*mixed, *final])[0] == (0, "start", "app0")
    by_hand = [e(0, "MicHeld"), e(5, "ManualStop"), e(10, "Tick"), e(20, "MicReleased"), e(30, "MicHeld")]
    assert [x[:2] for x in play(machines.RecordingPolicy(), by_hand)] == [(0, "start"), (30, "start")]
    armed = [e(0, "CalendarEventStarted", event_id="m"), e(120_000, "Tick"), e(240_000, "Tick")]
    assert play(machines.RecordingPolicy(), armed) == [(0, "arm", "m"), (120_000, "never-started", "m")]
    polls = [{"at_ms": 0, "ids": ["a"]}, {"at_ms": 30, "ids": ["b"]}]
    assert play(machines.CalendarChanges(), polls) == [(0, "CalendarEventStarted", "a"), (30, "CalendarEventStarted", "b"), (30, "CalendarEventEnded", "a")]


def test_restarts():
    bad, good = {"at_ms": 0, "healthy": False}, {"at_ms": 0, "healthy": True}
    assert [x[1:] for x in play(machines.Restarts(), [bad, bad, good, bad, bad, bad, bad])] == [("restart", 1), ("restart", 2), ("restart", 1), ("restart", 2), ("restart", 4), ("end", 0)]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, i, rng.random(), i == 399) for k in (1, 2) for i in range(400)]
    schema = "meeting long, frame long, p double, last boolean"
    out = "meeting long, start_ms long, end_ms long, forced boolean"
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 100 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = fold.folded(spark.createDataFrame(rows, schema), ["meeting"], ["frame"], machines.SpeechChunks, out)
    files_in_order = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = fold.streamed(files_in_order, ["meeting"], ["frame"], machines.SpeechChunks, out).writeStream.format("memory").queryName("chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("chunks").collect())) == sorted(map(tuple, batch.collect())) != []


def test_summaries(spark):
    from parlance.operators import summaries

    said = spark.createDataFrame([(1, 0, "Ann", "I will prepare the quarterly numbers"), (1, 1, "Bob", "and I will call everyone tomorrow"), (1, 2, "Bob", "fine")], "meeting long, sequence long, speaker string, text string")
    table = "# T\n| Who | What | When | Said at |\n|---|---|---|---|\n| Ann | prepare quarterly numbers | | |\n| Bob | prepare quarterly numbers | | |\n| Eve | prepare numbers | | |\n| Bob | it is | | |"
    made = spark.createDataFrame([(1, table)], "meeting long, summary string")
    assert [r["verdict"] for r in summaries.checked(made, said).orderBy("line").collect()] == ["borne-out", "unattributed", "unknown-speaker", "empty"]
    empty = spark.createDataFrame([(1, "intro\n| Who | What | When | Said at |\n|---|---|---|---|\n| **Participant** | x | | |\nend")], "meeting long, summary string")
    r = summaries.without_placeholders(empty).first()
    assert (r["summary"], r["dropped"]) == ("intro\nNone noted.\nend", 1)
    copied = spark.createDataFrame([(1, "Prepare quarterly numbers.")], "meeting long, summary string")
    assert [r["sequence"] for r in summaries.quoted(copied, said).collect()] == [0]
    mixed = spark.createDataFrame([(1, "Prepare numbers, call everyone.")], "meeting long, summary string")
    assert summaries.quoted(mixed, said).count() == 0
    parts = spark.createDataFrame([(1, 0, "a"), (1, 1, "boom"), (1, 2, "c"), (2, 0, "boom")], "meeting long, chunk long, lines string")
    got = {r["meeting"]: (r["summary"], r["gaps"]) for r in summaries.mapped_and_reduced(parts, lambda t: {"a": "A", "c": "C"}[t], lambda t: t.replace("\n\n", "+")).collect()}
    assert got == {1: ("A+C", 1), 2: (None, 1)}


def test_filterbank():
    from parlance.functions import audio

    t = np.arange(16_000) / 16_000
    low, high = (audio.filterbank(np.sin(2 * np.pi * hz * t), centred=False) for hz in (300, 3000))
    assert low.shape == (98, 80) and low.mean(0).argmax() < high.mean(0).argmax()
    assert abs(audio.filterbank(np.sin(t * 999)).mean(0)).max() < 1e-9 and audio.filterbank(np.zeros(10)).shape == (0, 80)


def test_live(spark):
    from parlance.operators import live

    rows = spark.createDataFrame([([0.1, 0.9, 0.2],), ([0.5, 0.1, 0.1, 0.1, 0.5],), ([0.0] * 7 + [1.0],)], "s array<double>")
    assert [r[0] for r in rows.select(live.speakers_of(F.col("s"))).collect()] == [[0], [0, 1], []]
    seen = spark.createDataFrame([(1, "mic", 0, 0, 5, [[0, 1000], [1200, 2000]], [1.0, 0.0]), (1, "mic", 1, 1, 5, [[0, 500]], None), (1, "mic", 1, 2, 6, [[3000, 4000]], [0.0, 2.0])], "meeting long, channel string, window long, id long, voice long, runs array<array<long>>, vector array<double>")
    windows = spark.createDataFrame([(1, "mic", 0, 5000), (1, "mic", 0, 2500), (1, "mic", 0, 900)], "meeting long, channel string, start_ms long, end_ms long")
    turns, voices = live.assembled(seen, windows)
    assert sorted((r["cluster"], r["start_ms"], r["end_ms"]) for r in turns.collect()) == [(5, 0, 2000), (6, 3000, 4000)]
    assert {r["cluster"]: (r["vector"], r["voiced_ms"]) for r in voices.collect()} == {5: ([1.0, 0.0], 2000), 6: ([0.0, 1.0], 1000)}
    p = live.provisional(spark.createDataFrame([(1, 1, [[1.0, 3.0], [3.0, 5.0]]), (1, 2, [])], "meeting long, id long, frames array<array<double>>"))
    assert [(r["id"], r["vector"]) for r in p.collect()] == [(1, [2.0, 4.0])]


def test_replay(spark):
    from parlance.operators import live

    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(0, 0, 0, 1, a, 20.0), (0, 1, 0, 1, a, 20.0), (0, 1, 1, 2, b, 20.0), (0, 2, 0, 2, b, 5.0), (0, 2, 1, 3, a, 5.0), (0, 3, 0, 1, [0.0, 0.0, 1.0], 5.0)]
    got = live.replayed(spark.createDataFrame(rows, "series long, chapter long, cluster long, person long, vector array<double>, seconds double")).orderBy("chapter", "cluster").collect()
    assert [r["outcome"] for r in got] == ["correct-new", "correct", "correct-new", "correct", "false-attach", "abstain-enrolled"]


def test_rerun_accounts():
    from parlance.operators.rerun import Rerun, may_work, wanted

    r = Rerun("m", "1", total=5, remaining=5)
    r = r.finished(2).given_up()
    assert (r.done, r.remaining, r.abandoned, r.running) == (2, 2, 1, True)
    r = r.deleted()
    assert r.done + r.remaining + r.abandoned == r.total == 4
    assert not r.cancel().running and r.finished(9).remaining == 0 and r.given_up(9).abandoned == 2
    assert wanted(("a", "1"), ("a", "2")) and not wanted(None, ("a", "2")) and not may_work(True, False) and may_work(True, True)


def test_captions(spark, tmp_path):
    from parlance.streaming import captions

    c = lambda at: {"at_ms": at, "kind": "caption"}
    rows = play(captions.Subscriber(room=1), [c(0), c(1), c(2), {"at_ms": 3, "kind": "read"}, c(4)])
    assert rows == [(0, "caption", 1), (4, "missed", 2), (4, "caption", 1)]
    e = lambda at, text, language: {"at_ms": at, "text": text, "language": language}
    assert play(captions.Context(words=2), [e(0, "a b c", "en"), e(1, "d", "en"), e(2, "x", "zh"), e(3, "y", "zh")]) == [(0, "", False), (1, "b c", False), (2, "", True), (3, "x", False)]
    changes = spark.createDataFrame([(i % 130,) for i in range(300)], "meeting long")
    changes.write.parquet(str(tmp_path / "in"))
    sizes = []
    now, later = captions.subscribed(spark, str(tmp_path / "in"), changes.schema)
    query = captions.rebuilt_on_change(later, lambda part: sizes.append(part.count()), str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert now.count() == 300 and sizes == [64, 64, 2]


def test_means_take_every_vector(spark, monkeypatch):
    from parlance.plans import voices

    older = F.col("id") < 24_000
    rows = spark.range(48_000).select(
        "id", F.lit(7).cast("long").alias("speaker_id"), F.lit(1).cast("long").alias("meeting"), F.lit(False).alias("is_negative"),
        F.when(older, 3000).otherwise(1000).cast("long").alias("voiced_ms"), F.when(older, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("vector"),
    )
    odd = rows.limit(1).select(F.lit(-1).cast("long").alias("id"), "speaker_id", "meeting", "is_negative", "voiced_ms", F.array(F.lit(1.0)).alias("vector"))
    monkeypatch.setattr(voices.P, "exemplars", lambda spark, d: rows.unionByName(odd))
    (made,) = voices.gallery(spark, None).collect()
    assert [round(x, 6) for x in made["vector"]] == [0.316228, 0.948683]
    (made,) = voices.oracle_centroids(spark, None).collect()
    assert (made["n"], made["x0"]) == (48_001, 0.707107)  # G19 weighs all vectors alike


def test_places_without_one_task(spark):
    rows = [(None if i % 50 == 0 else 7 if i % 3 else i % 11, i) for i in range(600)]
    found = ordering.numbered(spark.createDataFrame(rows, "key int, id int").repartition(5), "place", "key", "id").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["key"], r["id"]) for r in sorted(found, key=lambda r: r["place"])] == want and sorted(r["place"] for r in found) == list(range(1, 601))
    assert ordering.numbered(spark.createDataFrame([], "key int, id int"), "place", "key", "id").count() == 0


def test_responsible_apps(spark):
    names = ["com.google.Chrome.helper.Renderer", "com.brave.Browser.helper", "COM.APPLE.webkit.GPU", "Teams.EXE", "us.zoom.zoomclips", "com.microsoft.teams2.helper", "org.plain", "a.helperX.helper"]
    got = column(spark, names, upkeep.responsible_app)
    assert got == ["com.google.Chrome", "com.brave.Browser", "com.apple.Safari", "com.microsoft.teams2", "us.zoom.xos", "com.microsoft.teams2", "org.plain", "a"]


def test_embeddable_windows(spark):
    rows = spark.createDataFrame([(0, 1_499), (0, 1_500), (100, 10_100), (0, 10_001), (1_000, 31_000)], "s long, e long")
    got = [r[0] and tuple(r[0]) for r in rows.select(V.embeddable_window(F.col("s"), F.col("e"))).collect()]
    assert got == [None, (0, 1_500), (100, 10_100), (0, 10_000), (11_000, 21_000)]


def test_outran(spark):
    meetings = spark.createDataFrame([(1, "/a", None), (2, "/a", "2026-01-01T12:00:00+02:00"), (3, None, None), (4, "/a", "2026-01-01T12:00:00+00:00"), (5, "/a", None)], "store int, audio_path string, diarized_at string")
    reruns = spark.createDataFrame([(i, "2026-01-01T11:00:00+00:00", i == 5) for i in range(1, 6)], "store int, started_at string, cancelled boolean")
    assert sorted(r["store"] for r in rerun.outran(meetings, reruns, "store").collect()) == [1, 2]


def test_der_by_running_sums(spark):
    rng = random.Random(3)
    spans = lambda: [(m, rng.choice("abc"), s, s + rng.randint(0, 30)) for m in (1, 2) for s in rng.sample(range(200), 12)]
    ref, hyp = spans(), spans()
    frames = [spark.createDataFrame(x, "meeting int, speaker string, start_ms long, end_ms long") for x in (ref, hyp)]
    got = {r["meeting"]: r for r in metrics.der(*frames).collect()}
    for m in (1, 2):
        at = lambda x, t: len({p for mm, p, s, e in x if mm == m and s <= t < e})  # noqa: B023, E731
        r, h = ([at(x, t) for t in range(240)] for x in (ref, hyp))
        assert got[m]["total_ms"] == sum(r) and got[m]["missed_ms"] == sum(max(a - b, 0) for a, b in zip(r, h, strict=True))
        assert got[m]["false_alarm_ms"] == sum(max(b - a, 0) for a, b in zip(r, h, strict=True))


def test_joins_and_claims(spark):
    people = spark.createDataFrame([(0, None, True), (1, None, False), (2, "Ann", False), (3, None, False), (4, None, True)], "id long, display_name string, is_operator boolean")
    asked = lambda *x: sorted(map(tuple, registry.allowed_joins(people, spark.createDataFrame(list(x), "source long, into long")).collect()))
    assert asked((1, 2), (1, 3), (2, 1), (0, 1), (3, 3), (3, 9), (0, 4)) == [(0, 4), (1, 2)]
    assert asked((1, 3), (3, 2)) == [(3, 2)] and asked() == []
    rows = spark.createDataFrame([(1, 1, 2, 3), (1, 1, 2, 3), (1, 2, 2, 2), (1, 3, 2, None), (1, 3, 9, None), (1, None, 2, 3), (1, 4, None, 3)], "meeting long, cluster long, owner long, replaced long")
    found = sorted(map(tuple, upkeep.claims(rows, people.select("id")).collect()))
    assert found == [(1, 1, 2, 3), (1, 2, 2, None), (1, 4, None, 3)]


def test_dirty_marks(spark):
    schema = "id long, title string, started_at string, ended_at string, detected_app string, audio_path string, mirror_filename string"
    before = spark.createDataFrame([(1, None, "a", None, None, None, "f"), (2, "t", "a", None, None, None, "f")], schema)
    after = spark.createDataFrame([(1, None, "a", None, None, None, "g"), (2, None, "a", None, None, None, "f"), (3, None, None, None, None, None, None)], schema)
    touched = upkeep.changed(before, after)
    assert sorted(r["meeting"] for r in touched.collect()) == [2, 3]
    dirty = spark.createDataFrame([(2, 5, 4), (7, 1, 1)], "meeting long, generation long, acknowledged long")
    assert sorted(map(tuple, upkeep.marked(dirty, touched).collect())) == [(2, 6, 4), (3, 1, 0), (7, 1, 1)]
