"""Results of listening tests, against the same told in plain Python."""

import json
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cadenza.operators import listening
from cadenza.sources import json_docs

QUESTIONS = [("s", "quality", "scale", 0), ("s", "noise", "scale", 1), ("s", "problems", "tags", 2), ("s", "best", "pick", 3)]
KEY = [("s", t, c, v) for t, row in {"t1": "xyz", "t2": "yxz", "t3": "zxw"}.items() for c, v in zip("ABC", row, strict=True)]
ANSWERS = [
    ("me", "t1", "A", {"quality": 4, "noise": 2.5, "problems": ["hum", "click"], "notes": " \t dull "}),
    ("me", "t1", "B", {"quality": "4", "problems": [], "notes": "   "}),
    ("me", "t1", "D", {"quality": 1}),
    ("me", "t2", "A", {"quality": 2, "problems": ["hum"], "notes": "fine, \nreally"}),
    ("me", "t2", "B", {"quality": 1, "problems": ["click", "hum", "hum"], "other": {"a": [1]}}),
    ("me", "t2", "C", {}),
    ("me", "t2", "", {"best": "B", "quality": 5}),
    ("me", "t3", "", {"best": "C"}),
    ("me", "t1", "", {"best": "Q"}),
    ("you", "t1", "B", {"quality": None, "noise": True, "notes": 7}),
    ("you", "t3", "A", {"noise": 3}),
    ("you", "t9", "A", {"noise": 3}),
]


def plain():
    key = {(t, c): v for _, t, c, v in KEY}
    found = defaultdict(lambda: {"n": 0, "picks": 0, "scores": defaultdict(list), "tags": Counter()})
    for who, t, c, a in ANSWERS:
        if c == "":
            if isinstance(a.get("best"), str) and (t, a["best"]) in key:
                found[who, key[t, a["best"]]]["picks"] += 1
        elif (t, c) in key:
            stat = found[who, key[t, c]]
            stat["n"] += 1
            for q in ("quality", "noise"):
                if isinstance(a.get(q), (int, float)) and not isinstance(a.get(q), bool):
                    stat["scores"][q].append(a[q])
            stat["tags"].update(a.get("problems", []))
    mean = lambda v: {q: sum(x) / len(x) for q, x in v["scores"].items()}
    rows = {k: (v["n"], v["picks"], mean(v), sorted(v["tags"].items(), key=lambda p: (-p[1], p[0]))) for k, v in found.items()}
    order = sorted(rows, key=lambda k: (k[0], rows[k][2].get("quality", float("inf")), k[1]))
    places, seen = {}, Counter()
    for k in order:
        seen[k[0]] += 1
        places[k] = seen[k[0]]
    return {k: (places[k], *rows[k]) for k in rows}


def frames(spark, answers=ANSWERS):
    docs = spark.createDataFrame([("s", who, t, c, json.dumps(a)) for who, t, c, a in answers], "session string, listener string, trial string, clip string, j string")
    return (
        docs.select("session", "listener", "trial", "clip", F.parse_json("j").alias("answers")), spark.createDataFrame(KEY, "session string, trial string, label string, variant string"),
        spark.createDataFrame(QUESTIONS, "session string, question string, kind string, ord int"),
    )


def told(frame):
    return {(r.listener, r.variant): (r.place, r.n, r.picks, r.means or {}, [(t.tag, t.n) for t in r.tags]) for r in frame.collect()}


def test_results(spark):
    assert told(listening.variant_results(*frames(spark))) == plain()
    lines = {(r.listener, r.variant): r.line for r in listening.variant_results(*frames(spark)).select("*", listening.tag_line(F.col("tags")).alias("line")).collect()}
    assert lines["me", "x"] == "hum×3, click×2" and lines["you", "y"] == ""


def test_results_of_nothing(spark):
    answers, key, questions = frames(spark)
    assert listening.variant_results(answers.limit(0), key, questions).count() == 0
    assert listening.variant_results(answers, key.limit(0), questions).count() == 0
    bare = listening.variant_results(answers, key, questions.limit(0))  # clips are counted without any question
    assert {k: v[1:] for k, v in told(bare).items()} == {k: (v[1], 0, {}, []) for k, v in plain().items() if v[1]}
    assert listening.variant_notes(answers.limit(0), key).count() == 0


def test_repeated_and_null_rows(spark):
    twice = [*ANSWERS, *ANSWERS]
    once, both = told(listening.variant_results(*frames(spark))), told(listening.variant_results(*frames(spark, twice)))
    assert {k: (v[0], 2 * v[1], 2 * v[2], v[3], [(t, 2 * n) for t, n in v[4]]) for k, v in once.items()} == both
    answers, key, questions = frames(spark)
    nulls = answers.unionByName(answers.where("clip = 'A'").withColumn("answers", F.parse_json(F.lit("null")))).unionByName(answers.limit(1).withColumn("trial", F.lit(None).cast("string")))
    more = told(listening.variant_results(nulls, key, questions))
    assert more["me", "x"][1] == once["me", "x"][1] + 1 and more["me", "x"][2:] == once["me", "x"][2:]


def test_notes(spark):
    answers, key, _ = frames(spark)
    notes = {(r.listener, r.variant, r.trial, r.clip, r.note) for r in listening.variant_notes(answers, key).collect()}
    assert notes == {("me", "x", "t1", "A", "dull"), ("me", "y", "t2", "A", "fine, \nreally")}


def test_from_files(spark, tmp_path):
    folder = tmp_path / "s"
    folder.mkdir()
    kinds = [{"id": q, "kind": k, "label": q} for _, q, k, _ in QUESTIONS]
    (folder / "session.json").write_text(json.dumps({"name": "S", "trials": [], "clipQuestions": kinds[:3], "trialQuestions": kinds[3:]}))
    clips = defaultdict(dict)
    for _, t, c, v in KEY:
        clips[t][c] = v
    (folder / "key.json").write_text(json.dumps({"name": "S", "clips": clips, "windows": {}, "variants": {}}))
    for who in ("me", "you"):
        trials = defaultdict(lambda: {"clips": {}, "trial": {}})
        for _, t, c, a in (row for row in ANSWERS if row[0] == who):
            if c:
                trials[t]["clips"][c] = a
            else:
                trials[t]["trial"] = a
        (folder / f"results.{who}.json").write_text(json.dumps({"session": "S", "listener": who, "trials": trials}))
    (folder / "results.bad.json").write_text("{")
    read = json_docs.answer_documents(spark, str(tmp_path)), json_docs.key_rows(spark, str(tmp_path)), json_docs.question_rows(spark, str(tmp_path))
    assert told(listening.variant_results(*read)) == plain()
