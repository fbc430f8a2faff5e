import random

from pyspark.sql import functions as F

from strandline.functions.ignore import ignored, parse_rules
from strandline.operators import rules as many
from strandline.operators.delta import readmitted, wanted
from strandline.operators.rules import with_verdict

NAMES = ["a", "b", "a.b", "x.tar.gz", "gz", ".gz", "é b", "c*", "?", "*.gz", "*.tar.gz", "*", "**", "a?b", "[x]", "*b*", "*."]


def made(seed, n):
    rng = random.Random(seed)
    lines = [rng.choice(["", "", "!"]) + rng.choice(["", "", "/", "**/"]) + "/".join(rng.choices(NAMES, k=rng.randrange(1, 4))) + rng.choice(["", "/"]) for _ in range(n)]
    plain = [x for x in NAMES if "*" not in x and "?" not in x] + ["cc", "a_b", "", "y."]
    return lines, [rng.choice(["", "", "./", "/", "\\"]) + "/".join(rng.choices(plain, k=rng.randrange(1, 5))) for _ in range(300)]


def test_look_ups_say_what_single_tests_say(spark, monkeypatch):
    for seed, n, chained in ((1, 3, 200), (2, 12, 200), (3, 40, 200), (4, 40, 0), (5, 0, 200)):
        monkeypatch.setattr(many, "CHAINED", chained)
        lines, paths = made(seed, n)
        rules = parse_rules("\n".join([*lines, "!", "/"] if n else []))
        rows = spark.createDataFrame([*((p, "x") for p in [*paths, paths[0]]), (None, "null")], "path string, kind string")
        for strict in (False, True):
            wanted_ = sorted((r["path"] or "", r["kind"], bool(r["v"])) for r in rows.withColumn("v", ignored(F.col("path"), rules, strict)).collect())
            got = with_verdict(rows, rules, strict)
            assert got.columns == ["path", "kind", "ignored"]
            assert sorted((r["path"] or "", r["kind"], r["ignored"]) for r in got.collect()) == wanted_


def test_change_sets_under_many_rules(spark, monkeypatch):
    lines, paths = made(6, 25)
    rules, before = parse_rules("\n".join(lines)), parse_rules("a\n*.gz\n")
    changes = spark.createDataFrame([(p, "AMD"[i % 3]) for i, p in enumerate(sorted(set(paths)))], "path string, status string")
    few = [sorted(map(tuple, df.collect())) for df in (wanted(changes, rules), readmitted(changes, before, rules))]
    monkeypatch.setattr(many, "MANY", 0)
    monkeypatch.setattr("strandline.operators.delta.MANY", 0)
    assert [sorted(map(tuple, df.collect())) for df in (wanted(changes, rules), readmitted(changes, before, rules))] == few


def test_the_plan_does_not_grow_with_the_rules(spark):
    rows = spark.createDataFrame([("d9999/x", 1), ("e/x", 2)], "path string, n int")
    sizes = []
    for n in (400, 10_000):
        found = with_verdict(rows, parse_rules("\n".join(f"/d{i}/" for i in range(n))))
        sizes.append(found._jdf.queryExecution().executedPlan().toString().count("\n"))
    assert sizes[0] == sizes[1]
    assert {r["path"]: r["ignored"] for r in found.collect()} == {"d9999/x": True, "e/x": False}
