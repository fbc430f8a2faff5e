import pytest
from pyspark.sql import functions as F

from strandline.operators import reconcile
from strandline.operators.reconcile import differences


def sets(df):
    rows = df.collect()
    return {(r["path"], r["id"]) for r in rows if r["have"]}, {(r["path"], r["id"]) for r in rows if r["want"]}


def brute(spark, have, want, **options):
    made = [spark.createDataFrame(rows, "path string, id string") for rows in (have, want)]
    found = differences(*made, **options)
    assert found.count() == len(set(have) ^ set(want))
    assert sets(found) == (set(have) - set(want), set(want) - set(have))


@pytest.mark.parametrize("changed", [0, 1, 40, 3000])
def test_sketches_find_what_a_full_comparison_finds(spark, changed):
    same = [("hot" if i % 3 else f"p{i}", f"id{i}") for i in range(4000)]
    brute(spark, same[changed:], [*same, *(("new", f"n{i}") for i in range(changed))], levels=(16, 64))


def test_nulls_ties_and_empty_tables(spark):
    brute(spark, [], [])
    brute(spark, [(None, "a"), ("a", "b"), ("", "c")], [("a", None), ("a", "b"), (None, "c")], levels=(4,))
    # an odd and an even number of repetitions
    brute(spark, [("a", "b"), ("a", "b"), ("c", "d"), ("c", "d"), ("c", "d")], [("a", "b"), ("e", "f"), ("e", "f")], levels=(4,))


def test_what_shuffles_follows_the_differences(spark, monkeypatch):
    """One bucket is enough for 20 of 50,000 rows, and only these rows reach the last grouping."""
    rows = spark.range(50_000).select(F.concat(F.lit("p"), F.col("id") % 10).alias("path"), F.col("id").cast("string").alias("id"))
    found = differences(rows.where("cast(id as long) >= 20"), rows, levels=(1,))
    assert sets(found) == (set(), {(f"p{i % 10}", str(i)) for i in range(20)})
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(reconcile, "SENT_KEYS", 0)  # more keys than may be sent
    assert sets(differences(rows.where("cast(id as long) >= 20"), rows, levels=(1,)))[1] == {(f"p{i % 10}", str(i)) for i in range(20)}
