import random

from pyspark.sql import functions as F

from tidemark.operators import positions


def test_position_of_a_total_order(spark):
    keys = list(range(5000))
    random.Random(1).shuffle(keys)
    frame = spark.createDataFrame([(k, "hot" if k % 3 else str(k)) for k in keys], "k bigint, g string").repartition(7)
    placed = positions.with_position(frame, [F.col("k").desc()]).orderBy("pos").collect()
    assert [row["k"] for row in placed] == sorted(keys, reverse=True)
    assert [row["pos"] for row in placed] == list(range(1, 5001))
    grouped = positions.with_group_position(frame, ["g"], [F.col("k")]).where("g = 'hot'").orderBy("pos").collect()
    assert [row["k"] for row in grouped] == [k for k in sorted(keys) if k % 3]
    assert [row["pos"] for row in grouped] == list(range(1, len(grouped) + 1))


def test_carried_state_crosses_chunks(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else "cold", i, rng.random() < 0.05, rng.choice([None, None, i])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, pos bigint, flag boolean, v bigint").repartition(5)
    got = {(r["g"], r["pos"]): (r["seen"], r["last"]) for r in positions.carried(
        frame, ["g"], "pos", {"seen": ("any", F.col("flag")), "last": ("last", F.col("v"))}, chunk_rows=100).collect()}
    state = {}
    for g, pos, flag, value in rows:
        seen, last = state.get(g, (False, None))
        assert got[(g, pos)] == (seen, last), (g, pos)
        state[g] = (seen or flag, value if value is not None else last)


def test_first_wins_and_repeats(spark):
    frame = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z"), ("a", 5, "w")], "k string, pos bigint, v string")
    assert sorted(tuple(r) for r in positions.first_wins(frame, ["k"], "pos").select("k", "v").collect()) == [("a", "y"), ("b", "z")]
    assert sorted(r["pos"] for r in positions.repeated(frame, ["k"], "pos").collect()) == [2, 5]
