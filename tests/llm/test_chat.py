from pyspark.sql import functions as F

from tracewarden.llm import chat


def brute(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        convs.setdefault(c, []).append((turn is not None, turn, role, text))
    lists = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1] or 0))] for c, v in convs.items()}
    kept = {}
    for c, own in lists.items():
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in lists.values())
        same = [d for d, o in lists.items() if o == own]
        if not longer and c == min(same, key=lambda d: (d is None, d or 0)):
            kept[c] = own
    return sorted(((c, k // chat.PART, len(o[k : k + chat.PART]), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in o[k : k + chat.PART])) for c, o in kept.items() for k in range(0, len(o), chat.PART)), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_snapshots_and_edges(spark):
    talk = [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", None), ("user", "")]
    rows = [(n, k, *talk[k]) for n in range(1, 6) for k in range(n)]
    rows += [(9, k + 100, *talk[k]) for k in range(5)]  # equal to 5 with other turn numbers
    rows += [(20, 0, "user", "hi"), (20, 1, "user", "yes"), (21, 0, "User", "hi"), (22, None, "system", "x"), (22, 0, "user", "hi"), (None, 0, "user", "lost"), (23, 0, None, ""), (24, 0, "", "")]
    rows += [(30, k, "user", f"t{k}" * (3000 if k == 7 else 1)) for k in range(300)] + [(31, k, "user", f"t{k}" * (3000 if k == 7 else 1)) for k in range(299)]
    rows += rows[:7]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("said", F.lit(1)).withColumn("place", F.lit("x")).withColumn("part", F.lit(0))
    assert got(chat.render(df)) == brute(rows)
    assert chat.render(df.where("false")).collect() == []


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert got(chat.render(df)) == brute(rows)


def test_no_python_in_plan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = chat.render(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
