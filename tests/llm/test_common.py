from skein.llm import common, simhash


def test_many_keys_are_told_apart_by_a_small_broadcast(spark):
    rows = spark.range(0, 2_000_000).selectExpr("id as k", "cast(id as string) as t")
    keys = spark.range(0, 1_000_000).selectExpr("id as k")
    maybe, others = common.apart(rows, keys, ["k"])
    assert maybe.columns == others.columns == ["k", "t"]
    n = others.count()
    assert maybe.count() + n == 2_000_000 and others.where("k < 1000000").isEmpty()
    assert n > 900_000
    cells = common.taken(keys, ["k"])
    assert cells.count() <= 512 and cells.selectExpr("max(length(__bits))").first()[0] == 4096


def test_apart_takes_null_keys_and_no_keys(spark):
    rows = spark.createDataFrame([(None, None), (1, "a"), (1, None), (2, "b")], "k long, t string")
    maybe, others = common.apart(rows, rows.where("k is null or t is null"), ["k", "t"])
    assert {tuple(r) for r in maybe.collect()} >= {(None, None), (1, None)} and maybe.count() + others.count() == 4
    maybe, others = common.apart(rows, rows.where("false"), ["k", "t"])
    assert maybe.isEmpty() and others.count() == 4


def test_probes_of_fingerprints_are_not_broadcast(spark):
    prints = spark.range(40_000).selectExpr("xxhash64(id) as fp")
    path = common.written(prints, "prints")  # 0.3 MB, of which 36 probes each are made
    found = simhash.links(path, [(0xFF << 8 * k, 1) for k in range(4)], 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
