from pyspark.sql import functions as F

from corefold.operators import skew


def test_tree_aggregate_equals_plain_aggregation_on_a_hot_key(spark):
    df = spark.range(0, 50_000, 1, 40).select(F.when(F.col("id") % 3 > 0, F.lit(None).cast("long")).when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 100).alias("k"), "id", F.lit("x").alias("__other"))
    got = skew.tree_aggregate(df, ["k"], {"n": ("sum", F.lit(1)), "low": ("min", F.col("id")), "high": ("max", F.col("id"))}, fan_in=3, slots=20)
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_tree_aggregate_of_an_empty_table_and_null_values(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5)], "k int, v int")
    states = {"s": ("sum", F.col("v"))}
    assert skew.tree_aggregate(df.limit(0), ["k"], states).collect() == []
    assert sorted(map(tuple, skew.tree_aggregate(df, ["k"], states).collect())) == [(1, None), (2, 5)]


PAIRS = "pair_row long, conll_doc_id long, name string, pairs_labels int, pairs string, hit string"
MENTIONS = "mention_id long, conll_doc_id long, name string, mentions_pairs_length int, mentions string"


def names(spark, pairs, mentions, docs):
    return skew.name_results(spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(mentions, MENTIONS), spark.createDataFrame(docs, "conll_doc_id long, name string, pairs int"))


def test_names_with_repeats_nulls_and_clashing_columns(spark):
    pairs = [(1, 10, "a", 1, "", ""), (1, 10, "a", 1, "", ""), (2, 10, None, 1, "", ""), (3, 10, "a", None, "", ""), (4, 11, None, 0, "", ""), (None, 10, "a", 1, "", "")]
    mentions = [(5, 10, "a", 2, ""), (5, 10, "a", 2, ""), (6, 12, "c", None, ""), (None, 12, "c", 4, "")]
    got = names(spark, pairs, mentions, [(10, "a", 0), (10, "a", 0), (12, "c", 0)])
    assert got.columns == ["name", "pairs", "matches", "mentions", "pairs_length"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 3, 2, 1, 2), (None, 1, 0, 0, 0), ("c", 0, 0, 1, 0)], key=str)


def test_names_of_empty_tables(spark):
    got = names(spark, [], [], [])
    assert got.collect() == []
    assert skew.heavy_names(got).collect() == []


def test_heavy_names_include_ties_at_the_bound(spark):
    pairs = [(i, 1, "big", 0, "", "") for i in range(19)] + [(19, 2, "edge", 0, "", "")]
    assert sorted(r[0] for r in skew.heavy_names(names(spark, pairs, [], [])).collect()) == ["big", "edge"]


def test_no_task_merges_more_than_the_fan_in(spark):
    """The hot key's states after each round are at most the slots divided by the fan-in."""
    df = spark.range(0, 1000, 1, 64).withColumn("k", F.lit(1))
    plan = skew.tree_aggregate(df, ["k"], {"n": ("sum", F.lit(1))}, fan_in=4, slots=64)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 4  # slots 64 -> 16 -> 4 -> 1


def test_rows_of_names_are_merged_in_rounds(spark, monkeypatch):
    """Each tree of name_results has a round between the local combine and the last merge."""
    plain, added = skew.tree_aggregate, []
    aggregates = lambda df: df._jdf.queryExecution().analyzed().toString().count("Aggregate")

    def spy(df, *args, **kwargs):
        out = plain(df, *args, **kwargs)
        added.append(aggregates(out) - aggregates(df))
        return out

    monkeypatch.setattr(skew, "tree_aggregate", spy)
    names(spark, [(1, 10, "a", 1, "", "")], [(5, 10, "a", 2, "")], [(10, "a", 0)])
    assert added == [3, 3, 3]
