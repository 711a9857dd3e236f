"""What showed on larger tables and other values: the queries' SQL on tables of those values, and results whose rows lie in several parts."""

from __future__ import annotations

import json
from math import pi

import pyarrow.parquet as pq
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from larkspur.operators import geometry, line_diff, trees, word_places
from larkspur.plans import ORACLES, QUERIES
from larkspur.session import dealt


def _holds(spark, tmp_path, name: str, **tables) -> None:
    """A query on tables of a test's own is what its SQL gives on them."""
    for table, df in tables.items():
        pq.write_table(df.toArrow(), tmp_path / f"{table}.parquet")
    assert_same(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path))


def test_a_ring_that_crosses_itself_holds_what_it_winds_round(spark):
    twice = [(k, i, way * 2 * pi * i / 40, 5 + i / 80) for k, way in (("east", 1), ("west", -1)) for i in range(80)]
    df = spark.createDataFrame(twice, "k string, i int, t double, r double").select("k", "i", (10 + F.col("r") * F.cos("t")).alias("x"), (20 + F.col("r") * F.sin("t")).alias("y"))
    small = {r.k: r.area < 2 * pi for r in geometry.sphere_area(df, "k", "i").collect()}
    assert small["east"] != small["west"]
    for place, wound in (((10, 20), True), ((30, 20), False), ((190, -20), False)):
        got = {r.k: r.inside for r in geometry.sphere_contains(df, "k", "i", *place).collect()}
        assert got == {k: wound == s for k, s in small.items()}


def test_prices_near_ties_are_rounded_as_in_sql(spark, tmp_path):
    prices = [1015.0, 1035.0, 1225.0, 1255.0, 9995.0, 12350.0, 99950.0, 123500.0, 499500.0]
    _holds(spark, tmp_path, "number_format", orders=spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double"))


def test_balances_near_zero_are_written_as_in_sql(spark, tmp_path):
    balances = [-0.04, -0.01, 0.0, 0.29, 0.79, -0.5, -5.0, 0.05, -999.85, 9999.8]
    _holds(spark, tmp_path, "number_specs", customer=spark.createDataFrame(list(enumerate(balances)), "c_custkey long, c_acctbal double"))


def test_samples_of_a_counter_in_several_frames_keep_their_order(spark, tmp_path):
    ids = spark.range(0, 25_000, 1, 1).select(F.col("id").alias("event_id"), (F.col("id") * 7919 % 25_000).alias("k"))
    at = F.timestamp_micros(F.col("k") * 1_300_000).cast("timestamp_ntz")
    _holds(spark, tmp_path, "stream_rate", events=ids.select("event_id", at.alias("ts"), F.lit(1).cast("long").alias("user_id"), (F.col("k") * 37 % 101 / 4).alias("value")))


@pytest.mark.parametrize(("name", "shuffles"), [("tree_faults", 1), ("freemind_xml", 1), ("tree_node_array", 1), ("tree_indented_text", 1), ("tree_formats", 3)])
def test_trees_are_shuffled_once_for_each_format(spark, name, shuffles):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == shuffles and plan.count("Exchange") == shuffles


def test_shares_of_a_task_are_bounded(spark):
    dealt_rows = dealt(spark.range(10_000), "id", rows=500)
    assert dealt_rows.rdd.getNumPartitions() == 20 and dealt_rows.count() == 10_000


def test_frequent_words_do_not_meet_in_one_task(spark):
    docs = spark.range(2500).select(F.col("id").alias("k"), F.concat(F.lit("the w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("t"))
    index = word_places.postings(word_places.places(docs, "k", "t"), "k")
    assert "LeftOuter, BuildRight" in index._jdf.queryExecution().executedPlan().toString()
    blocks = {(r.word, r.block): r.n_texts for r in index.collect()}
    assert len([w for w, _ in blocks if w == "the"]) == 3 and sum(n for (w, _), n in blocks.items() if w == "the") == 2500 and len(blocks) == 2503


def test_words_of_many_texts_are_handed_on_together(spark):
    class Docs:
        """Stands for a table: keeps what each batch is turned into."""

        def __init__(self, df):
            self.df, self.schema = df, df.schema

        def select(self, *columns):
            return Docs(self.df.select(*columns))

        def mapInArrow(self, run, schema):  # noqa: N802
            return list(run(iter(self.df.toArrow().combine_chunks().to_batches())))

    docs = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("The a the "), F.repeat(F.lit("b "), (F.col("id") % 50).cast("int")))).alias("t"))
    made = word_places.places(Docs(docs.coalesce(1)), "id", "t")
    assert len(made) < 10 and sum(b.num_rows for b in made) == 3 * 2000 - 40
    assert all(b.num_rows for b in made)
    got = {(r["id"], r["word"]): (r["numbers"], r["starts"]) for b in made for r in b.to_pylist()}
    assert got[4, "the"] == ([0, 2], [0, 6]) and got[4, "b"] == ([3, 4, 5, 6], [10, 12, 14, 16]) and (3, "the") not in got
    assert {k for k, _ in got} == {k for k in range(3000) if k % 3}


def _steps(spark, name: str) -> tuple[int, bool]:
    """Shuffles of a query's plan, and whether it reads what was written in between."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), "ExistingRDD" in plan


def test_documents_are_rebuilt_in_one_shuffle(spark):
    assert _steps(spark, "json_flatten") == (0, False)
    assert _steps(spark, "json_rebuild") == (1, False)


def test_names_that_end_in_line_ends_and_many_values_of_a_document(spark):
    texts = ['{"k\\n":1,"k":{"\\n":[]}}', "[" + ",".join(map(str, range(120_000))) + "]", None, "{}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    flat = trees.flatten_json(docs, "k", "t")
    assert dict(flat.groupBy("k").count().collect()) == {0: 4, 1: 120_001, 3: 1}
    got = {r.k: json.loads(r.text) for r in trees.unflatten_json(flat, "k").collect()}
    assert got == {k: json.loads(t) for k, t in enumerate(texts) if t}


def test_documents_are_merged_in_one_join(spark):
    assert _steps(spark, "json_merge") == (2, False)


def test_scripts_are_made_where_the_two_texts_meet(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    script = line_diff.line_script(docs, docs.withColumn("text", F.concat("text", F.lit("\nmore"))), "doc_id", "text")
    plan = script._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "ExistingRDD" not in plan
    both = line_diff.replayed(docs, script, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert both.count("Exchange") == 4
