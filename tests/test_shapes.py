import pytest
from oracle import compare
from pyspark.sql import functions as F

from trajlake.functions import wire
from trajlake.operators import serving
from trajlake.plans.shapes import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_empty_and_null_inputs(spark):
    none = F.lit(None).cast("string")
    assert value(spark, wire.first_filled(none, F.lit(""))) == ""
    assert value(spark, wire.comma_list(none)) == []
    assert value(spark, wire.has_media(F.lit(None).cast("array<struct<type:string>>"))) is False
    assert [e["event"] for e in value(spark, wire.answer_chunks(F.lit(""), F.lit("stop")))] == ["role", "finish"]
    assert value(spark, wire.reward_payload(none, none, F.lit(None).cast("boolean"))) == '{"reward":null}'
    assert value(spark, wire.reward_payload(F.lit('a"b'), F.lit(1), F.lit(False))) == '{"reward":"a\\"b","acc":1,"finished":false}'
    assert value(spark, wire.control_fields(F.parse_json(F.lit('{"top_k":1,"stop_sequences":["a"],"x":2}')))) == '{"top_k":1,"stop":["a"]}'


def test_defaults_fill_missing_keys_only(spark):
    none = F.lit(None).cast("string")
    assert value(spark, wire.set_default(F.create_map(F.lit("a"), none), "a", F.lit("x"))) == {"a": None}
    assert value(spark, wire.set_default(F.create_map(F.lit("a"), none), "b", F.lit("x"))) == {"a": None, "b": "x"}


def test_unequal_lists_and_unknown_images_are_errors(spark):
    for bad in (wire.paired(F.array(F.lit("a")), F.array().cast("array<string>")), wire.provider_image(F.lit("q"), {"a/": "b/"}, {}, {})):
        with pytest.raises(Exception, match="lists differ|no image"):
            value(spark, bad)


def test_prompt_faults(spark):
    m = lambda *roles: F.array(*[F.struct(F.lit(r).alias("role"), F.lit("t").alias("content")) for r in roles])
    assert [value(spark, wire.prompt_fault(m(*r))) for r in (("system", "user"), ("system",), ("user",) * 3)] == [None, "no user message", "at most two messages"]


def test_overlay_and_usage(spark):
    got = value(spark, wire.overlay(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2"))))
    assert got == {"a": "1", "b": "2"}
    assert tuple(value(spark, wire.usage(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))))) == (2, 1, 3)


def test_registry_and_duplicates(spark):
    names = spark.createDataFrame([("a",), ("z",), (None,)], "name string")
    registry = spark.createDataFrame([("task", "a", "x"), ("agent", "a", "y")], "kind string, name string, target string")
    got = {r["name"]: (r["target"], r["error"]) for r in serving.resolve(names, registry, "task").collect()}
    assert got == {"a": ("x", None), "z": (None, "unknown task: z"), None: (None, "unknown task: null")}
    with pytest.raises(ValueError, match="duplicate"):
        serving.resolve(names, registry.union(registry), "task")


def test_scoring_input_and_override(spark):
    t = spark.createDataFrame([("s", [1], [2, 3], 2)], "session string, prompt_ids array<int>, response_ids array<int>, num_turns long")
    row = serving.scoring_input(t, ["session"]).first()
    assert (row["input_ids"], row["attention_mask"]) == ([1, 2, 3], [1, 1, 1])
    assert serving.override_scores(t, lambda d: d.groupBy("session").agg(F.max(F.size("response_ids")).alias("score")), ["session"]).first()["score"] == 2.0


def test_queue_status_and_key_order(spark):
    p = spark.createDataFrame([("u", 0), ("v", 2)], "uid string, success long")
    assert {r["uid"]: r["status"] for r in serving.queue_status(p).collect()} == {"u": "failure", "v": "finished"}
    k = spark.createDataFrame([("u", 2), ("u", 10)], "uid string, session long")
    assert [r["session"] for r in serving.sort_keys(k).collect()] == [10, 2]
