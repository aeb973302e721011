import pandas as pd
import pytest
from oracle import compare
from pyspark.sql import functions as F

from trajlake.functions import edits, schemas, tokens
from trajlake.operators import chains, hooks, routing
from trajlake.plans.editing import ORACLE_SQL, QUERIES
from trajlake.sources import io
from trajlake.streaming import sessions


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text", ["", "\t", "a\tb", "12345678\tx\n\t\ty", "ab\n", "1234567\t\t|"])
def test_tabs_end_at_stops(spark, text):
    assert value(spark, edits.expand_tabs(F.lit(text))) == text.expandtabs()


def test_views(spark):
    assert value(spark, edits.numbered_view(F.lit("a\n\tb"), first=9)) == "     9\ta\n    10\t        b"
    assert value(spark, edits.numbered_view(F.lit("abcd"), limit=2, notice="...")) == "     1\tab..."
    assert value(spark, edits.numbered_view(F.lit(None).cast("string"))) is None


def test_replacements(spark):
    one = lambda text, old, new: tuple(value(spark, edits.replace_unique(F.lit(text), F.lit(old).cast("string"), F.lit(new).cast("string"))))
    assert one("x\nabc", "b", None) == ("x\nac", 2, None)
    assert one("x", "", "y") == ("x", None, "old text is required") == one("x", None, "y")
    assert one("x", "q", "y")[2] == "old text not found"
    assert one("a\nb\na", "a", "y")[2] == "old text is in lines 1, 3"
    assert one("a", "a", "a")[2] == "old and new text are the same"
    assert one("a\tb", "\tb", "c") == ("a\tb", None, "old text not found")  # both sides are expanded on their own


def test_insertions(spark):
    put = lambda at, new="n": tuple(value(spark, edits.insert_lines(F.lit("a\nb"), F.lit(at).cast("int"), F.lit(new).cast("string"))))
    assert put(1) == ("n\na\nb", None) and put(3, "n\nm") == ("a\nb\nn\nm", None)
    assert put(4) == ("a\nb", "line must be in 1 to 3") == put(0)
    assert put(None)[1] == put(1, None)[1] == "a line and a text are required"


def test_replay_of_undos(spark):
    log = spark.createDataFrame([("p", 1, "undo", ""), ("p", 2, "edit", "a"), ("p", 3, "edit", "b"), ("p", 4, "undo", ""), ("q", 1, "edit", "c"), ("q", 2, "undo", "")], "path string, seq long, kind string, text string")
    assert [(r["path"], r["text"]) for r in edits.replay_edits(log).collect()] == [("p", "a")]


def test_schemas(spark):
    assert value(spark, schemas.normalize_schema(F.lit("no json"))) is None and value(spark, schemas.normalize_schema(F.lit(None).cast("string"))) is None
    deep = '{"title":"x","type":"array","items":' * 40 + "{}" + "}" * 40
    assert value(spark, schemas.normalize_schema(F.lit(deep))) == '{"type":"array","items":' * 40 + "{}" + "}" * 40


def test_generation_suffix(spark):
    suffix = lambda a, b: value(spark, tokens.generation_suffix(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert suffix([1, 2], [1, 2, 3]) == [3]
    with pytest.raises(Exception, match="template"):
        suffix([1], [2])


def test_hooks(spark):
    df = spark.createDataFrame([("call f",), ("bad",), (None,)], "t string")
    parse = lambda t: (t.split("call ")[0], [t.split("call ")[1]])
    assert [tuple(r["c"]) for r in df.select(hooks.tool_calls(F.col("t"), parse).alias("c")).collect()] == [("", ["f"]), ("bad", []), (None, [])]
    assert [r["c"]["content"] for r in df.select(hooks.tool_calls(F.col("t")).alias("c")).collect()] == ["call f", "bad", None]
    assert [r["n"] for r in df.select(hooks.token_count(F.col("t"), lambda: len).alias("n")).collect()] == [6, 3, 0]
    part = lambda kind, url: F.struct(F.lit(kind).alias("type"), F.lit(url).alias("url"))
    parts = F.array(part("image_url", "i"), part("text", "t"), part("video", "v"))
    assert tuple(value(spark, hooks.media(parts))) == (["i"], ["v"])
    assert tuple(value(spark, hooks.media(F.lit(None).cast("array<struct<type:string,url:string>>")))) == ([], [])
    own = lambda x: pd.DataFrame({"images": [["k"]] * len(x), "videos": [[]] * len(x)})
    assert tuple(value(spark, hooks.media(parts, own))) == (["k"], [])


def test_unknown_repository_and_unequal_columns_are_errors(spark):
    rows = spark.createDataFrame([("i", "r")], "instance_id string, repo string")
    known = spark.createDataFrame([("other", "go")], "repo string, extension string")
    bad = routing.multilingual_task_rows(rows, known, source="s", prompt=lambda p: p, metadata=["repo"])
    uneven = routing.unstack(spark.createDataFrame([([1], [1, 2])], "a array<int>, b array<int>"), ["a", "b"])
    for df in (bad, uneven):
        with pytest.raises(Exception, match="unknown repository|differ in length"):
            df.collect()


def test_splits_and_snapshots(spark, tmp_path):
    for name, x in (("test", 1), ("test-00001-of-2", 2), ("testing", 3), ("train", 4)):
        pd.DataFrame({"x": [x]}).to_parquet(tmp_path / f"{name}.parquet")
    assert sorted(r["x"] for r in io.read_split(spark, str(tmp_path), "test").collect()) == [1, 2]
    with pytest.raises(Exception):  # noqa: B017
        io.read_split(spark, str(tmp_path), "dev")
    io.write_snapshots(spark.createDataFrame([("s", None)], "session string, reward string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == '{"session":"s","reward":null}'


def test_rollback_counters(spark):
    names = [c.split()[0] for c in chains.EVENT_SCHEMA.split(", ")]
    say = lambda *texts: "[" + ", ".join(f'{{"role": "{r}", "content": "{t}"}}' for r, t in texts) + "]"
    turns = [("user", "u"), ("assistant", "abc"), ("user", "c"), ("user", "again")]  # the second answer is replaced
    asked = [say(*turns[:n]) for n in (1, 3, 4)]
    rows = []
    for i, messages in enumerate(asked):
        rows += [{"kind": "prepare", "request_id": i, "messages": messages}, {"kind": "commit", "request_id": i, "output": "abc"}]
    rows.append({"kind": "finalize"})
    events = spark.createDataFrame([tuple({"session_id": "s", "seq": n, **r}.get(c) for c in names) for n, r in enumerate(rows)], chains.EVENT_SCHEMA)
    assert [tuple(r) for r in chains.rollback_counters(chains.stitch(events)).collect()] == [("s", 1, 3)]


def test_chat_turns_go_on_across_triggers(spark, tmp_path):
    schema = "chat_id string, message_id string, create_time string, content string"
    for i, rows in enumerate(([("a", "2", "2", "y"), ("a", "1", "1", "x"), ("b", "1", "1", "z")], [("a", "3", "3", "w")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in" / f"d={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    q = sessions.chat_turns(stream).writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["chat_id"], r["ordinal"], r["content"]) for r in spark.table("turns").collect())
    assert got == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "w"), ("b", 0, "z")]
