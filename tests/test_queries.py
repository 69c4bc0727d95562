"""Every registered query against its SQL, and the streams against their batch twins."""

import os
from datetime import timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillstone import plans
from quillstone.operators.learner import topic_mastery
from quillstone.plans.roles import attempts, edges

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def cell(v):
    return round(v, 5) if isinstance(v, float) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_is_what_its_sql_says(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF), duck.sql(plans.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got.columns, got.collect()) == table(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES) - {n for n in plans.QUERIES if n.startswith("stream_")}))
def test_query_without_sql_runs(spark, name):
    df = plans.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_streams_end_where_their_batch_twins_do(spark):
    run = lambda name: plans.QUERIES[name](spark, SF)
    rows = lambda df, *cols: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    cols = ("user_id", "question_id", "seq")
    assert rows(run("stream_current_answers"), *cols) == rows(run("current_answers"), *cols)
    cols = ("user_id", "topic_id", "attempted", "correct", "accuracy", "median_ms")
    assert rows(run("stream_topic_mastery"), *cols) == rows(topic_mastery(attempts(spark, SF), edges(spark, SF)), *cols)
    days = attempts(spark, SF).groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("used"))
    usage = run("stream_daily_usage")
    closed = days.join(usage.agg(F.max("day").alias("last")), F.col("day") <= F.col("last"))
    assert rows(usage, "user_id", "day", "used") == rows(closed, "user_id", "day", "used") and usage.count() > 0
    assert rows(run("stream_dedupe"), "seq") == rows(attempts(spark, SF), "seq")
    gap, last = 30 * 60, attempts(spark, SF).agg(F.max("created_at")).first()[0]
    want, by_user = [], {}
    for r in attempts(spark, SF).select("user_id", "created_at").orderBy("created_at").collect():
        by_user.setdefault(r["user_id"], []).append(r["created_at"])
    for user, times in by_user.items():
        sitting = [times[0]]
        for t in [*times[1:], None]:
            if t is not None and (t - sitting[-1]).total_seconds() < gap:
                sitting.append(t)
                continue
            if (last - sitting[-1]).total_seconds() - gap > 24 * 3600:  # the watermark has passed it
                want.append((user, sitting[0], sitting[-1] + timedelta(seconds=gap), len(sitting)))
            sitting = [t]
    got = [tuple(r) for r in run("stream_sittings").select("user_id", F.col("begin").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), "attempts").collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)


@pytest.mark.parametrize("least", [1 << 30, 1])
def test_a_batch_writes_its_own_rows_and_no_others(spark, tmp_path, least):
    """Without a base, and with one made anew as often as can be; a repeated batch changes nothing."""
    from quillstone.streaming.attempts import ALL, Snapshot, _merge_answers, latest_answers

    state = Snapshot(f"file://{tmp_path}/answers", latest_answers, least_bytes=least, part_bytes=1000)
    of = lambda *rows: spark.createDataFrame(rows, "user_id bigint, question_id bigint, seq bigint")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    batches = [[(u, 1, 10 + u) for u in range(40)], [(3, 1, 99), (3, 2, 5), (4, 1, 1), (None, 1, 7)], [(3, 1, 98)], [(3, 1, 98)], [(None, 1, 6), (8, 1, 500)]]
    numbers = [0, 1, 2, 2, 3]  # the third comes twice
    for number, batch in zip(numbers, batches, strict=True):
        _merge_answers(state, of(*batch), number)
        assert spark.read.parquet(f"file://{tmp_path}/answers/v={number}").count() == len(batch)
    users = of((3, 0, 0), (4, 0, 0), (5, 0, 0), (None, 0, 0), (77, 0, 0)).select("user_id")
    want = [(3, 1, 99), (3, 2, 5), (4, 1, 14), (5, 1, 15), (None, 1, 7)]
    assert rows(state.read(spark, ALL, users)) == sorted(want, key=repr)
    assert state.read(spark, ALL).count() == 42 and state.read(spark, ALL).where("seq = 500").count() == 1
    assert state.read(spark, 3).where("seq = 500").count() == 0  # as it was before the last batch
    written, bases, _ = state.written()
    if least == 1:
        ((begin, parts),) = bases
        assert begin >= 1 and parts > 1 and sorted(written) == list(range(begin, 4))
    else:
        assert not bases and sorted(written) == [0, 1, 2, 3]


def test_a_topic_that_a_user_has_no_more_is_gone(spark, tmp_path):
    from quillstone.streaming.attempts import ALL, Snapshot, latest_of_user

    state = Snapshot(f"file://{tmp_path}/mastery", latest_of_user, least_bytes=1, part_bytes=1000)
    of = lambda *rows: spark.createDataFrame(rows, "user_id bigint, topic_id bigint, n int")
    state.write(of((1, 5, 1), (1, 6, 1), (2, 5, 1)), 0)
    state.write(of((1, 6, 2)), 1)
    state.write(of((2, None, None)), 2)
    assert sorted(map(tuple, state.read(spark, ALL).where("topic_id IS NOT NULL").collect())) == [(1, 6, 2)]


@pytest.mark.parametrize("name", sorted(n for n in plans.ORACLES if not n.startswith("stream_")))
def test_plans_have_no_nested_loops(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan, name


#: Checks that find nothing where all is well.
MAY_BE_EMPTY = {"append_only_audit"}


def test_no_query_is_held_against_an_empty_answer(duck):
    assert {name for name, sql in plans.ORACLES.items() if not duck.sql(f"SELECT count(*) FROM ({sql}) x").fetchall()[0][0]} <= MAY_BE_EMPTY


def test_the_entry_stands_without_what_the_subpackage_needs(monkeypatch):
    import builtins
    import sys

    real = builtins.__import__

    def blocked(name, *args, **kwargs):
        if name.split(".")[0] in ("ahocorasick", "tiktoken", "zstandard", "corpus_pipeline"):
            raise ModuleNotFoundError(name)
        return real(name, *args, **kwargs)

    for name in [m for m in sys.modules if m.startswith("quillstone.llm") or m in ("corpus_pipeline", "ahocorasick")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", blocked)
    assert set(__spark_entry__.queries()) == set(plans.QUERIES) and set(__spark_entry__.oracle_sql()) == set(plans.ORACLES)


def test_the_entry_and_the_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 150


@pytest.mark.parametrize("name", ["v_structured", "review_queue", "review_page", "question_parts"])
def test_nested_views_work_their_parts_out_once(spark, name):
    """Trees, assets and tags read stored parts, and a page's total reads what the page reads."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan and (name != "review_page" or "o_orderkey" not in plan)
