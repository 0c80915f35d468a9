"""Functions on hand-made series: golden values and edge cases."""

import pytest
from pyspark.sql import functions as F

import seriesloom.operators  # noqa: F401
from seriesloom.functions.parser import ParseError
from seriesloom.plans.compiler import Engine
from seriesloom.plans.registry import FUNCTIONS
from seriesloom.sources import replicas, sinks
from seriesloom.sources.store import PointTable, Store

N = None


def engine(spark, step=1, **series):
    rows = [(name.replace("__", "."), i * step, float(v)) for name, values in series.items() for i, v in enumerate(values) if v is not None]
    table = PointTable("m", spark.createDataFrame(rows, "name string, ts long, v double"), step)
    return Engine(Store(spark, [table]))


def run(e, target, stop, start=0):
    return [(r["name"], [None if v is None else round(v, 9) for v in r["values"]]) for r in e.evaluate(target, start, stop).orderBy("ord").collect()]


def test_all_functions_are_registered():
    assert len(FUNCTIONS) == 140


@pytest.mark.parametrize(
    ("target", "want"),
    [
        ("absolute(m.a)", [0, 1, 2, N, 4]),
        ("derivative(m.a)", [N, 1, 1, N, 2]),
        ("integral(m.a)", [0, 1, 3, N, 7]),
        ("nonNegativeDerivative(m.a)", [N, 1, 1, N, N]),
        ("keepLastValue(m.a)", [0, 1, 2, 2, 4]),
        ("delay(m.a,2)", [N, N, 0, 1, 2]),
        ("changed(m.a)", [0, 1, 1, 1, 1]),
        ("movingAverage(m.a,2)", [N, N, 0.5, 1.5, 2]),
        ("movingSum(m.a,2)", [N, N, 1, 3, 2]),
        ("movingMedian(m.a,2)", [N, 0.5, 1.5, 2, 4]),
        ("invert(m.a)", [N, 1, 0.5, N, 0.25]),
        ("transformNull(m.a,9)", [0, 1, 2, 9, 4]),
        ("offsetToZero(offset(m.a,5))", [0, 1, 2, N, 4]),
        ("ewma(m.a,0.9)", [0, 0.9, 1.89, N, 3.789]),
        ("summarize(m.a,'2s')", [1, 2, 4]),
        ("summarize(m.a,'2s','max',true)", [1, 2, 4]),
        ("hitcount(m.a,'2s')", [1, 2, 4]),
        ("removeAboveValue(m.a,1)", [0, 1, N, N, N]),
        ("linearRegression(m.a)", [0, 1, 2, 3, 4]),
        ("polyfit(m.a,1,'2s')", [0, 1, 2, 3, 4, 5, 6]),
        ("nPercentile(m.a,50)", [1.5] * 5),
    ],
)
def test_values(spark, target, want):
    (_, got), = run(engine(spark, m__a=[0, 1, 2, N, 4]), target, 5)
    assert got == [None if v is None else pytest.approx(v, abs=1e-9) for v in want]


def test_smoothing_golden(spark):
    (name, got), = run(engine(spark, m__a=[0, 1, 1, 1, N, 1, 1]), "exponentialWeightedMovingAverage(m.a,0.9)", 7)
    assert name == "ewma(m.a,0.9)" and got == [0, 0.9, 0.99, 0.999, None, 0.9999, 0.99999]


def test_time_lag_golden(spark):
    (_, got), = run(engine(spark, m__c=[1, 2, 3, 4, 5], m__p=[2, 4, 6, 8, 10]), "timeLagSeries(m.c,m.p)", 5)
    assert got == [None, 1, 2, 2, 3]


def test_reducers_and_names(spark):
    e = engine(spark, m__a=[1, 2, N], m__b=[3, N, N], m__c=[5, 6, N])
    assert run(e, "sum(m.*)", 3) == [("sumSeries(m.*)", [9, 8, None])]
    assert run(e, "multiplySeries(m.*)", 3) == [("multiplySeries(m.*)", [15, None, None])]
    assert run(e, "diffSeries(m.*)", 3) == [("diffSeries(m.*)", [-7, -4, None])]
    assert run(e, "countSeries(m.*)", 3) == [("countSeries(m.*)", [3, 3, 3])]
    assert run(e, "percentileOfSeries(m.*,50)", 3) == [("percentileOfSeries(m.*,50)", [3, 6, None])]


def test_mixed_steps_meet_at_the_common_multiple(spark):
    fine = PointTable("m", spark.createDataFrame([("m.a", 3 * i, float(i + 1)) for i in range(7)], "name string, ts long, v double"), 3)
    rough = PointTable("n", spark.createDataFrame([("n.a", 7 * i, float(i + 1)) for i in range(3)], "name string, ts long, v double"), 7)
    (_, got), = run(Engine(Store(spark, [fine, rough])), "sumSeries(m.a,n.a)", 21)
    assert got == [4 + 2]


def test_order_follows_braces_and_nodes(spark):
    e = engine(spark, m__b=[1], m__a=[2], m__c=[3])
    assert [n for n, _ in run(e, "m.*", 1)] == ["m.a", "m.b", "m.c"]
    assert [n for n, _ in run(e, "m.{c,a}", 1)] == ["m.c", "m.a"]
    assert [n for n, _ in run(e, "group(m.c,m.a)", 1)] == ["m.c", "m.a"]
    assert [n for n, _ in run(e, "sortByMaxima(m.*)", 1)] == ["m.c", "m.a", "m.b"]
    assert [n for n, _ in run(e, "limit(sortByMaxima(m.*),1)", 1)] == ["m.c"]


def test_empty_lists(spark):
    e = engine(spark, m__a=[1, 2])
    assert run(e, "sumSeries(m.nothing)", 2) == []
    assert run(e, "fallbackSeries(m.nothing,m.a)", 2) == [("m.a", [1, 2])]
    assert run(e, "fallbackSeries(m.a,m.nothing)", 2) == [("m.a", [1, 2])]
    assert run(e, "removeEmptySeries(m.a)", 2) == [("m.a", [1, 2])]


def test_as_percent_by_nodes(spark):
    e = engine(spark, m__x__a=[1], m__x__b=[3], m__t__a=[4], m__t__c=[5])
    got = dict(run(e, "asPercent(m.x.*,m.t.*,2)", 1))
    assert got == {"asPercent(m.x.a,m.t.a)": [25], "asPercent(m.x.b,MISSING)": [None], "asPercent(MISSING,m.t.c)": [None]}


def test_names(spark):
    e = engine(spark, m__web01__cpu=[1])
    for target, want in [("aliasByNode(scale(m.web01.cpu,2),1,-1)", "web01.cpu"), ("aliasByMetric(m.web01.cpu)", "cpu"), ("aliasSub(m.web01.cpu,'web(\\d+)','w\\1')", "m.w01.cpu"), ("substr(m.web01.cpu,-2)", "web01.cpu"), ("legendValue(m.web01.cpu,'max')", "m.web01.cpu (max: 1.000000)")]:
        assert run(e, target, 1)[0][0] == want


def test_errors(spark):
    e = engine(spark, m__a=[1])
    for target in ("nonsense(m.a)", "scale(m.a)", "movingAverage(m.a)", "summarize(m.a,'1h','odd')", "randomWalk()"):
        with pytest.raises(ParseError):
            e.evaluate(target, 0, 1)
    with pytest.raises(ParseError):
        e.evaluate("m.a", 1, 1)


def test_replica_vote(spark):
    rows = spark.createDataFrame([(0, "a", 1, 0, 1.0), (1, "a", 1, 0, 2.0), (2, "a", 1, 0, 2.0), (0, "a", 1, 1, None), (1, "a", 1, 1, 5.0), (3, "a", 60, 0, 9.0)], "replica int, name string, step int, ts long, v double")
    merged = replicas.merge(rows, "majority")
    assert sorted((r.ts, r.v) for r in merged.points.collect()) == [(0, 2.0), (1, 5.0)]
    assert [tuple(r) for r in merged.stats.collect()] == [("a", 2, 1, 1)]
    assert sorted((r.ts, r.v) for r in replicas.merge(rows).points.collect()) == [(0, 1.0), (1, 5.0)]


def test_sinks(spark):
    import json
    import pickle

    df = engine(spark, m__a=[1, N, 2.5]).evaluate("m.a", 0, 3)
    assert json.loads(sinks.json_rows(df).first()["json"]) == {"target": "m.a", "datapoints": [[1, 0], [None, 1], [2.5, 2]]}
    assert [r["csv"] for r in sinks.csv_rows(df).orderBy("i").collect()] == ['"m.a",1970-01-01 00:00:00,1', '"m.a",1970-01-01 00:00:01,', '"m.a",1970-01-01 00:00:02,2.5']
    assert sinks.raw_rows(df).first()["raw"] == "m.a,0,3,1|1,None,2.5"
    assert pickle.loads(sinks.pickled(df))[0]["values"] == [1, None, 2.5]
    assert sinks.reduced_to(df, 1).select("values").first()[0] == [1.75]


def test_stream_of_points(spark, tmp_path):
    import datetime as dt

    from seriesloom import streaming

    first = dt.datetime(2024, 1, 1)
    rows = [("a", first + dt.timedelta(seconds=s), 1.0) for s in (0, 10, 70, 4000)]
    spark.createDataFrame(rows, "name string, time timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, time timestamp, value double").parquet(str(tmp_path / "in"))
    streaming.store(stream, 60, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").select(F.col("v")).collect()
    assert [r[0] for r in got] == [2.0, 1.0]


def test_plain_numbers(spark):
    numbers = [12.0, 0.1, 1e7, 123456789.25, 1e22, 1.5e-7, -2.5e10, 0.0, 1e-5, -1 / 3]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in numbers], "v double").select(sinks.plain(F.col("v"))).collect()]
    assert got == ["12", "0.1", "10000000", "123456789.25", "1" + "0" * 22, "0.00000015", "-25000000000", "0", "0.00001", "-0.3333333333333333"]
