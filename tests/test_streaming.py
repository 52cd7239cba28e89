import pytest
from pyspark.sql import functions as F

from weftline.plans.document import PlanError, read_plan
from weftline.queries import col, node, step, tab
from weftline.streaming.stream import compile_stream, contract_stream, flag_stream, violation_rates

RULES = [{"assertion": "non_negative", "column": "v"}]


@pytest.fixture
def stream(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") - 5).alias("v"), F.timestamp_seconds(F.col("id") * 60).alias("ts")).repartition(2).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("id long, v long, ts timestamp").parquet(str(tmp_path / "in"))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_scalar_plans_run_on_streams(stream):
    plan = read_plan({"intermediate_steps": {}, "output_mappings": {"id": node("COPY", col("id")), "w": node("MULTIPLY", col("v"), col("v"))}})
    got = drain(compile_stream(plan, stream), "scalars")
    assert got.count() == 100 and got.where("id = 7").first().w == 4.0
    with pytest.raises(PlanError):
        compile_stream(read_plan({"intermediate_steps": {"s": node("ORDER_BY", tab("source"), by="id")}, "output_mappings": {"id": node("COPY", step("s"), column="id")}}), stream)


def test_row_rules_and_windows(stream):
    got = drain(flag_stream(stream, RULES), "flags")
    assert got.where("size(_violations) > 0").count() == 5
    rates = drain(violation_rates(flag_stream(stream, RULES), "ts"), "rates", "complete")
    assert rates.agg(F.sum("n_rows"), F.sum("n_violating")).first()[:] == (100, 5)
    with pytest.raises(PlanError):
        flag_stream(stream, [{"assertion": "unique", "column": "id"}])


def test_contracts_per_micro_batch(spark, stream, tmp_path):
    seen = []
    q = contract_stream(stream, {"row_level_rules": RULES}, str(tmp_path / "clean"), str(tmp_path / "bad"), str(tmp_path / "check"), on_report=lambda i, r: seen.append(r.total_rows))
    q.awaitTermination()
    assert sum(seen) == 100
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 95 and spark.read.parquet(str(tmp_path / "bad")).count() == 5
