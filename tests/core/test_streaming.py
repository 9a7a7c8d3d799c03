import datetime as dt

from pyspark.sql import functions as F

from granary import streaming
from granary.functions import chat

A = "A long enough and useful answer to the question."


def run(df, path):
    df.writeStream.format("parquet").option("checkpointLocation", f"{path}-c").trigger(availableNow=True).start(path).awaitTermination()


def test_routes_and_distinct_conversations(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    talk = lambda q, a=A: [("user", q), ("assistant", a)]
    rows = spark.createDataFrame([(at, talk("q")), (at + dt.timedelta(minutes=5), talk(" Q ")), (at, talk("other")), (at, talk("q", "no"))], f"ts timestamp, messages {chat.MESSAGES}")
    rows.write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    run(streaming.routes(source()), f"{tmp_path}/routes")
    got = spark.read.parquet(f"{tmp_path}/routes")
    assert sorted(r.route for r in got.collect()) == ["pass", "pass", "pass", "rejected"]
    assert got.where(F.size("reasons") > 0).first().reasons == ["too_short"]
    run(streaming.distinct_conversations(source(), "ts"), f"{tmp_path}/distinct")
    assert spark.read.parquet(f"{tmp_path}/distinct").count() == 3
