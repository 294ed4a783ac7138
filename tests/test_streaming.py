"""The running Gram matrix over files that arrive one after another."""

import numpy as np

from gridloom.streaming.running_gram import running_gram, windowed_gram


def test_running_gram(spark, tmp_path):
    rows = [[1.0, 2.0], [3.0, -1.0], [0.5, 4.0]]
    for k, r in enumerate(rows):
        spark.createDataFrame([(r,)], "a array<double>").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("a array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = running_gram(stream, "a").writeStream.outputMode("complete").format("memory").queryName("gram").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    x = np.array(rows)
    got = {(r["i"], r["j"]): r["v"] for r in spark.table("gram").collect()}
    assert got == {(i, j): (x.T @ x)[i, j] for i in range(2) for j in range(i + 1)}


def test_windowed_gram_of_a_table(spark):
    frame = spark.createDataFrame([("2024-01-01 00:00:10", [1.0]), ("2024-01-01 00:00:50", [2.0]), ("2024-01-01 00:01:10", [3.0])], "t string, a array<double>").selectExpr("cast(t as timestamp) t", "a")
    assert sorted(r["v"] for r in windowed_gram(frame, "a", "t", "1 minute", "1 minute").collect()) == [5.0, 9.0]
