from assayer.operators import judging
from assayer.streaming import judged


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_running_metrics_equal_the_batch(spark, tmp_path):
    rows = [("m" if i % 3 else "n", ["exact", "llm", "no_llm", "unmatched"][i % 4], "yes" if i % 4 < 2 and i % 5 else "no") for i in range(60)]
    df = spark.createDataFrame(rows, "model_short string, decision_method string, correct string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = judged.judged_stream(spark, str(tmp_path / "in"), "model_short string, decision_method string, correct string", 1)
    out = drain(judged.running_metrics(stream, ["model_short"]), "running", "complete")
    assert sorted(out.collect()) == sorted(judging.metrics(df, ["model_short"]).collect())


def test_each_request_once(spark, tmp_path):
    spark.sql("SELECT 'j' AS judge_model, 'v' AS prompt_version, CAST(id % 5 AS STRING) AS prompt_sha256, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id) AS at FROM range(40)").repartition(3).write.parquet(str(tmp_path / "r"))
    stream = judged.judged_stream(spark, str(tmp_path / "r"), "judge_model string, prompt_version string, prompt_sha256 string, at timestamp", 1)
    assert drain(judged.first_requests(stream, "at"), "requests", "append").count() == 5
