from lodestar.streaming.landing import land_stream, merging


def test_batches_replace_keys(spark, tmp_path):
    source = tmp_path / "in"
    state = {"n": 0}

    def read():
        return spark.read.parquet(f"{tmp_path}/out{state['n']}") if state["n"] else None

    def write(df, number):
        df.write.mode("overwrite").parquet(f"{tmp_path}/out{state['n'] + 1}")
        state["n"] += 1

    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("k long, v string").parquet(str(source))
        land_stream(stream, merging(read, write, ["k"]), str(tmp_path / "check")).start().awaitTermination()
    assert sorted(tuple(r) for r in read().collect()) == [(1, "a"), (2, "c"), (3, "d")]
