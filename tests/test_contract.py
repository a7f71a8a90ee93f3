import __spark_entry__ as entry_module


def test_entry(spark, sf):
    assert entry_module.entry(spark).limit(1).count() == 1


def test_names():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
    for n in (1, 6, 7):
        assert f"p{n}_found" in queries


def test_stream(spark, sf, tmp_path):
    from pricelens.streaming.snapshots import first_captures, listing_stream

    rows = spark.read.parquet(f"{sf}/cba_premium_mejor_por_supermercado.parquet").selectExpr("listing_id", "supermarket", "sku", "cast(extracted_at as timestamp) extracted_at").where("sku is not null")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = first_captures(listing_stream(spark, str(tmp_path / "in"), rows.schema), ["supermarket", "sku"], "extracted_at", "1000 days")
    q = stream.writeStream.format("memory").queryName("captures").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("captures").count() == rows.select("supermarket", "sku").distinct().count()
