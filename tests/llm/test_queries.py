import __spark_entry__ as entry_module


def test_names():
    names = entry_module.queries()
    for n in (2, 3, 4, 5, 10):
        assert f"p{n}_found" in names
    assert "p8_containers" in names and "p9_mixture" in names and "p5_found" in entry_module.oracle_sql()


def test_columns(spark, sf):
    wanted = {
        "p2_found": [("listing_id_1", "bigint"), ("listing_id_2", "bigint")],
        "p3_found": [("tabla", "string"), ("fila_id", "bigint"), ("campo", "string"), ("restaurado", "string")],
        "p4_found": [("tabla", "string"), ("fila_id", "bigint"), ("cba_item_id", "bigint")],
        "p5_found": [("cba_name", "string"), ("supermarket", "string"), ("puesto", "int"), ("listing_id", "bigint")],
        "p10_found": [("doc_id", "bigint"), ("sent_no", "int"), ("start_pos", "int"), ("end_pos", "int")],
    }
    for name, columns in wanted.items():
        df = entry_module.queries()[name](spark, sf)
        assert df.dtypes == columns and df.count() > 0, name
