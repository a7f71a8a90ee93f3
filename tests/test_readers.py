from pricelens.sources.readers import read_delimited


def test_accents_after_the_first_64_kb(spark, tmp_path):
    for encoding in ("cp1252", "utf-8"):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes(b"id;name\n" + b"1;arroz\n" * 10_000 + "2;Piñón – 5 €\n".encode(encoding))
        assert [r["name"] for r in read_delimited(spark, str(path)).where("id = '2'").collect()] == ["Piñón – 5 €"]
