import datetime as dt

import pytest
from pyspark.sql import functions as F

from clauseworks.schemas import FOREIGN, SCHEMAS, UNIQUE
from clauseworks.sources import tables
from clauseworks.streaming import ingest

T = dt.datetime(2026, 1, 2, 3, 4, 5)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([("p", "u", "t", "c", True, T), ("q", "u", "t", "", False, T)], SCHEMAS["presets"])
    tables.write(df, str(tmp_path / fmt), fmt)
    back = tables.read(spark, "presets", str(tmp_path / fmt), fmt)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        tables.read(spark, "presets", "x", "xml")


def test_database_round_trip(spark):
    """Through the embedded database that Spark itself ships with."""
    url = "jdbc:derby:memory:clauseworks;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.createDataFrame([("p", "u", "t", "c", True), ("q", "u", "t", None, False)], "id string, user_id string, title string, content string, is_active boolean")
    try:
        tables.write_jdbc(df, "presets", url, "overwrite", **driver)
    except Exception as missing:  # noqa: BLE001
        pytest.skip(f"no embedded database: {missing}"[:200])
    back = tables.read_jdbc(spark, "presets", url, **driver)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert [r["id"] for r in back.filter("is_active").collect()] == ["p"]


def test_bodies_responses_and_files(spark, tmp_path):
    df = spark.createDataFrame([('{"fileName":"a","s3Key":"b"}',), ("{",), (None,)], "body string")
    assert [r["fileName"] for r in tables.bodies(df, "body", "fileName string, s3Key string").collect()] == ["a", None, None]
    assert spark.range(1).select(tables.responses(F.struct(F.lit(None).cast("string").alias("name")))).first()[0] == '{"name":null}'
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.pdf").write_bytes(b"\xff\xfe")
    (tmp_path / "f" / "b.txt").write_bytes("é".encode())
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in tables.extract_text(tables.documents(spark, str(tmp_path / "f"))).collect()}
    assert got == {"a.pdf": None, "b.txt": "é"}


def test_schemas_name_their_keys():
    assert all(set(c) <= set(SCHEMAS[t].names) for t, keys in UNIQUE.items() for c in keys)
    assert all(c in SCHEMAS[child].names and parent in SCHEMAS for child, c, parent in FOREIGN)
    assert not SCHEMAS["users"]["email"].nullable and SCHEMAS["users"]["name"].nullable


def test_stream_of_deliveries(spark, tmp_path):
    rows = [(1, "a", T), (1, "a", T + dt.timedelta(days=1)), (2, "b", T)]
    df = spark.createDataFrame(rows, "result_id int, status string, received_at timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    query = ingest.first_delivery(ingest.deliveries(spark, str(tmp_path / "in"), df.schema), ["result_id"], "received_at").writeStream.format("memory").queryName("first").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["result_id"] for r in spark.sql("select * from first").collect()) == [1, 2]
