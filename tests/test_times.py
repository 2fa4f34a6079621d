from datetime import datetime

from pathmeter.functions import times


def test_round_trip_in_any_session_zone(spark):
    samples = [
        datetime(2024, 3, 10, 2, 30, 0, 1), datetime(1969, 12, 31, 23, 59, 59, 999_999), datetime(1970, 1, 1),
        datetime(2024, 11, 3, 1, 30, 0, 999_999), datetime(2099, 12, 31, 23, 59, 59, 5),
    ]
    df = spark.createDataFrame([(s,) for s in samples], "ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = df.select(times.plain(times.instant("ts")).alias("a"), times.from_micros(times.micros("ts")).alias("b"), times.micros("ts").alias("m")).collect()
            assert [r.a for r in got] == [r.b for r in got] == samples
            assert got[1].m == -1 and got[2].m == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
