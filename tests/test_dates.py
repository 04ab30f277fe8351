from datetime import datetime

from pyspark.sql import functions as F

from pageloom.functions.dates import _month_numbers, parse_date

DAY = "2024-01-05"
GOLDEN = {
    "2024-01-05": DAY, "2024-1-5": DAY, "2024/01/05": DAY, "2024.01.05": DAY, "20240105": DAY, "01/05/2024": DAY,
    "1/5/24": DAY, "5.1.2024": DAY, "05.01.24": DAY, "05-Jan-2024": DAY, "5-jan-24": DAY, "Jan 5 2024": DAY,
    "Jan 5, 2024": DAY, "January 5th, 2024": DAY, "Jan. 5, 2024": DAY, "5 January 2024": DAY, "5 Jan 2024": DAY,
    "Friday, January 5, 2024": DAY, "Fri, 5 Jan 2024": DAY, "2024 January 5": DAY, "the 5th of January 2024": DAY,
    "5 janvier 2024": DAY, "vendredi 5 janvier 2024": DAY, "5. Januar 2024": DAY, "5 de enero de 2024": DAY,
    "5 gennaio 2024": DAY, "5 de janeiro de 2024": DAY, "1er mars 2024": "2024-03-01", "12 août 2023": "2023-08-12",
    "3. März 2024": "2024-03-03", "2024年1月5日": DAY, "2024년 1월 5일": DAY, "２０２４年１月５日": DAY, "2024-W01-5": DAY,
    "2024W015": DAY, "2024-005": DAY, "January 2024": "2024-01-01", "Jan 2024": "2024-01-01", "2024-01": "2024-01-01",
    "01/2024": "2024-01-01", "2024年1月": "2024-01-01", "Sept 3, 2023": "2023-09-03", "25/12/2023": "2023-12-25",
    "13.02.1999": "1999-02-13", "1 Jan 70": "1970-01-01", "31 Dec 68": "2068-12-31",
    "1704412800": "2024-01-05T00:00:00", "1704412800123": "2024-01-05T00:00:00.123",
    "2024-01-05T10:30:00": "2024-01-05T10:30:00", "2024-01-05T10:30:00Z": "2024-01-05T10:30:00",
    "2024-01-05T10:30:00.123456+02:00": "2024-01-05T08:30:00.123456", "2024-01-05T10:30+0530": "2024-01-05T05:00:00",
    "2024-01-05T10:30:00-05": "2024-01-05T15:30:00", "20240105T103000": "2024-01-05T10:30:00",
    "20240105T1030": "2024-01-05T10:30:00", "2024-01-05 10:30 PM": "2024-01-05T22:30:00",
    "10:30 AM, Jan 5, 2024": "2024-01-05T10:30:00", "January 5, 2024 at 10:30 p.m.": "2024-01-05T22:30:00",
    "Jan 5, 2024 10pm": "2024-01-05T22:00:00", "5 January 2024 12:00 am": "2024-01-05T00:00:00",
    "12:15 pm 5 Jan 2024": "2024-01-05T12:15:00", "Fri, 05 Jan 2024 10:30:00 GMT": "2024-01-05T10:30:00",
    "Fri, 05 Jan 2024 10:30:00 +0100": "2024-01-05T09:30:00", "Fri Jan 5 10:30:00 UTC 2024": "2024-01-05T10:30:00",
    "Jan 5, 2024 10:30 EST": "2024-01-05T15:30:00", "5 janvier 2024 à 10h30": "2024-01-05T10:30:00",
    "5. Januar 2024 um 10:30 Uhr": "2024-01-05T10:30:00", "2024年1月5日 10時30分": "2024-01-05T10:30:00",
    "  2024-01-05 10:30 ": "2024-01-05T10:30:00", "Fri Jan 05 2024 10:30:00 GMT+0100 (Central European Time)": "2024-01-05T09:30:00",
}
NO_DATES = [
    None, "", " ", "yesterday", "posted 5 January", "5 January", "January", "2024", "10:30", "13/13/2024", "2024-02-30",
    "2024-01-05 25:00", "5 foo 2024", "Jan Feb 2024", "123456", "99999999999", "1 2 3 4", "2024-W54", "2024-000",
    "January 32, 2024", "99:99 Jan 5 2024", "12345-01-01", "x" * 5000, "1" * 5000,
]


def read(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return {r["i"]: r["d"] for r in table.select("i", parse_date(F.col("t")).alias("d")).collect()}


def test_golden(spark):
    assert len(GOLDEN) > 60
    got = read(spark, GOLDEN)
    wrong = {t: got[i] for i, (t, want) in enumerate(GOLDEN.items()) if got[i] != datetime.fromisoformat(want)}
    assert wrong == {}


def test_no_dates(spark):
    got = read(spark, NO_DATES)
    assert {NO_DATES[i]: d for i, d in got.items() if d is not None} == {}


def test_month_names():
    known = _month_numbers()
    assert (known["sept"], known["jun"], known["dez"], known["mar"], known["mai"]) == (9, 6, 12, 3, 5)
    assert "jui" not in known and "ja" not in known and "ju" not in known
