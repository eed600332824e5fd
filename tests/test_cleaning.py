from decimal import Decimal

from pyspark.sql import functions as F

from works_risk.functions import cleaning as C
from works_risk.functions import scalars as S


def test_ids(spark):
    texts = [
        "WS/MP084/2024-2025/38666-Tank - phase 2", "MP1/1999-2000/7", "NA-123 x", " na-5 ", None, "",
        "MP1/2020-2021/1 MP2/2020-2021/2",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    wid = C.work_id_or_token(F.col("t"))
    rows = df.select(
        wid.alias("id"), C.work_id_or_token(F.col("t"), True).alias("strict"),
        C.work_id(F.col("t"), C.WORK_ID_THIS_CENTURY).alias("recent"), C.work_title(F.col("t")).alias("title"),
        C.mp_number(wid).alias("mp"), C.fiscal_year(wid).alias("fy"), C.work_number(wid).alias("no"),
        C.is_unparseable(wid).alias("na"),
    ).collect()
    assert [r["id"] for r in rows] == ["MP084/2024-2025/38666", "MP1/1999-2000/7", "NA-123", "na-5", None, None, "MP1/2020-2021/1"]
    assert [r["strict"] for r in rows][2:4] == [None, None]
    assert rows[1]["recent"] is None and rows[0]["recent"] == "MP084/2024-2025/38666"
    assert rows[0]["title"] == "Tank - phase 2"
    assert (rows[0]["mp"], rows[0]["fy"], rows[0]["no"]) == ("084", "2024-2025", "38666")
    assert [r["na"] for r in rows] == [False, False, True, True, False, False, False]
    assert (rows[3]["mp"], rows[3]["fy"], rows[3]["no"]) == ("5", "", "")


def test_money_and_dates(spark):
    money = ["1,23,456 ( ₹ )", "154773472.11", "4,05,67,400", "", None, "abc", "0", "-12.5", "Rs. 1,234.50", "₹ 7"]
    df = spark.createDataFrame([(m,) for m in money], "m string")
    got = [r[0] for r in df.select(C.money(F.col("m"))).collect()]
    assert got == [Decimal(x) for x in ("123456.00", "154773472.11", "40567400.00", "0.00", "0.00", "0.00", "0.00", "-12.50", "1234.50", "7.00")]
    digits = [r[0] for r in df.select(C.money(F.col("m"), "digits")).collect()]
    assert digits[1] == Decimal("15477347211.00")
    days = spark.createDataFrame([(d,) for d in ("23-Sep-2024", "2024-09-23", "2024-13-01", "", None)], "d string")
    assert [str(r[0]) for r in days.select(C.day(F.col("d"))).collect()] == ["2024-09-23", "2024-09-23", "None", "None", "None"]


def test_text(spark):
    df = spark.createDataFrame([("  Ab \n c\t D ",), ("MP1/2024-2025/7",), ("__",), ("  X  ",), (" ",)], "t string")
    c = F.col("t")
    rows = df.select(
        C.normalised_text(c), C.safe_file_name(c), C.trim_name(c), C.has_text(c), C.has_long_text(c), C.number_or_zero(c)
    ).collect()
    assert rows[0][0] == "ab c d"
    assert [r[1] for r in rows[1:3]] == ["MP1_2024-2025_7", "work"]
    assert rows[3][2] == "X"
    assert [r[3] for r in rows] == [True, True, True, True, False]
    assert [r[4] for r in rows] == [False, True, False, False, False]
    assert all(r[5] == 0.0 for r in rows)


def test_scalars(spark):
    df = spark.createDataFrame([(Decimal("2500.00"), Decimal("0.00")), (Decimal("3500.00"), None)], "a decimal(18,2), b decimal(18,2)")
    rows = df.select(
        S.amount_bucket(F.col("a"), 1000), S.guarded_ratio(F.col("a"), F.col("b")), S.float_text(F.col("a")),
        S.clipped_score(F.lit(125)), S.joined_texts("; ", F.lit(""), F.lit("x"), F.lit(None).cast("string"), F.lit("y")),
        S.amount_bucket(F.col("b"), 0),
    ).collect()
    assert [r[0] for r in rows] == [2, 4]
    assert [r[1] for r in rows] == [None, None]
    assert rows[0][2] == "2500.0" and rows[0][3] == 100 and rows[0][4] == "x; y"
    assert rows[1][5] == Decimal("0.00")
