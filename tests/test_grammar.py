"""Opening hours and prices by hand-written cases."""

from decimal import Decimal

from pyspark.sql import functions as F

from wayfold.functions import grammar
from wayfold.operators import knowledge as kn

WEEK = range(7)
HOURS = [
    ("Mon-Fri 09:00-17:00", [(d, 540, 1020) for d in range(5)]),
    ("Mon-Fri 9am-5pm; Sat 10:00-14:00", [(d, 540, 1020) for d in range(5)] + [(5, 600, 840)]),
    ("Monday to Wednesday, Sat & Sun: 9-12, 13:30-18h", [(d, *s) for d in (0, 1, 2, 5, 6) for s in ((540, 720), (810, 1080))]),
    ("Fri-Mon 18:00-02:00", [(d, 1080, 1560) for d in (0, 4, 5, 6)]),
    ("daily 08:00-22:00; Sun closed", [(d, 480, 1320) for d in range(6)]),
    ("08:00-22:00\nTue 12:00-14:00", [(d, 720, 840) if d == 1 else (d, 480, 1320) for d in WEEK]),
    ("24/7", [(d, 0, 1440) for d in WEEK]),
    ("open 24 hours", [(d, 0, 1440) for d in WEEK]),
    ("T2-T6 8h-17h30; CN off", [(d, 480, 1050) for d in range(5)]),
    ("Sat 6-11pm", [(5, 1080, 1380)]),
    ("Sat 9-5pm", [(5, 540, 1020)]),
    ("Sat 10pm-2am", [(5, 1320, 1560)]),
    ("Sat 12am-12pm", [(5, 0, 720)]),
    ("Sat 20:00-24:00", [(5, 1200, 1440)]),
    ("Sat 14:00-16:00, 09:00-11:00", [(5, 540, 660), (5, 840, 960)]),
    ("closed", []),
    ("Mon closed", []),
    ("by appointment", None),
    ("Mon 9-17; ask us", None),
    ("Mon 25:00-26:00", None),
    ("", None),
    (" ; ", None),
    (None, None),
    ("mon 9-17;" * 3000, [(0, 540, 1020)]),
]


def test_opening_hours(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HOURS)], "i int, t string")
    got = {r.i: None if r.h is None else [tuple(x) for x in r.h] for r in df.select("i", grammar.opening_hours(F.col("t")).alias("h")).collect()}
    assert [(t[:60] if t else t, got[i]) for i, (t, _) in enumerate(HOURS)] == [(t[:60] if t else t, h) for t, h in HOURS]


def test_hours_feed_open_at(spark):
    df = spark.sql("SELECT 'Fri 18:00-02:00; Sat closed' AS t").select(grammar.opening_hours(F.col("t")).alias("hours"))
    assert [df.where(kn.open_at(F.col("hours"), d, m)).count() for d, m in ((4, 1100), (5, 60), (5, 120), (5, 1100), (4, 60))] == [1, 1, 0, 0, 0]


PRICES = [
    ("$12.50", ("12.50", "12.50", "USD")),
    ("12 USD - 20 USD", ("12.00", "20.00", "USD")),
    ("$12.50-20", ("12.50", "20.00", "USD")),
    ("EUR 10 – 25,50", ("10.00", "25.50", "EUR")),
    ("€1.234,50", ("1234.50", "1234.50", "EUR")),
    ("1,234.5 dollars", ("1234.50", "1234.50", "USD")),
    ("200.000đ", ("200000.00", "200000.00", "VND")),
    ("200.000 - 1.500.000 VND", ("200000.00", "1500000.00", "VND")),
    ("từ 200k đến 500k", ("200000.00", "500000.00", None)),
    ("200-500k", ("200000.00", "500000.00", None)),
    ("1,5 triệu", ("1500000.00", "1500000.00", None)),
    ("500k - 1.2 triệu đồng", ("500000.00", "1200000.00", "VND")),
    ("from £15", ("15.00", None, "GBP")),
    ("£15+", ("15.00", None, "GBP")),
    ("up to 30 eur", (None, "30.00", "EUR")),
    ("1 200 000 ₫", ("1200000.00", "1200000.00", "VND")),
    ("20 to 10", ("10.00", "20.00", None)),
    ("Free", ("0.00", "0.00", None)),
    ("0", ("0.00", "0.00", None)),
    ("ask us", None),
    ("call 12 34", None),
    ("", None),
    (None, None),
]


def test_price_ranges(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PRICES)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", grammar.price_range(F.col("t")).alias("p")).collect()}
    money = lambda x: None if x is None else Decimal(x)
    want = [(t, None if p is None else (money(p[0]), money(p[1]), p[2])) for t, p in PRICES]
    assert [(t, None if got[i] is None else tuple(got[i])) for i, (t, _) in enumerate(PRICES)] == want
