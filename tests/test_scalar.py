from pyspark.sql import functions as F

from tallyforge.functions import profile, scalar


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_halves_go_up(spark):
    assert list(one(spark, scalar.half_up(F.lit(2.5)), scalar.half_up(F.lit(-2.5)), scalar.half_up(F.lit(1.005), 2), scalar.half_up(F.lit(0.125), 2))) == [3, -2, 1.0, 0.13]


def test_amounts(spark):
    got = one(spark, *[scalar.amount(F.lit(v)).alias(str(i)) for i, v in enumerate((999, 1000, 99_999, 100_000, 10_000_000, 123_456_789))])
    assert list(got) == ["999", "1.0K", "100.0K", "1.00 L", "1.00 Cr", "12.35 Cr"]


def test_names(spark):
    got = one(
        spark,
        scalar.slug(F.lit("South East (SC)")).alias("a"),
        scalar.person_key(F.lit("dr. a  b-c")).alias("b"),
        scalar.place_key(F.lit("Burdwan North (SC)"), {"burdwan": "bardhaman"}).alias("c"),
        scalar.title_case(F.lit("JOY-NAGAR (east)")).alias("d"),
        scalar.sound_key(F.lit("Sheetal Ghoosh")).alias("e"),
        scalar.same_name(F.lit("A. Bee"), F.lit("a bee")).alias("f"),
        scalar.same_name(F.lit(None).cast("string"), F.lit("a")).alias("g"),
        scalar.strip_markup(F.lit("<b>a</b>&nbsp;&amp; b")).alias("h"),
        scalar.reservation(F.lit("X (st)")).alias("i"),
    )
    assert list(got) == ["south-east-sc", "DR A BC", "bardhamannorth", "Joy-Nagar (East)", "sital gus", True, False, "a b", "ST"]


def test_numbers_from_text(spark):
    got = one(spark, scalar.money(F.lit("Rs 1,20,000")).alias("a"), scalar.money(F.lit("nil")).alias("b"), scalar.money_units(F.lit("Rs 1.5 Cr")).alias("c"), scalar.decimal_value(F.lit("x -7.3%")).alias("d"), scalar.digits_value(F.lit("1,234")).alias("e"), scalar.csv_field(F.lit('a,"b"')).alias("f"))
    assert list(got) == [120000, 0, 15000000, -7.3, 1234, '"a,""b"""']


def test_clock(spark):
    now, then = F.lit("2024-01-02 00:00:00").cast("timestamp"), F.lit("2024-01-01 22:30:00").cast("timestamp")
    assert list(one(spark, scalar.age_text(then, now).alias("a"), scalar.is_fresh(then, now).alias("b"), scalar.day_index(now).alias("c"))) == ["1h ago", False, 19724]


def test_shuffle_is_a_permutation(spark):
    items = list(range(10))
    got = one(spark, scalar.shuffled(F.array(*[F.lit(i) for i in items]), F.lit(20000)).alias("a"))["a"]
    s, want = 20000, items[:]
    for i in range(9, 0, -1):
        s = (s * 1664525 + 1013904223) % 2**32
        j = int(s / 2**32 * (i + 1))
        want[i], want[j] = want[j], want[i]
    assert got == want


def test_profile_edges(spark):
    cases = {"Post Graduate": 3, "PG Diploma": 3, "Graduate Professional": 2, "12th Pass": 1, "10th Pass": 1, "Literate": 0, "": 0, "PhD": 4, "Not declared": 0}
    df = spark.createDataFrame([(e, t) for e, t in cases.items()], "e string, t int")
    assert df.where(profile.education_tier(F.col("e")) != F.col("t")).count() == 0
    got = one(spark, profile.integrity(F.lit(9), F.lit("PhD"), F.lit("u")).alias("a"), profile.asset_bucket(F.lit(9_999_999)).alias("b"), profile.final_score(F.lit(50), F.lit(75)).alias("c"))
    assert list(got) == [65, "Medium", 60]
