"""A gate reads what a profile declares once, not for every row, and evaluates each part of a posting once."""

from pyspark.sql import functions as F

from tarn.functions.text import ascii_text, clean_list, keywords, place_text, terms
from tarn.operators import gates

ODD = ["", " ", "a", "Ünï Code", " x ", "U.S.A.", "d'Or", "a  b,", "İstanbul", "KK"]
PROFILE = gates.Profile(
    title_keywords="red, Gear;  ; U.S.A.\n", locations_include=(" U.S.A. ", "", "Nation 1"), locations_exclude=(" ", "d'Or"), compensation="x", compensation_min=20_000,
    negative_keywords=" Old , ,İ\nb",
)


def test_parts_are_evaluated_once(spark):
    df = spark.createDataFrame([("red", "x", "$5K")], "t string, l string, c string").select(gates.pre_filter(F.col("t"), F.col("l"), F.col("c"), PROFILE).alias("v"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("hourly") <= 1 and "split(" not in plan


def test_profiles_are_normalised_as_columns_are(spark):
    one = spark.range(1)
    said = one.select(*[F.array(*[f(F.lit(x)) for x in ODD]) for f in (ascii_text, place_text)], terms(F.lit(PROFILE.title_keywords)), keywords(F.lit(PROFILE.negative_keywords)), clean_list(F.array(*map(F.lit, ODD)))).first()
    assert said[0] == [gates._ascii(x) for x in ODD]
    assert said[1] == [gates._ascii("".join(c for c in x.lower() if c not in ".'’")) for x in ODD]
    assert said[4] == [t for t in map(gates._stripped, ODD) if t] and said[2] == ["red", "gear", "u s a"] and said[3] == ["old", "i̇", "b"]
