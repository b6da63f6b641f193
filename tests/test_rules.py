"""Text rules on samples."""

import math

import pytest
from pyspark.sql import functions as F

from panelwright.functions import rules as R


def of(spark, rule, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", rule(F.col("t")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_free_text(spark):
    got = of(spark, R.free_text, "Status as on 01/2020: the work  is slow", "Remarks: nil report", "two words", None, "status AS on 12/2021 : a b c")
    assert got == ["the work is slow", None, None, None, "a b c"]


@pytest.mark.parametrize(
    "text, lo, hi",
    [("5 to 40 ha", 5, 40), ("more than 5 ha", 5, math.inf), ("up to 40 ha", 0, 40), ("above 5 ha and up to 40 ha", 5, 40), ("> 1.5", 1.5, math.inf), ("<=5", 0, 5), ("not exceeding 5", 0, 5), ("any", 0, math.inf), (None, 0, math.inf), ("5 ha - 40 ha", 5, 40)],
)
def test_interval(spark, text, lo, hi):
    (got,) = of(spark, R.interval, text)
    assert (got["lo"], got["hi"]) == (lo, hi)


def test_persons_numbers_and_keys(spark):
    assert of(spark, R.names_a_person, "Shri Ram Lal said", "met Dr. Anna", "dr of works", "the Mrs of", "(Smt Élise)", None) == [True, True, False, False, True, False]
    form = r"FP\s*/\s*\w+/\w+/[0-9]+/[0-9]{4}"
    assert of(spark, lambda t: R.numbers_of_form(t, form), "see fp / AB/RD/12/2019 and FP/CD/RD/7/2020, FP/AB/RD/12/2019", "none", None) == [["FP/AB/RD/12/2019", "FP/CD/RD/7/2020"], [], []]
    assert of(spark, R.name_key, " Jammu  & Kashmir", "JAMMU AND KASHMIR", "U.P.", None) == ["JAMMU AND KASHMIR", "JAMMU AND KASHMIR", "UP", None]


def test_labels(spark):
    aliases = {"orissa": "Odisha", "odisha": "Odisha", "bihar": "Bihar", "uttar pradesh": "Uttar Pradesh", "uttarakhand": "Uttarakhand", "uttaranchal": "Uttarakhand"}
    got = of(spark, lambda t: R.label(t, aliases), "Orissa", "Bihar, Orissa", "Odisha / orissa", "unknown", "Uttar Pra", "Uttar", "uttara", "bih", "", None, "Bihar & elsewhere")
    assert got == ["Odisha", "Multi", "Odisha", None, "Uttar Pradesh", None, "Uttarakhand", None, None, None, None]


def test_last_date(spark):
    day = F.lit("2020-06-30").cast("date")
    got = of(spark, lambda t: R.last_date(t, day), "sought on 01-02-2020; replied 03/04/2020, next 2020-07-01", "31-02-2020", "", None, "2019-12-31")
    assert [str(d) for d in got] == ["2020-04-03", "None", "None", "None", "2019-12-31"]


def test_completed_labels(spark):
    labels = spark.createDataFrame([("green iron",), ("green ivory",), ("blue",), ("abc",), ("green iron",)], "l string")
    clips = spark.createDataFrame([(i, c) for i, c in enumerate(["green ir", "green i", "blue", "abc", "xxxx", None, "green ivory", "blu"])], "i int, c string")
    got = {r["i"]: r["label"] for r in R.completed(labels, clips, "l", "c").collect()}
    assert got == {0: "green iron", 1: None, 2: "blue", 3: None, 4: None, 5: None, 6: "green ivory", 7: None}
