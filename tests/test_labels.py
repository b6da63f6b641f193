"""Rule tables against what they say, one case a line."""

from pyspark.sql import functions as F

from panelwright.functions import labels as L

PLACES = {"GOA": "Goa", "ORISSA": "Odisha", "ODISHA": "Odisha", "TAMILNADU": "Tamil Nadu"}
WRAPPER = r"(?i)^MULTI[\s-]*STATES?\s*\((.*)\)$"


def one(spark, rows, column, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_places(spark):
    cells = [" goa ", "Orissa", "Tamil  Nadu", "PAN India", "Goa, Orissa, Odisha", "Multi-State (Odisha, Goa)", "Goa, Mars", "Multi State (Goa)", "", None, ",", "Goa,"]
    told = one(spark, [(c,) for c in cells], L.place_label(F.col("t"), PLACES, {"PANINDIA": "PAN India"}, "Multi", "None given", WRAPPER))
    assert [tuple(t) for t in told] == [
        ("Goa", "", ""), ("Odisha", "", "alias"), ("Tamil Nadu", "", "alias"), ("PAN India", "", ""), ("Multi", "Goa;Odisha", ""), ("Multi", "Goa;Odisha", ""),
        ("None given", "", "unrecognised"), ("None given", "", "unrecognised"), ("", "", ""), ("", "", ""), ("", "", ""), ("Goa", "", "alias"),
    ]


def test_the_first_rule_wins(spark):
    rules = [L.Rule("coal_lignite", {"s": "^Coal$", "i": "lignite"}), L.Rule("coal_total", {"s": "^Coal$", "i": "^total"}, {"i": "others"}), L.Rule("any_total", {"i": "^total"})]
    rows = [("Coal", "total lignite"), ("Coal", "total"), ("Coal", "total, others"), ("Steel", "total"), ("Coal", None), (None, "total")]
    got = one(spark, rows, L.first_rule({"s": F.col("s"), "i": F.col("i")}, rules), "s string, i string")
    assert got == ["coal_lignite", "coal_total", "any_total", "any_total", None, "any_total"]
    assert one(spark, rows[:1], L.first_rule({"s": F.col("s")}, []), "s string, i string") == [None]


def test_all_flags_in_order(spark):
    table = [("truncated", "cut"), (r"(\d{4}-\d{2}) figures", "repeat:{}"), (r"copy of (\S+\.pdf)", "copy:{}")]
    notes = ["copy of a.pdf; 2020-01 figures, 2019-12 figures, 2020-01 figures; truncated truncated", "fine", "", None]
    assert one(spark, [(n,) for n in notes], L.flags(F.col("t"), table)) == [["cut", "repeat:2020-01", "repeat:2019-12", "copy:a.pdf"], [], [], []]


def test_shapes(spark):
    rows = [("Roads", "Port Road"), ("Rail", "line to a mine"), ("Rail", "station"), ("Rail", None), ("Power", "plant"), ("Power", "transmission line plant"), (None, "mine"), ("Coal", "line")]
    shape = L.shape(F.col("s"), F.col("n"), r"\bline\b", "station|plant|Port", ("Rail",), ("Roads",))
    assert one(spark, rows, shape, "s string, n string") == ["Linear", "Linear", "Non-Linear", "Linear", "Non-Linear", "Linear", "Non-Linear", "Linear"]
    assert one(spark, rows, L.of_kind(F.col("s"), F.col("n"), "Coal", "mine", shape == "Linear"), "s string, n string") == [False, False, False, False, False, False, True, True]
