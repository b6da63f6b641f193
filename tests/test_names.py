"""Road numbers and canonical names: empty, tagged and ambiguous texts."""

from pyspark.sql import functions as F

from panelwright.functions import text as T


def answers(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("s"))).collect()]


def test_road_ids(spark):
    texts = [None, "", "NH 4 and NH-04, nh.17a", "new NH 53 of NH 6", "old NH 5", "OLD NH 5 / NEW NH 16 / NEW NH 2", "NHAI 12", "NH 0"]
    assert answers(spark, texts, T.road_ids) == [None, None, "17A;4", "53", None, "16;2", None, None]


def test_is_linear(spark):
    rows = spark.createDataFrame([("Roads", "station"), ("Rail", "station"), ("Rail", None), (None, "new line"), (None, None), ("Steel", "plant")], "g string, n string")
    got = rows.select(T.is_linear(F.col("g"), F.col("n"), ["Roads"], ["Rail"], "line", "station").alias("l")).collect()
    assert [r.l for r in got] == [True, False, True, True, False, False]


def test_canonical(spark):
    aliases = {"COAL FIELDS": "CF", "COAL FIELDS NORTH": "CFN"}
    texts = [None, " ", "N.A.", "The Coal Fields Ltd", "CF", "coal fields north unit", "Coal Fields East", "City Metro Corp (CMC)", "(CMC)", "CF for Unit 2", "XY for Unit 2", "A & B Ltd III"]
    got = answers(spark, texts, lambda s: T.canonical(s, aliases, ("LTD", "THE"), ("N A",)))
    assert [(r.name, r.rule) for r in got] == [
        (None, "missing"), (None, "missing"), (None, "invalid"), ("CF", "alias"), ("CF", "alias"), ("CFN", "alias_prefix"), ("CF", "alias_prefix"),
        ("CMC", "bracket"), ("CMC", "normalised"), ("CF", "prefix"), ("XY FOR UNIT 2", "normalised"), ("A AND B", "normalised"),
    ]
