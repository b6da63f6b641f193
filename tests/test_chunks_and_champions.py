"""Markdown chunks, and the log of champions."""

import pytest

from panelwright.operators import champions as C
from panelwright.operators import chunking as K


def test_sections_follow_headings_outside_of_fences():
    text = "intro\n# Guide\n\n## Empty\n### Child\nbody of child\n```\n# no heading\n~~~\n```\n## Next ##\nmore\n# Last\n\n"
    assert list(K.sections(text)) == [("", "intro"), ("Guide > Empty > Child", "body of child\n```\n# no heading\n~~~\n```"), ("Guide > Next", "more")]
    assert list(K.sections("")) == [] and list(K.sections("#hash is no heading")) == [("", "#hash is no heading")]


def test_chunks_are_bounded_and_packed():
    long = " ".join(f"w{i}." if i % 9 == 0 else f"w{i}" for i in range(700))
    text = f"# A\nfew words [here](https://x.y) and **there**\n## B\nsome more\n## C\n{long}\n## D\n{'x ' * 500}"
    found = K.chunks(text, 30, 100)
    sizes = [c["words"] for c in found]
    assert max(sizes) <= 100 and sizes == [len(c["text"].split()) for c in found]
    assert all(a >= 30 or a + b > 100 for a, b in zip(sizes, sizes[1:]))
    assert found[0]["title"].startswith("A; A > B") and "https" not in found[0]["text"] and "**" not in found[0]["text"]
    words = " ".join(c["text"] for c in found).split()
    assert words == K.plain("few words [here](https://x.y) and **there** some more ").split() + long.split() + ["x"] * 500
    assert K.chunks(None) == [] and K.chunks(" \n ") == []


def test_chunked_column(spark):
    rows = spark.createDataFrame([(1, "# T\nbody of it"), (2, None), (3, "")], "id int, t string").select("id", K.chunked("t").alias("c")).orderBy("id").collect()
    assert [[tuple(c) for c in r["c"]] for r in rows] == [[("T", "body of it", 3)], [], []]


def test_promotion_reversal_and_rescoring(spark, tmp_path):
    folder, margins = str(tmp_path / "reg"), {"val": 0.01, "flash": 0.02}
    decide = lambda entry, config, gains, ece=0.05, same=True: C.decide(spark, folder, "y", entry, config, gains, margins, ece, 0.05, same)
    champion = lambda: C.champions(C.decisions(spark, folder)).first()["entry"]
    assert decide("e1", "a", {})  # the first
    assert not decide("e2", "b", {"val": 0.02, "flash": -0.001})  # loses a block
    assert not decide("e3", "b", {"val": 0.005, "flash": 0.0})  # clears no margin
    assert not decide("e4", "b", {"val": 0.02, "flash": 0.0}, 0.07)  # worse calibrated
    assert champion() == "e1" and decide("e5", "b", {"val": 0.02, "flash": 0.0}) and champion() == "e5"
    assert not decide("e6", "c", {}, same=False) and decide("e7", "b", {}, same=False) and champion() == "e7"
    assert C.revert(spark, folder, "y", "the rule was wrong") == "e1" and champion() == "e1"
    log = [(r["seq"], r["decision"], r["champion_before"]) for r in C.decisions(spark, folder).orderBy("seq").collect()]
    assert log[0] == (1, "promoted", None) and log[-1] == (8, "reverted", "e7") and len(log) == 8
    with pytest.raises(ValueError):
        C.revert(spark, folder, "z", "none")


def test_sealed_runs(spark, tmp_path):
    folder = str(tmp_path / "seals")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    C.seal(rows, folder, "r1")
    C.seal(rows.where("k = 1"), folder, "r2")
    assert C.is_intact(rows.repartition(3).orderBy("v"), folder, "r1") and C.is_intact(rows.where("k = 1"), folder, "r2")
    assert not C.is_intact(rows.where("k = 1"), folder, "r1") and not C.is_intact(rows, folder, "r3")
    with pytest.raises(ValueError):
        C.seal(rows, folder, "r1")
