"""The steps of decontamination on a text: words for marks, a hash for each window of five words."""

from pyspark.sql import functions as F

from pagedrift.llm import decontaminate


def test_marks_are_blanks_and_stay_within_numbers(values):
    texts = ["a. 1.5 x,2 3,4 .5 5. 1.2.3,4", "A-b [c] ^d& \\e `f~ \"g\" {h}|i<j>k/l_m*n#o+p=q(r)!?;:'", ""]
    marks = decontaminate.MARKS
    old = lambda t: F.translate(
        F.regexp_replace(t, r"(?<=[0-9])[.,](?=[0-9])", "·"), marks, " " * len(marks))
    rows = [(t,) for t in texts]
    assert values(decontaminate.plain, rows, ["string"]) == values(old, rows, ["string"])


def test_a_word_is_hashed_once_for_its_five_windows(spark):
    rows = spark.createDataFrame([(n, t.split()) for n, t in enumerate(
        ["a b c d e f g", "x b c d e f y", "a b c d", "a b c d e"])] + [(4, [])], "n int, words array<string>")
    found = rows.select("n", decontaminate.windows(F.col("words")).alias("h"))
    # Before, each window took its five words out of the text and hashed them anew.
    assert "xxhash64(slice" not in found._jdf.queryExecution().analyzed().toString()
    h = {r["n"]: r["h"] for r in found.collect()}
    assert [len(h[n]) for n in range(5)] == [3, 3, 0, 1, 0]
    assert len(set(h[0])) == 3 and h[1][1] == h[0][1] and h[1][0] != h[0][0] and h[3][0] == h[0][0]
