"""Every language in the table is learnt, however many there are."""

from pyspark.sql import functions as F

from meshloom.llm import bytecnn


def test_no_language_is_left_out(spark):
    rows = [(3 * k + i, f"{chr(0x4E00 + k) * 12} {i}", f"l{k:02}") for k in range(70) for i in range(3)]
    net = bytecnn.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert net.langs == [f"l{k:02}" for k in range(70)]


def sampled(spark, monkeypatch, rows):
    """Windows by language that the network is trained on."""
    seen = {}

    def train(self, windows, y, **_):
        seen.update({lang: int((y == k).sum()) for k, lang in enumerate(self.langs)}, texts=len(windows))

    monkeypatch.setattr(bytecnn.Net, "train", train)
    bytecnn.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), F.lit(True))
    return seen


def test_an_id_with_many_rows_is_sampled_like_others(spark, monkeypatch):
    """A third of all rows under one id, whatever its hash, or under null: 400 texts of each language, six windows at most each."""
    for hot in (7, 8, 9, None):
        rows = [(hot, f"hot text number {i} of them all", "aa") for i in range(1500)] + [(100 + i, f"andere Worte {i}", "bb") for i in range(1500)] + [(3, "the same text again", "cc")] * 1500
        seen = sampled(spark, monkeypatch, rows)
        assert seen["aa"] == seen["bb"] == bytecnn.SAMPLE_DOCS and seen["cc"] == 1


def test_a_letter_that_the_windows_miss_is_learnt(spark, monkeypatch):
    rows = [(i, "0" * 5000 + "x" + "1" * 5000, "aa") for i in range(3)] + [(9, "words here", "bb")]
    assert sampled(spark, monkeypatch, rows) == {"aa": 3, "bb": 1, "texts": 4}
