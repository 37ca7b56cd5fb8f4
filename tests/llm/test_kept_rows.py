"""Near-duplicate groups keep one row each, whatever their ids."""

import pytest

from meshloom.llm import simhash

A, B, C, D = ("alpha beta gamma delta one", "red green blue yellow two", "north south east west three", "spring summer autumn winter four")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(None, A), (None, B)], [(None, A), (None, B)]),
        ([(1, A), (None, A)], [(1, A)]),
        ([(1, A), (None, A), (None, B)], [(1, A), (None, B)]),
        ([(5, A), (5, B), (9, B)], [(5, A), (5, B)]),
        ([(None, A), (None, A), (None, B), (3, C), (3, C), (3, D)], [(None, A), (None, B), (3, C), (3, D)]),
    ],
)
def test_one_row_of_each_group(spark, rows, want):
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))
