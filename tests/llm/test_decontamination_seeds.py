"""Edited copies of an item stay searchable, however many documents hold them."""

import random

import pytest
from test_operators import make, prose

from tessera.llm import decontamination


@pytest.mark.parametrize("whole", [0, 30])
def test_many_edited_copies_are_found(spark, whole):
    item = prose(random.Random(1), 20).split()
    copy = " ".join(f"other{i}" if i in (3, 7, 11, 15) else w for i, w in enumerate(item))
    docs = make(spark, [copy] * 60 + [" ".join(item)] * whole + ["nothing of the kind"])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = decontamination.find_leaks(docs, bench).collect()
    assert {r.doc_id for r in found} == set(range(60 + whole)) and {r.score for r in found if r.doc_id < 60} == {0.7}
    assert [r.doc_id for r in decontamination.drop_leaks(docs, bench).collect()] == [60 + whole]
