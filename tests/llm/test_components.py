import random

import pytest

from offerlens.llm.components import components
from offerlens.llm.scratch import Scratch
from tests.llm.conftest import closure


@pytest.mark.parametrize("edges", [
    [], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(99, i) for i in range(30)],
    [(random.Random(i).randrange(60), random.Random(-i).randrange(60)) for i in range(1, 45)],
])
def test_against_closure(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df, Scratch(spark)).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == closure({x for e in real for x in e}, real)
