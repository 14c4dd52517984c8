from __future__ import annotations

import random

import pytest
from llm_rows import LONG, prose


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    some = [(i, prose(rng, rng.randint(5, 60))) for i in range(20)]
    return [*some, some[3], some[3], (3, "another text under the id of an earlier row"), (30, None), (31, ""), (32, " \n\t "), (33, LONG), (34, LONG + "x"),
            (None, some[4][1]), (None, None), (35, some[5][1], None, None), (36, some[5][1], None, "s"), (37, "?!…", "fr", None)]
