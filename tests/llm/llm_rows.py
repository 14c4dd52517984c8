"""Documents with awkward rows for the tests in this folder."""

from __future__ import annotations

import random

LONG = "lorem ipsum dolor sit amet " * 6000
CLASHING = ["slot", "shard", "lang_pred", "n_words", "items", "removed", "n_shingles", "component_id", "kept", "ids", "accepted", "_lang", "labels", "score"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ta", "re", "no", "mi", "lu", "So", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def frame(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) as documents with columns that clash with every operator's own."""
    wide = [(*r, *("en", "s")[len(r) - 2:])[:4] for r in rows]
    return spark.createDataFrame([(*r, len(r[1] or ""), *("x" for _ in CLASHING)) for r in wide], SCHEMA)
