"""Small tables with the awkward cases every corpus operator must handle."""

from __future__ import annotations

import random

WORDS = ("the of and to in is that for with was on are by this be from or an which we can has "
         "river stone garden window letter market engine planet copper silver winter summer").split()
#: Columns whose names clash with working names of operators.
SCHEMA = ("doc_id long, text string, id long, key long, kind string, words string, score double, "
          "lang string, _p string")


def prose(rng: random.Random, n: int, line: int = 12) -> str:
    words = [rng.choice(WORDS) + (str(rng.randrange(100)) if rng.random() < 0.3 else "")
             for _ in range(n)]
    return "\n".join(" ".join(words[i:i + line]) + "." for i in range(0, n, line))


def documents(spark, texts, first: int = 0):
    """texts: strings, or (doc_id, string) pairs for special ids."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(d, t, 7, 8, "x", "y", 0.5, None, None) for d, t in rows], SCHEMA)


def awkward(rng: random.Random) -> list:
    """Nulls, empty and white texts, a repeated row, ties, null ids, a very long text."""
    base = prose(rng, 60)
    return [(0, base), (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, base), (5, base),
            (None, base), (None, None), (6, base.upper()), (7, prose(rng, 6000)),
            (8, "naïve Ünïcode ﬁne 日本語 \u2028 x\x1cy"), (9, base + " tail")]
