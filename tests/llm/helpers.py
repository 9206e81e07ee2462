"""Small fixtures and brute-force versions for the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    """A documents table of (id, text) pairs or texts."""
    rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "web", len(t) if t is not None else None) for i, t in rows], DOCUMENT)


def clashing(df):
    """The table with extra columns under the names that the operators use inside."""
    from pyspark.sql import functions as F

    names = ["fp", "key", "cell", "node", "part", "row", "ids", "length", "rank", "content", "hash", "spans", "component_id", "_n", "_cut", "uid", "copies"]
    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})


def prose(words: int, seed: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(pick.randint(2, 9))) for _ in range(words))


def groups(n: int, links) -> list[int]:
    """The least member of each item's group."""
    label = list(range(n))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in links:
        a, b = top(i), top(j)
        label[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def empty(spark, schema: str):
    return spark.createDataFrame([], T._parse_datatype_string(schema))
