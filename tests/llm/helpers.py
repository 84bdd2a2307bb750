"""Documents with every odd case, and plain versions of the operators."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string"


def corpus(n=60, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    line = lambda: " ".join(word() for _ in range(r.randrange(4, 14)))
    passage = "\n".join(line() for _ in range(8))
    rows = []
    for i in range(n):
        body = [line() for _ in range(r.randrange(1, 12))]
        if i % 4 == 1:
            body.insert(r.randrange(len(body) + 1), passage)
        rows.append((i * 7 + 3, "\n".join(body)))
    rows += [(1000, rows[0][1]), (1001, rows[1][1] + " tail"), (1002, rows[1][1]), (1003, rows[5][1].replace("a", "b", 1))]
    rows += [(2000, None), (2001, ""), (2002, " \n\n \n"), (2003, "one"), (2004, "é ünï 正文"), (2005, "x" * 3000), (2006, "\n".join(["same line"] * 9)), (2007, "a  b \n c\t d")]
    return rows


def frame(spark, rows, clash=()):
    """The rows, with further columns of the given names."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in clash})


def long_texts():
    """Documents of several MB: prose, one line without spaces, and a copy of the prose with one word more."""
    r = random.Random(9)
    prose = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) + r.choice(["", "", ",", ".\n", "é"]) for _ in range(500_000))
    return [(1, prose), (2, "0123456789ab正" * 60_000), (3, prose + " more"), (4, "short")]


def components(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low
