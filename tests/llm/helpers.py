"""Small documents with every awkward case, and brute-force twins."""

import hashlib

from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(n, salt=0):
    return " ".join(WORDS[(i * i + salt * 7 + i * salt) % len(WORDS)] + str((i * 31 + salt) % 97) for i in range(n))


def awkward():
    """(doc_id, text): nulls, empties, blanks, copies, ties, repeated rows and ids, a long text, odd characters."""
    base = text(60, 1)
    return [
        (1, base), (2, base), (3, text(60, 2)), (3, text(60, 2)), (4, text(40, 3)), (4, text(40, 4)), (5, None), (6, ""), (7, " \t\n "),
        (None, "a row without an id " + text(40, 5)), (None, None), (8, base.upper()), (9, "one two"), (10, text(20_000, 6)),
        (11, text(10, 7) + " " + base + " " + text(10, 8)), (12, "éàü 漢字 🙂   x y"), (13, base), (14, base.replace("alpha", "Alpha", 1)),
    ]


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if not extra:
        return df
    names = ["id", "key", "score", "spans", "rest", "body", "fp", "root", "chunk", "shard", "doc_key", "host", "verdict"]
    return df.select("doc_id", *[F.lit(i).alias(n) for i, n in enumerate(names)], "text", F.lit("en").alias("lang"))


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def rows(df, *cols):
    got = [tuple(r) for r in df.select(*cols).collect()]
    return sorted(got, key=repr)
