"""Small tables with every awkward row, and plain references."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0D]+")
#: Names that the operators use inside.
CLASHES = ["r", "rid", "_rid", "id", "t", "fp", "n", "u", "w", "size", "taken", "g1", "x0", "h", "i", "g", "m", "kept", "q", "open",
           "text_", "body", "ln", "gram", "dup", "mcd", "cut", "had", "place", "pat", "host", "rules", "copy", "rest", "v", "shard", "f",
           "a.b", "with space"]


def words_of(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def awkward_docs(spark, extra=True):
    """Null ids, texts, languages and sources; empty, blank and very long texts; copies and repeated rows."""
    long = prose(1, 60_000, 5000)
    base = prose(2, 120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, " \t\n ", "de", "b"),
        (6, long, "en", "a"), (None, base + " tail of its own", None, None), (None, None, None, None), (7, "one", "en", "c"), (8, "one two", "en", "c"),
        (9, "one two three", "en", "c"), (10, "\n".join(["same line here"] * 30), "en", "a"), (11, prose(3, 80) + " # $ % & | < > *", "en", "b"),
        (12, "é" * 5 + " ünï 　 wide space", "fr", "b"), (13, prose(4, 70) + " " + base, "en", "é")]
    rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for k, c in enumerate(CLASHES):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(k))
    return df


def empty_like(df):
    return df.where("false")
