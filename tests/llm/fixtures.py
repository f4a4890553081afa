"""A small table of documents with everything that may go wrong, and one of real prose."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the river ran past mills and quiet fields while old boats waited for spring under grey skies near stone bridges".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", ","]) for _ in range(n))


def rows():
    """Nulls, empty and blank texts, ties, repeated rows, near copies, shared passages, a very long text."""
    shared = prose(1, 40)
    base = prose(2, 150)
    found = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n\x0b", "en", "a", 4), (3, "!!! 123 ...", None, "a", 11)]
    found += [(4, base, "en", "a", 1), (5, base, "en", "b", 1), (5, base, "en", "b", 1), (6, base.replace("river", "brook", 1), "en", "a", 1)]
    found += [(7, prose(3, 80) + " " + shared + " " + prose(4, 60), "en", None, 1), (8, prose(5, 30) + " " + shared + " " + prose(6, 30), None, "a", 1)]
    found += [(9, "żółć été größe ñandú " + prose(7, 60), "fr", "a", 1), (10, prose(8, 9000), "de", "c", 1), (None, prose(9, 120), "en", "a", 1)]
    found += [(11, "ab " * 400, "en", "a", 1), (12, "ONE two.\nONE two.\n\nONE two.\n", "en", "a", 1), (13, "a" * 1200, "en", "a", 1)]
    found += [(20 + k, prose(100 + k, 60 + k), ["en", "de"][k % 2], "d", 1) for k in range(30)]
    return found


def documents(spark, n=None):
    return spark.createDataFrame(rows()[:n], SCHEMA)


def clashing(docs):
    """docs with columns named like those that the operators make."""
    names = "stats row key fp h doc a r s n loc kind block word i bag text_ path cls rank base offset sequence_id kept component_id _id _h _kept label".split()
    return docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
