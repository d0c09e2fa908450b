"""Small document tables with the awkward rows that every corpus operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int) -> str:
    vocabulary = ["the", "sun", "rose", "over", "quiet", "fields", "and", "nobody", "came", "to", "see", "it", "river", "Stone", "été", "groß"]
    return " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(words))


def awkward(n: int = 60, seed: int = 1) -> list[tuple]:
    """Rows with nulls in any column, empty and long texts, near and exact copies, and rows repeated whole."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice([1, 2, 3, 5, 40, 120]))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", "é", None]), len(text)))
    base = prose(rng, 400)
    for i in range(n, n + 12):
        words = base.split()
        words[rng.randrange(400)] = f"changed{i}"
        rows.append((i, " ".join(words), "en", "a", 1))
    rows += [(200, None, "en", "a", None), (201, "", None, None, 0), (202, "   \t\n", "en", "b", 5), (203, "one", "en", "b", 3)]
    rows += [(204, base, "de", "a", 1), (205, base, "de", "b", 1), (205, base, "de", "b", 1), (203, "one", "en", "b", 3)]
    rows += [(206, prose(rng, 30000), "en", "a", 1), (207, "x" * 5000, "en", "a", 1), (208, "12 34 ##", "en", "a", 8)]
    return rows


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        names = ["id", "key", "size", "fp", "component_id", "keep_id", "kept", "row_key", "rank", "target", "lang_pred", "score", "length", "part", "bucket"]
        names += ["__id", "__key", "__language", "__copies", "__Least", "__sum", "__nth", "s", "bits", "digests", "draw", "raw", "side", "cut_bin"]
        df = df.withColumns({c: F.lit(7) for c in names})
    return df
