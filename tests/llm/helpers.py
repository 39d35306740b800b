"""Small corpora with the cases that every operator must stand: nulls, empty and long texts, ties, repeated rows, other columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abdeginorstu") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    return " ".join(words(seed, n))


def odd_rows() -> list[tuple]:
    """Null and empty texts, null ids, repeated rows, a null source, a text of one word."""
    return [
        (None, None, None, None, None),
        (None, "one two three", "en", "b", 13),
        (7, None, "en", "a", 0),
        (8, "", None, "a", 0),
        (9, " \n\t ", "en", None, 4),
        (10, "single", "en", "a", 6),
        (11, "twice the same row", "en", "a", 18),
        (11, "twice the same row", "en", "a", 18),
    ]


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, None, None)[:5] for r in rows], DOCS)


def with_clashing_columns(df):
    """Names that operators use themselves."""
    names = ["name", "id", "twin", "score", "target", "size", "taken", "key", "band", "label", "spans", "terms", "term", "start", "end", "value", "kind", "component", "root", "lang_pred", "source_size", "epochs", "anchor", "class_id", "n_links", "item_id", "width", "host", "__id", "__hash", "__size", "__part", "__mark", "__of", "__terms", "__h1"]
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(f"x-{n}").alias(n) for n in names))
