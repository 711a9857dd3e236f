"""Tables of edge cases for the operator tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, texts: list[tuple[int | None, str | None]], extra: bool = False) -> DataFrame:
    """A table of documents; extra: with further columns whose names the operators might use themselves."""
    rows = [(i, t, None, "web", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("row", "key", "fp", "words", "hash", "id", "node", "root", "u", "v", "hits", "label", "score", "spans", "low", "kinds", "x", "__row", "__part", "__kinds", "__text", "__key_id", "__key_hash", "text_hash"):
            df = df.selectExpr("*", f"'other' AS {name}")
    return df


LONG = " ".join(f"word{i * i % 977} and{i % 13}" for i in range(60_000))
TEXTS: list[tuple[int | None, str | None]] = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "one two"),
    (6, "A plain sentence that nobody minds, with 3 numbers: 1, 22 and 333."),
    (7, "A plain sentence that nobody minds, with 3 numbers: 1, 22 and 333."),
    (7, "A plain sentence that nobody minds, with 3 numbers: 1, 22 and 333."),
    (None, "a row without an id"),
    (8, "Ünïcode — ÇA VA? 你好 мир 🙂 \U0001d4d0 <|endoftext|> it's"),
    (9, LONG),
    (10, LONG + " tail"),
]
