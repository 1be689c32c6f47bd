"""Awkward rows that every operator must take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = "The house of the old man was on the hill, and the road to it was long. "
LONG = " ".join(f"word{i % 977} of the {i % 31} stone" for i in range(20_000))
GIANT_WORD = "abcdé" * 12_000

TEXTS = [
    None,
    "",
    " \t\r\n ",
    "One",
    "two words",
    PROSE * 3,
    PROSE * 3,
    PROSE * 3 + "An end.",
    LONG,
    GIANT_WORD,
    "日本語のテキスト 🙂 naïve Ｆｕｌｌ",
    "a\x00b \x1c c\x85d\xa0e f <s> <|endoftext|> <|ENDOFTEXT|> ▁x",
    "Licensed under CC BY-NC 4.0. All rights reserved. all RIGHTS reserved",
    "for for for for for " * 50,
    "table | cell | cell | cell",
]


def rows() -> list[tuple]:
    found = [
        (i, text, "en" if i % 3 else None, f"src{i % 3}" if i % 4 else None, len(text or ""))
        for i, text in enumerate(TEXTS)
    ]
    found += [(None, "a text without a key", None, None, None), (None, None, None, None, None)]
    found += [found[5], found[5], (3, "another text of key three", "en", "src0", 1)]
    return found


#: Names that operators give to columns of their own.
CLASHES = """
bits fingerprint component_id sigs sig size place copies taken target whole cut range seq key ids score
predicted labels n_tokens n_words digest shard slot total first last rank members id vec bucket found
""".split()


def documents(spark: SparkSession) -> DataFrame:
    """All rows, with columns that clash with what operators add."""
    docs = spark.createDataFrame(rows(), SCHEMA)
    return docs.withColumns({name: F.lit("clash") for name in CLASHES})


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def random_texts(draw, n: int) -> list[str]:
    """Texts whose joints matter to tokenizers."""
    bits = ["a", "B", " ", "  ", "\n", "\t", "'", "'s", "'LL", "é", "E", "́", "日本", "1", "23"]
    bits += ["!", "_", " ", " ", "the", "\x1c", "H", "̱", "İ", "I", "̇", "ẞ", "…", "don't"]
    bits += ["🙂", "\x0b", "\x85", " ", "　", "​", "Σ", "ς", "<|endoftext|>", "▁", "<s>"]
    return ["".join(draw.choice(bits) for _ in range(draw.randint(0, 80))) for _ in range(n)]
