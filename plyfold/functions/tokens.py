"""Token estimate: a word costs a token per 5 letters, a run of digits one per 3, any other character one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: words with the space before them, numbers, any other character.
PIECE = r" ?[a-zA-Z]+|[0-9][0-9.eE+-]*|(?s:.)"


def estimate_tokens(text: Column) -> Column:
    """0 for an empty or null text, else 1 at least; whole texts, inside the JVM."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))

    def cost(p: Column) -> Column:
        word = F.ltrim(p)
        return F.when(p.rlike("[a-zA-Z]$") & p.rlike("^ ?[a-zA-Z]"), F.ceil(F.length(word) / 5)).when(p.rlike("^[0-9]"), F.ceil(F.length(p) / 3)).otherwise(1).cast("long")

    total = F.aggregate(pieces, F.lit(0).cast("long"), lambda t, p: t + cost(p))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), total))


def exact_count(text: str, vocabulary: str) -> int:
    """Tokens of one text by a tokenizer file."""
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False).ids)


def exact_tokens(text: Column, vocabulary: str) -> Column:
    """Tokens by a tokenizer file, whose text goes to the executors with the plan: no estimate, but a Python function. Null text has none."""
    from pathlib import Path

    rules = Path(vocabulary).read_text()

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        encode = Tokenizer.from_str(rules).encode
        for texts in batches:
            yield texts.map(lambda x: 0 if x is None else len(encode(x, add_special_tokens=False).ids))

    return run(text)


def dictionary_tokens(text: Column) -> Column:
    """The dictionary's cost of a value: a token per 4 characters, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")
