"""Text scalars as column expressions: token models, truncation, word sets, overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token per piece: a run of letters, up to three digits, or a run of other visible characters.
PIECE = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"


def count_chars4(text: Column) -> Column:
    """Tokens at four characters each, rounded up."""
    return F.ceil(F.char_length(text) / 4).cast("bigint")


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def count_pieces(text: Column) -> Column:
    return F.size(pieces(text)).cast("bigint")


def cut_chars4(text: Column, budget: Column) -> Column:
    return F.substring(text, F.lit(1), (budget * 4).cast("int"))


def cut_pieces(text: Column, budget: Column) -> Column:
    short = F.array_join(F.slice(pieces(text), F.lit(1), budget.cast("int")), " ")
    return F.when(count_pieces(text) <= budget, text).otherwise(short)


#: Per model, how texts are counted and cut (None: the model can't cut).
TOKEN_MODELS: dict[str, tuple[Callable, Callable | None]] = {"chars4": (count_chars4, cut_chars4), "pieces": (count_pieces, cut_pieces)}


def register_token_model(name: str, count: Callable[[Column], Column], cut: Callable[[Column, Column], Column] | None = None) -> None:
    """Let ``model=name`` count (and cut) texts by column functions, such as pandas UDFs around a tokenizer."""
    TOKEN_MODELS[name] = (count, cut)


def count_tokens(text: Column, model: str = "chars4") -> Column:
    """Tokens of a text; an unknown model falls back to chars4. Null text has null tokens."""
    return TOKEN_MODELS.get(model, TOKEN_MODELS["chars4"])[0](text)


def truncate(text: Column, budget: Column, model: str = "chars4") -> Column:
    """The text itself if it is within the budget, else its first ``budget`` tokens.

    Pieces are joined by blanks. An unknown model raises: a budget needs a model that can cut.
    """
    cut = TOKEN_MODELS.get(model, (None, None))[1]
    if cut is None:
        raise ValueError(f"unknown token model, or one that can't cut: {model}")
    return cut(text, budget)


def words(text: Column) -> Column:
    """Words between white space, punctuation kept."""
    return F.array_remove(F.split(text, r"\s+"), "")


def word_set(text: Column, lower: bool = True, first: int | None = None) -> Column:
    """Different words; with ``first``, of the first so many words (cut before repeats go)."""
    found = words(F.lower(text) if lower else text)
    return F.array_distinct(F.slice(found, 1, first) if first else found)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 where both sets are empty."""
    return F.coalesce(F.try_divide(overlap(a, b), F.size(F.array_union(a, b))), F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b isn't above 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def exact_mean(x: Column) -> Column:
    """Mean from a sum of decimals, which is the same in any order of the rows."""
    return F.sum(x.cast("decimal(38,12)")).cast("double") / F.count(x)
