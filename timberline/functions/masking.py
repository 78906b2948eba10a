"""Template masking: variable parts of a message become ``<NAME>`` marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions import patterns as P
from timberline.functions.text import strip, words

# Every alternative starts with one of these characters; the look-ahead lets the
# matcher pass over all other positions at once.
ANY_MASK = P.uni(r"(?=[/rR0-9a-fA-F\d])(?:" + "|".join(pattern for _, pattern in P.MASKS) + ")")
FENCE = "\x01"


def mask_pieces(message: Column) -> Column:
    """The message cut at its variable parts: text, param, text, param, ..., text.

    One scan fences the params, a plain split takes the fences apart. A message
    that holds the fence character itself is cut by matching twice instead.
    """
    fenced = F.split(F.regexp_replace(message, ANY_MASK, f"{FENCE}$0{FENCE}"), FENCE, -1)
    gaps = F.split(message, ANY_MASK, -1)
    params = F.regexp_extract_all(message, F.lit(ANY_MASK), F.lit(0))
    twice = F.flatten(
        F.zip_with(gaps, params, lambda gap, param: F.when(param.isNull(), F.array(gap)).otherwise(F.array(gap, param)))
    )
    return F.when(message.contains(FENCE), twice).otherwise(fenced)


def params_of(pieces: Column) -> Column:
    """Masked-out texts in order of occurrence."""
    return F.filter(pieces, lambda _, at: at % 2 == 1)


def _mark(param: Column) -> Column:
    """The mark of one masked-out text.

    What the alternatives can match is told apart by first characters and dots;
    only a bare word needs the look at its digits.
    """
    return (
        F.when(param.startswith("/"), "<PATH>")
        .when(param.startswith("blk_"), "<BLOCK>")
        .when(param.startswith("req-"), "<REQ>")
        .when(param.startswith("R"), "<NODE>")
        .when(param.startswith("0x"), "<HEX>")
        .when(param.contains("."), "<IP>")
        .when((F.length(param) >= 8) & param.rlike("^[0-9a-fA-F]+$"), "<HASH>")
        .otherwise("<NUM>")
    )


def masked_text(pieces: Column) -> Column:
    """The message with every param replaced by its mark."""
    return F.array_join(
        F.transform(pieces, lambda piece, at: F.when(at % 2 == 1, _mark(piece)).otherwise(piece)), ""
    )


def mask_tokens(masked: Column) -> Column:
    return words(strip(masked))


def template_of(tokens: Column) -> Column:
    """The masked tokens as one text (one template per masked text)."""
    return F.when(F.size(tokens) == 0, P.EMPTY_TEMPLATE).otherwise(F.array_join(tokens, " "))


def template_id_of(template: Column) -> Column:
    """First ten hex digits of the md5 of the founding text."""
    return F.when(template == P.EMPTY_TEMPLATE, P.EMPTY_TEMPLATE_ID).otherwise(
        F.substring(F.md5(template), 1, 10)
    )


def is_mark(token: Column) -> Column:
    return token.startswith("<") & token.endswith(">")


def template_steps(message: str = "message") -> list[Column]:
    """``params, template, template_id`` (one template per masked text)."""
    return [
        mask_pieces(F.col(message)).alias("_pieces"),
        mask_tokens(masked_text(F.col("_pieces"))).alias("_tokens"),
        template_of(F.col("_tokens")).alias("template"),
        template_id_of(F.col("template")).alias("template_id"),
        params_of(F.col("_pieces")).alias("params"),
    ]
