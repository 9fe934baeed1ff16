"""Claims with ``{column}`` holes, row-to-text columns and reply-reading columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.runtime import col, dtype_of

# A hole is one pair of single braces; doubled braces are literal text.
HOLE = r"(?<![{])[{]([^{}]*)[}](?![}])"


def holes(text: str) -> list[str]:
    """The column names in a claim, in order of appearance."""
    return re.findall(HOLE, text)


def distinct_holes(text: str) -> list[str]:
    return list(dict.fromkeys(holes(text)))


def holes_column(text: Column) -> Column:
    """The same for a column of claims."""
    return F.regexp_extract_all(text, F.lit(HOLE), F.lit(1))


def fill_claim(text: str) -> str:
    """Replace each hole by the label its column has in the row text."""
    filled = re.sub(HOLE, lambda m: m.group(1).capitalize(), text)
    return filled.replace("{{", "{").replace("}}", "}")


def _as_text(df: DataFrame, name: str) -> Column:
    value = col(name).cast("string")
    if isinstance(dtype_of(df, name), T.BooleanType):
        value = F.initcap(value)
    return F.coalesce(value, F.lit("nan"))


def row_text(df: DataFrame, names: list[str], labels: list[str] | None = None) -> Column:
    """``[Label]: «value»`` lines for the named columns, as one string column."""
    labels = labels or names
    parts: list[Column] = []
    for name, label in zip(names, labels):
        parts += [F.lit(f"[{label.capitalize()}]: «"), _as_text(df, name), F.lit("»\n")]
    return F.concat(*parts) if parts else F.lit("")


def pair_text(left: Column, right: Column) -> Column:
    """Left text and right text on separate lines; an empty side adds no line."""
    both = (left != "") & (right != "")
    return F.when(both, F.concat(left, F.lit("\n"), right)).otherwise(F.concat(left, right))


# --- reading replies -------------------------------------------------------


def explanation_of(reply: Column) -> Column:
    """Text between the ``Reasoning:`` line, if any, and the first ``Answer:``."""
    head = F.substring_index(reply, "Answer:", 1)
    start = F.instr(head, "Reasoning:\n")
    body = F.when(start > 0, F.substr(head, start + F.lit(len("Reasoning:\n")))).otherwise(head)
    return F.when(F.instr(reply, "Answer:") > 0, F.regexp_replace(body, r"\A\n+|\n+\z", ""))


def answer_of(reply: Column) -> Column:
    """Text after the first ``Answer:``; the whole reply when the mark is absent."""
    at = F.instr(reply, "Answer:")
    return F.when(at > 0, F.substr(reply, at + F.lit(len("Answer:")))).otherwise(reply)


def bool_of(answer: Column, on_error: str = "raise", default: bool = True) -> Column:
    """True when the answer says ``True``, else False when it says ``False``."""
    if on_error not in ("raise", "default"):
        raise ValueError("on_error is 'raise' or 'default'")
    if on_error == "raise":
        other = F.raise_error(F.concat(F.lit("cannot read True or False in reply: "), answer)).cast("boolean")
    else:
        other = F.lit(default)
    return (
        F.when(answer.contains("True"), F.lit(True))
        .when(answer.contains("False"), F.lit(False))
        .otherwise(other)
    )


def choice_of(reply: Column) -> Column:
    """1 or 2: the last ``Document N`` of a reply, or its last number."""
    # fixed value: the pattern that names a document
    named = F.regexp_extract_all(reply, F.lit(r"(?i)Document[\s*](\d+)"), F.lit(1))
    numbers = F.regexp_extract_all(reply, F.lit(r"(\d+)"), F.lit(1))
    last = F.coalesce(F.try_element_at(named, F.lit(-1)), F.try_element_at(numbers, F.lit(-1)))
    number = last.try_cast("int")
    return F.when(number.isin(1, 2), number).otherwise(
        F.raise_error(F.concat(F.lit("cannot read a document number in reply: "), reply)).cast("int")
    )


def list_of_bools(reply: Column, size: Column, on_error: str = "raise", default: bool = True) -> Column:
    """A batched reply such as ``[True, False]`` as an array of booleans.

    A reply whose length differs from the number of contexts is rejected, never
    shifted onto other rows.
    """
    words = F.from_json(F.lower(reply), "array<string>")
    read = F.transform(
        words, lambda w: F.when(w.contains("true"), F.lit(True)).when(w.contains("false"), F.lit(False))
    )
    usable = words.isNotNull() & (F.size(words) == size) & ~F.exists(read, lambda b: b.isNull())
    if on_error == "raise":
        other = F.raise_error(F.concat(F.lit("batched reply does not fit its contexts: "), reply)).cast(
            "array<boolean>"
        )
    else:
        other = F.array_repeat(F.lit(default), size)
    return F.when(usable, read).otherwise(other)
