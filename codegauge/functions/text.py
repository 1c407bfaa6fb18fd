"""String helpers that keep Python's rules for white space and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codegauge.fixed_values import PYTHON_WHITESPACE


def strip(text: Column) -> Column:
    """Python's ``str.strip``: linear, edges only, no regex.

    Trimming a set of characters is slow, so it is done only where an edge needs it.
    """
    plain = F.trim(text)
    odd = [F.substring(plain, at, 1).isin(*PYTHON_WHITESPACE) for at in (1, -1)]
    return F.when(odd[0] | odd[1], F.btrim(text, F.lit(PYTHON_WHITESPACE))).otherwise(plain)


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(PYTHON_WHITESPACE))


def last_line(text: Column) -> Column:
    """Last line of the stripped text."""
    return F.substring_index(strip(text), "\n", -1)


def first_line(text: Column) -> Column:
    return F.substring_index(strip(text), "\n", 1)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def message_list(role: str, content: Column) -> Column:
    """One-message chat prompt."""
    return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))


def completion_text(completion: Column, is_message_list: bool = False) -> Column:
    """Text of a completion: the string itself, or the last message's content.

    An empty message list gives the empty string.
    """
    if not is_message_list:
        return completion
    return F.coalesce(F.try_element_at(completion, F.lit(-1))["content"], F.lit(""))
