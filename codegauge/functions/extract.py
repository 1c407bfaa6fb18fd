"""Code extraction from model completions.

Three tiers, the first with a hit wins: closed ``python`` fences, any closed
fence, the text after an unclosed fence.  Only the first tier counts as the
right format.  White space around a block is trimmed after matching instead of
inside the pattern, so matching stays linear in the text length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codegauge.functions.text import let, lstrip, strip

FENCE = "```"
PYTHON_TAG = "```python"
PYTHON_BLOCK = r"(?s)```python(.*?)```"
ANY_BLOCK = r"(?s)```(.*?)```"
OPEN_BLOCK = r"(?s)```[\p{L}\p{N}_]*(.*)"


def _closed_after(completion: Column, opening: str) -> Column:
    """Does a fence follow the first ``opening``?  Plain substring search."""
    start = F.instr(completion, opening)
    rest = F.substr(completion, start + len(opening))
    return F.coalesce((start > 0) & rest.contains(FENCE), F.lit(False))


def has_python_fence(completion: Column) -> Column:
    """True if the completion follows the asked format."""
    return _closed_after(completion, PYTHON_TAG)


def _blocks(completion: Column) -> Column:
    found = lambda pattern: F.regexp_extract_all(completion, F.lit(pattern), F.lit(1))
    return (
        F.when(has_python_fence(completion), found(PYTHON_BLOCK))
        .when(_closed_after(completion, FENCE), found(ANY_BLOCK))
        .otherwise(found(OPEN_BLOCK))
    )


def _defines_something(block: Column) -> Column:
    return block.contains("def ") | block.contains("class ")


def extract_code(completion: Column, strategy: str = "last") -> Column:
    """``struct<code string, correct_format boolean>`` for one completion.

    ``last`` takes the last block holding ``def `` or ``class ``, else the last
    block, else null.  ``all`` joins the blocks with a blank line and gives the
    empty string when there is none.
    """
    if strategy == "last":
        blocks = F.transform(_blocks(completion), strip)
        code = let(
            blocks,
            lambda found: F.coalesce(
                F.try_element_at(F.filter(found, _defines_something), F.lit(-1)),
                F.try_element_at(found, F.lit(-1)),
            ),
        )
    elif strategy == "all":
        closed = _closed_after(completion, FENCE)
        code = F.coalesce(
            F.array_join(
                F.transform(
                    _blocks(completion),
                    lambda b: F.when(closed, strip(b)).otherwise(lstrip(b)),
                ),
                "\n\n",
            ),
            F.lit(""),
        )
    else:
        raise ValueError(f"unknown strategy: {strategy!r} (use 'last' or 'all')")
    return F.struct(
        code.alias("code"), has_python_fence(completion).alias("correct_format")
    )
