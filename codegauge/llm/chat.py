r"""Chat formatting: typed content parts to one training string per conversation, and back.

A message is a role and a list of parts (type, text, ref, tokens).  A visitor, one
expression per part type, flattens them in order: text is escaped; image, audio and
document parts become placeholders, each recorded as an attachment (turn, place in the
message, type, ref, expanded tokens).  The template of a message is
``<|im_start|>role\\ntext<|im_end|>\\n``.

Escaping keeps texts from forging control strings and is reversible: in texts and roles
``\\`` becomes ``\\\\``, and ``|`` becomes ``\\|`` after ``<`` and at the start; a ``<|`` in the
output is thus always the template's, and undoing reads ``\\`` as "take the next character".  Roles also escape
line feeds (as ``\\n``).

Defined results: a null text or role is empty; a null list of parts is an empty message;
a part of unknown type or without ref keeps its place as an empty placeholder of type
``unknown`` or with an empty ref; turns that tie are ordered by role, then content; a null
turn comes first; repeated rows are repeated turns; rows with a null conversation id form
one conversation; an empty table gives an empty table.

A conversation is one string, so its turns meet in one task: that is the shape of the
result.  Texts are escaped before they are brought together, and nothing else is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: Tokens a placeholder stands for, unless the part says so itself.
EXPANDED_TOKENS = {"image": 256, "audio": 128, "document": 512}
PART = "struct<type:string,text:string,ref:string,tokens:int>"


def escape(text: Column) -> Column:
    """Also escapes a leading bar, since the part before may end in ``<``."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(text, r"(\A|<)\|", r"$1\\|")


def unescape(text: Column) -> Column:
    r"""Undo ``escape``: a backslash gives way to the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    r"""Undo ``escape_role``: ``\\n`` is a line feed unless its backslash is escaped itself."""
    return F.regexp_replace(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("text", *EXPANDED_TOKENS), part["type"]).otherwise(F.lit("unknown"))


def _expanded(part: Column) -> Column:
    default = F.lit(0)
    for kind, tokens in EXPANDED_TOKENS.items():
        default = F.when(part["type"] == kind, F.lit(tokens)).otherwise(default)
    return F.coalesce(part["tokens"], default)


def visit(part: Column) -> Column:
    """What a part is in the formatted text."""
    placeholder = F.concat(F.lit("<|"), _kind(part), F.lit(":"), escape(part["ref"]), F.lit("|>"))
    return F.when(part["type"] == "text", escape(part["text"])).otherwise(placeholder)


def format_messages(df: DataFrame, parts_col: str = "parts") -> DataFrame:
    """Add ``__c_body`` (flattened parts), ``__c_attachments`` and ``__c_tokens`` (expanded)."""
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    media = F.filter(
        F.transform(parts, lambda p, k: F.struct(k.alias("place"), _kind(p).alias("type"), F.coalesce(p["ref"], F.lit("")).alias("ref"), _expanded(p).alias("tokens"))),
        lambda a: a["type"] != "text",
    )
    df = df.withColumns({"__c_body": F.array_join(F.transform(parts, visit), ""), "__c_attachments": media})
    return df.withColumn("__c_tokens", F.aggregate("__c_attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]))


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, expanded_tokens) of each conversation.

    ``loss_spans`` are (start, end) code points of trained text in ``formatted``.
    """
    rows = format_messages(df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(parts_col).alias("parts")))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    tail = END + "\n"
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), "__c_body", "__c_attachments", "__c_tokens")
    size = (F.length("head") + F.length("__c_body") + len(tail)).cast("long")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "__c_body")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"place": F.row_number().over(order), "begin": before + F.length("head")})
    span = F.struct(F.col("begin").alias("start"), (F.col("begin") + F.length("__c_body")).alias("end"))
    media = F.transform("__c_attachments", lambda a: F.struct(F.col("turn").alias("turn"), a["place"].alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    text = F.struct("place", F.concat("head", "__c_body", F.lit(tail)).alias("text"))
    trained = F.when(F.col("role") == TRAINED_ROLE, span)
    found = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(text)).alias("texts"), F.array_sort(F.collect_list(trained)).alias("loss_spans"),
        F.array_sort(F.collect_list(F.when(F.size("__c_attachments") > 0, F.struct("place", media.alias("media"))))).alias("media"), F.sum("__c_tokens").alias("expanded_tokens"),
    )
    return found.select("conv_id", F.array_join("texts.text", "").alias("formatted"), "loss_spans", F.flatten("media.media").alias("attachments"), "expanded_tokens")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation: the inverse of the template.

    Placeholders stay as they are in the text.
    """
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")
    role = lambda b: F.substring_index(b, "\n", 1)
    # after the role's line feed, up to the end mark (and its line feed)
    body = lambda b: F.substring(b, F.length(role(b)) + 2, F.length(b) - F.length(role(b)) - 2 - len(END))
    return F.transform(blocks, lambda b: F.struct(unescape_role(role(b)).alias("role"), unescape(body(b)).alias("text")))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """Unescaped texts under the loss mask.

    Each span is cut out of its own message, so that a long conversation is read once.
    """
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: unescape_role(F.substring_index(b, "\n", 1)) == TRAINED_ROLE)
    tail = len(END) + 1

    def cut(block: Column, span: Column) -> Column:
        chars = (span["end"] - span["start"]).cast("int")
        return unescape(F.substring(block, F.length(block) - tail - chars + 1, chars))

    return F.zip_with(blocks, spans, cut)
