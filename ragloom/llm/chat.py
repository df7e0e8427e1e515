"""Chat formatting with typed content parts, in DataFrame functions only.

Each turn has a role and an array of parts. A visitor dispatches on a part's
type and flattens the array, in order, into a body: text is escaped, and an
image, audio or document part becomes a placeholder control string, while its
reference and expanded token count go to the list of attachments.

A turn is ``<|im_start|>role<|im_sep|>body<|im_end|>\\n``. In roles and texts every
``<``, backslashes, ``|`` gets one more backslash before the ``|``; so a control string
never stands inside a text, and taking one backslash away restores it. Two text parts
that meet have ``<|part|>`` between them, or they could form a control string together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
PART_BREAK = "<|part|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class TokenRules:
    """How many model tokens a media placeholder stands for; a missing size counts as zero."""

    image_patch: int = 28
    audio_tokens_per_second: float = 25.0
    document_tokens_per_page: int = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_parts(text: Column) -> Column:
    """A plain text as an array of one part; null text is an empty text."""
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *nothing)).cast(f"array<{PART}>")


def visit_part(part: Column, rules: TokenRules) -> Column:
    """One part as struct(piece, kind, ref, tokens); an unknown or null type counts as text."""
    side = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / rules.image_patch)
    kind = F.lower(F.coalesce(part["type"], F.lit("text")))
    tokens = (
        F.when(kind == "image", side(part["width"]) * side(part["height"]))
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * rules.audio_tokens_per_second))
        .when(kind == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * rules.document_tokens_per_page)
        .otherwise(F.lit(0))
        .cast("long")
    )
    piece = escape(F.coalesce(part["text"], F.lit("")))
    for name, placeholder in PLACEHOLDERS.items():
        piece = F.when(kind == name, F.lit(placeholder)).otherwise(piece)
    media = kind.isin(*PLACEHOLDERS)
    return F.struct(piece.alias("piece"), F.when(media, kind).alias("kind"), F.when(media, part["ref"]).alias("ref"), tokens.alias("tokens"))


def flatten_pieces(seen: Column) -> Column:
    is_text = lambda p: p["kind"].isNull()
    after_text = lambda i: (i > 0) & is_text(F.get(seen, i - 1))
    return F.array_join(F.transform(seen, lambda p, i: F.when(is_text(p) & after_text(i), F.concat(F.lit(PART_BREAK), p["piece"])).otherwise(p["piece"])), "")


def format_chat(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    rules: TokenRules | None = None,
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_mask, attachments, expanded_tokens``.

    ``loss_mask`` has (turn, at, start, length) for each body of ``loss_role``: its place in
    its turn and in ``formatted``, in code points. ``attachments`` has (turn, no, kind, ref, tokens).
    Turns go by ``turn``, then role, then body; a null turn comes first, a null role is empty, null
    parts are an empty text, a null conversation is a conversation of its own. Repeated rows stay.
    Other columns are not read. A conversation becomes one value, so it must fit into one (2 GB);
    conversations are formatted by windows that spill, not by folding arrays.
    """
    rules = rules or TokenRules()
    role = escape(F.coalesce(F.col(role_col).cast("string"), F.lit("")))
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    rows = (
        turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.transform(parts, lambda p: visit_part(p, rules)).alias("seen"))
        .withColumn("body", flatten_pieces(F.col("seen")))
        .withColumn("head", F.concat(F.lit(START), "role", F.lit(SEP)))
        .withColumn("size", F.char_length("head") + F.char_length("body") + F.lit(len(END)))
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    rows = rows.withColumn("no", F.row_number().over(order)).withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    mask = F.struct(
        F.col("no").alias("turn"),
        F.char_length("head").alias("at"),
        (F.coalesce("start", F.lit(0)) + F.char_length("head")).cast("long").alias("start"),
        F.char_length("body").alias("length"),
    )
    media = F.transform(
        F.filter("seen", lambda p: p["kind"].isNotNull()),
        lambda p, i: F.struct(F.col("no").alias("turn"), (i + 1).alias("no"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")),
    )
    rows = rows.select(
        "conv_id",
        F.struct("no", F.concat("head", "body", F.lit(END)).alias("text"), media.alias("media")).alias("t"),
        F.when(F.col("role") == loss_role, mask).alias("mask"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"), F.array_sort(F.collect_list("mask")).alias("loss_mask"))
    attachments = F.flatten(F.transform("t", lambda t: t["media"]))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["text"]), "").alias("formatted"),
        "loss_mask",
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds to ``format_chat``'s rows what a reader finds in them: ``turns`` (role, text) and
    ``loss_texts``, the unescaped texts under the loss mask. Placeholders stay in the texts."""
    cut = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2147483647)
    body = lambda t: F.substring_index(F.substring_index(t, SEP, -1), END, 1)
    return (
        formatted.withColumn("cut", cut)
        .withColumn("turns", F.transform("cut", lambda t: F.struct(unescape(F.substring_index(t, SEP, 1)).alias("role"), unescape(body(t)).alias("text"))))
        .withColumn("loss_texts", F.transform("loss_mask", lambda m: unescape(F.substring(F.get("cut", m["turn"] - 1), m["at"] - len(START) + 1, m["length"]))))
        .drop("cut")
    )


def chat_digest(conversations: DataFrame) -> DataFrame:
    """The digest columns of formatted plain-text conversations ``(conv_id, turn, role, text)``."""
    formatted = format_chat(conversations.select("conv_id", "turn", "role", text_parts(F.col("text").cast("string")).alias("parts")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
