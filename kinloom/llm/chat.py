"""Chat formatting (native): typed content parts, flattened by a visitor into text with placeholders.

A message is a row with an ordered array of parts. The visitor has one handler for each kind of part:
text is escaped and inlined; images, audio and documents become a placeholder, a reference in the row's
attachments, and the number of model tokens that the placeholder stands for. The output has a row for
each turn: its segments, joined in order, are the formatted conversation, so that a conversation with
very many turns is never gathered to be formatted.

Segment: ``<|im_start|>ROLE\\nBODY<|im_end|>\\n``. A control string starts with ``<|``, and no escaped text
holds one: between ``<`` and ``|`` there is always a backslash, one more than in the text itself. Neighbouring text
parts are escaped as the one text that they become, so that no control string comes of several parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,millis:long,pages:int>"
START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of media: an image tile of 28 x 28 pixels, 40 ms of audio, a document page.
TILE, FRAME_MS, PAGE_TOKENS = 28, 40, 1024
KINDS = ("image", "audio", "document")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_parts(text: Column) -> Column:
    """Plain text as an array of one part."""
    none = {"uri": "string", "width": "int", "height": "int", "millis": "long", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()]))


def _tokens(p: Column) -> Column:
    up = lambda x, by: F.ceil(F.coalesce(x, F.lit(0)).cast("long") / by).cast("long")
    media = F.when(p["kind"] == "image", up(p["width"], TILE) * up(p["height"], TILE)).when(p["kind"] == "audio", up(p["millis"], FRAME_MS))
    return F.greatest(F.when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)).cast("long") * PAGE_TOKENS).otherwise(media), F.lit(1).cast("long"))


def _is_media(p: Column) -> Column:
    return F.coalesce(p["kind"].isin(*KINDS), F.lit(False))


def _body(parts: Column) -> Column:
    """The parts as they stand in the body, in order: runs of text escaped, media as placeholders. Kinds that have no
    handler are text."""
    state = lambda done, run: F.struct(done.alias("done"), run.alias("run"))

    def visit(s: Column, p: Column) -> Column:
        placeholder = F.concat(s["done"], escape(s["run"]), F.lit("<|"), p["kind"], F.lit("|>"))
        return F.when(_is_media(p), state(placeholder, F.lit(""))).otherwise(state(s["done"], F.concat(s["run"], F.coalesce(p["text"], F.lit("")))))

    return F.aggregate(parts, state(F.lit(""), F.lit("")), visit, lambda s: F.concat(s["done"], escape(s["run"])))


def format_turns(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages: (conv_id, turn, role, parts array of PART); other columns are ignored.

    Returns for each message (conv_id, turn, segment, loss_start, loss_chars, attachments, expanded_tokens):
    the formatted segment, where its loss mask starts (0-based code point; null without one) and how many
    code points it covers, an array of (ordinal, kind, uri, tokens) with the ordinal of the placeholder in
    the segment, and the tokens that all placeholders stand for.

    Null role or text counts as empty, null parts as none; a null conv_id or turn stays null. Repeated rows
    each give a segment. An empty table gives an empty result.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.select("*", _body(F.col("parts")).alias("body"), F.filter("parts", _is_media).alias("media"))
    head = F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n"))
    masked = F.col("role").isin(*loss_roles)
    attached = F.transform("media", lambda p, i: F.struct(i.alias("ordinal"), p["kind"].alias("kind"), p["uri"].alias("uri"), _tokens(p).alias("tokens")))
    return rows.select(
        "conv_id", "turn", F.concat(head, F.col("body"), F.lit(END)).alias("segment"),
        F.when(masked, F.char_length(head)).alias("loss_start"), F.when(masked, F.char_length("body")).otherwise(F.lit(0)).alias("loss_chars"),
        attached.alias("attachments"), F.aggregate(F.transform("media", _tokens), F.lit(0).cast("long"), lambda a, x: a + x).alias("expanded_tokens"),
    )


def read_turns(segments: DataFrame) -> DataFrame:
    """The output of format_turns, read back: conv_id, turn, role, text (unescaped; placeholders stay), loss
    (the unescaped text under the loss mask, null without one), segment_chars."""
    end = F.locate("\n", F.col("segment"), 1)
    chars = F.char_length("segment")
    role = F.substring("segment", F.lit(len(START) + 1), end - (len(START) + 1))
    body = F.substring("segment", end + 1, chars - end - len(END))
    loss = F.substring("segment", F.col("loss_start") + 1, F.col("loss_chars"))
    return segments.select("conv_id", "turn", _role_in(role).alias("role"), unescape(body).alias("text"), unescape(loss).alias("loss"), chars.cast("long").alias("segment_chars"))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """turns: as read_turns gives them. A row for each conversation with digests of its turns and of the text
    under its loss mask, by turn (null first), then role and text. A digest of all text needs that text in one place."""
    many = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "loss")))
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("segment_chars").alias("formatted_chars"), many.alias("rows"))
    said = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("rows", lambda r: F.coalesce(r["loss"], F.lit(""))), "")
    rows = rows.select("conv_id", "n_turns", "formatted_chars", said.alias("said"), loss.alias("loss"))
    return rows.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def ordered_segments(segments: DataFrame) -> DataFrame:
    """segments with n, their number in their conversation from 0."""
    return segments.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "segment")) - 1)
