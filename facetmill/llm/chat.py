r"""Chat formatting of typed content parts, with DataFrame functions only.

A turn's content is an array of parts: text, image, audio or document. A visitor flattens the parts
in order: text is escaped, each other part becomes a placeholder ``<part KIND N>`` with N counting
through the conversation, and its reference and expanded token count are recorded. A turn is
``<turn ROLE>`` content ``</turn>`` and a line end. Control strings inside texts get a backslash
after their ``<`` (one more where backslashes stand there), so that taking one away restores them.

Edge cases: null or absent content is empty; a null role is written and read as empty; turns sort
by turn, then role, then content, so ties and repeated rows have one order; a part of unknown kind
is treated as a document; rows of null conv_id form one conversation; an empty table gives an
empty table; other columns are ignored. One conversation's text has to fit a string of Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind string, text string, ref string, width int, height int, seconds double, pages int>"
#: Pixels of an image patch's side, audio frames a second, ids a document page: an expanded part's token counts.
PATCH, FRAMES, PAGE = 28, 25, 512
_CONTROL, _ESCAPED = r"<(\\*)(/?turn|part)", r"<\\(\\*)(/?turn|part)"
_END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1$2")


def text_parts(text: Column) -> Column:
    """Plain text as an array of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), null.alias("ref"), null.alias("width"), null.alias("height"), null.alias("seconds"), null.alias("pages"))).cast(f"array<{PART}>")


def _expanded(part: Column) -> Column:
    """Ids that stand for a part that isn't text; unknown measures count as one unit."""
    one = F.lit(1.0)
    side = lambda c: F.ceil(F.greatest(F.coalesce(part[c].cast("double"), one), one) / PATCH)
    image = side("width") * side("height")
    audio = F.ceil(F.greatest(F.coalesce(part["seconds"], one), F.lit(0.0)) * FRAMES)
    return F.when(part["kind"] == "text", F.lit(0)).when(part["kind"] == "image", image).when(part["kind"] == "audio", audio).otherwise(F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE).cast("long")


def _visit(parts: Column, before: Column) -> Column:
    """The flattened parts: content string, and reference, kind, number and tokens of attachments."""
    media = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("part"), i.alias("i"))), lambda x: x["part"]["kind"] != "text")
    numbered = F.transform(media, lambda x, n: F.struct(x["i"].alias("i"), (before + n).alias("number"), x["part"].alias("part")))

    def flat(part: Column, i: Column) -> Column:
        number = F.filter(numbered, lambda x: x["i"] == i)[0]["number"]
        return F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<part "), _kind(part), F.lit(" "), number.cast("string"), F.lit(">")))

    attachments = F.transform(numbered, lambda x: F.struct(x["number"].alias("number"), _kind(x["part"]).alias("kind"), x["part"]["ref"].alias("ref"), _expanded(x["part"]).alias("tokens")))
    return F.struct(F.array_join(F.transform(parts, flat), "").alias("content"), attachments.alias("attachments"))


def _kind(part: Column) -> Column:
    return F.when(part["kind"].isin("image", "audio"), part["kind"]).otherwise(F.lit("document"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """A row for each conversation: formatted text, loss spans, attachments, their expanded tokens.

    ``turns`` has conv_id, turn, role and either ``parts`` (an array of PART) or ``text``. Loss spans
    are code point positions in the formatted text, end exclusive, one for each turn of ``loss_role``.
    """
    parts = F.col("parts").cast(f"array<{PART}>") if "parts" in turns.columns else text_parts(F.col("text"))
    parts = F.transform(F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()), lambda p: p.withField("kind", F.coalesce(p["kind"], F.lit("document"))))
    rows = turns.select("conv_id", F.col("turn").alias("at"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    order = Window.partitionBy("conv_id").orderBy("at", "role", F.col("parts").cast("string"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    media = F.size(F.filter("parts", lambda p: p["kind"] != "text"))
    rows = rows.withColumn("no", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum(media).over(earlier), F.lit(0)).cast("int"))
    rows = rows.withColumn("flat", _visit(F.col("parts"), F.col("before")))
    role = F.replace(F.replace(F.replace("role", F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E"))
    rows = rows.select("conv_id", "no", "role", F.concat(F.lit("<turn "), role, F.lit(">")).alias("head"), F.col("flat.content").alias("content"), F.col("flat.attachments").alias("attachments"))
    rows = rows.withColumn("piece", F.concat("head", "content", F.lit(_END)))
    numbered = Window.partitionBy("conv_id").orderBy("no")
    begin = F.coalesce(F.sum(F.length("piece")).over(numbered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    rows = rows.withColumn("begin", begin)
    span = F.when(F.col("role") == loss_role, F.struct(F.col("begin").alias("start"), (F.col("begin") + F.length("content")).alias("end")))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("no", "piece", span.alias("span"), "attachments"))).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: t["attachments"]))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["span"].isNotNull()), lambda t: t["span"]).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (role, text) and the texts under the loss mask, from nothing but the output's columns.

    Placeholders stay in the text as they are.
    """
    pieces = F.filter(F.split("formatted", _END), lambda x: x != "")
    role = lambda x: F.regexp_extract(x, r"(?s)^<turn ([^>]*)>", 1)
    plain = lambda x: F.replace(F.replace(F.replace(role(x), F.lit("%3E"), F.lit(">")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))
    text = lambda x: unescape(F.substring(x, F.instr(x, ">") + 1, F.length(x)))
    return formatted.select(
        "conv_id",
        "formatted",
        F.transform(pieces, lambda x: F.struct(plain(x).alias("role"), text(x).alias("text"))).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("loss_texts"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
