"""Chat formatting with typed content parts, in DataFrame operations only.

A turn is a role and an array of parts (kind, text, reference, tokens). A visitor turns each part into text: text parts are
escaped, parts of other kinds (image, audio, document) become ordered placeholders <kind:number> within the conversation's
attachments, which keep the part's reference and the tokens that it stands for. A turn is <turn role>, its parts, </turn>
and a line feed. The control characters of this notation are \\, < and >: escaped as \\s, \\l and \\g they never occur in a
turn's text, so that what is read back is what was written.

spans has for each turn where its text starts, how long it is, and whether the loss counts it: the assistant's turns.

Cases: a null text or role is empty; a part without a kind is text, one of any other kind stops the job; a null array of parts has none; turns of equal number follow by role, then text;
repeated rows are turns of their own; an empty text gives an empty turn; extra columns are ignored. A conversation becomes
one string, so one row holds it; turns are formatted before they are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,reference:string,tokens:bigint>"
ATTACHED = ("image", "audio", "document")
ROLE_COUNTED = "assistant"
END = "</turn>\n"


def escape(text: Column) -> Column:
    for plain, code in (("\\", r"\s"), ("<", r"\l"), (">", r"\g")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in ((">", r"\g"), ("<", r"\l"), ("\\", r"\s")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """One part of kind text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("reference"), F.lit(None).cast("bigint").alias("tokens"))).cast(f"array<{PART}>")


def visit(parts: Column) -> Column:
    """The parts of a turn as text; placeholders carry their place in the turn, which numbered() makes one in the conversation."""
    def shown(p: Column) -> Column:
        said = F.when(p.kind.isin(*ATTACHED), F.concat(F.lit("<"), p.kind, F.lit(">"))).when(F.coalesce(p.kind, F.lit("text")) == "text", escape(F.coalesce(p.text, F.lit(""))))
        return said.otherwise(F.raise_error(F.concat(F.lit("no such kind of part: "), p.kind)).cast("string"))

    return F.coalesce(F.array_join(F.transform(parts, shown), ""), F.lit(""))


def format_chats(turns: DataFrame) -> DataFrame:
    """From turns (conv_id, turn, role, parts): conv_id, formatted, spans (start, length, counted), attachments (number, kind,
    reference, tokens) and n_tokens_attached, a row for each conversation."""
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    attached = F.transform(F.filter(parts, lambda p: p.kind.isin(*ATTACHED)), lambda p: F.struct(p.kind.alias("kind"), p.reference.alias("reference"), F.coalesce(p.tokens, F.lit(0).cast("bigint")).alias("tokens")))
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit("<turn "), escape(role), F.lit(">"))
    ready = turns.select("conv_id", "turn", role.alias("role"), visit(parts).alias("body"), attached.alias("attached"), F.length(head).alias("head"), head.alias("opening"))
    # Order by turn, role, body; sorted in the group's array, as it must become one string in any case.
    gathered = ready.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "opening", "head", "attached"))).alias("t"))
    flat = F.flatten(F.transform("t", lambda t: t.attached))
    placed = F.transform(flat, lambda a, i: F.struct((i + 1).cast("int").alias("number"), a.kind.alias("kind"), a.reference.alias("reference"), a.tokens.alias("tokens")))
    return (
        gathered.withColumn("attachments", placed)
        .withColumn("t", F.when(F.size("attachments") > 0, numbered(F.col("t"))).otherwise(F.col("t")))
        .withColumn("sizes", F.transform("t", lambda t: F.length(t.body)))
        .withColumn("formatted", F.array_join(F.transform("t", lambda t: F.concat(t.opening, t.body, F.lit(END))), ""))
        .withColumn("spans", F.transform("t", lambda t: F.struct(t["head"].alias("head"), F.length(t.body).alias("length"), (t.role == ROLE_COUNTED).alias("counted"))))
        .select("conv_id", "formatted", starts(F.col("spans")).alias("spans"), "attachments", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a.tokens).alias("n_tokens_attached"))
    )


def numbered(t: Column) -> Column:
    """The turns with placeholders <kind> made <kind:number>, counted through the conversation."""
    marks = "|".join(ATTACHED)

    def renumber(state: Column, turn: Column) -> Column:
        pieces = F.split(turn.body, f"(?=<(?:{marks})>)")
        here = F.size(turn.attached)
        # A body that begins with a placeholder has no piece before it.
        lead = F.when(F.regexp_like(pieces[0], F.lit(f"^<(?:{marks})>")), 1).otherwise(0)
        body = F.array_join(F.transform(pieces, lambda p, i: F.regexp_replace(p, F.lit(f"^<({marks})>"), F.concat(F.lit("<$1:"), (state.seen + i + lead).cast("string"), F.lit(">")))), "")
        changed = F.struct(turn.turn.alias("turn"), turn.role.alias("role"), body.alias("body"), turn.opening.alias("opening"), turn["head"].alias("head"), turn.attached.alias("attached"))
        return F.struct((state.seen + here).alias("seen"), F.concat(state.done, F.array(changed)).alias("done"))

    empty = F.struct(F.lit(0).alias("seen"), F.filter(t, lambda x: F.lit(False)).alias("done"))
    return F.aggregate(t, empty, renumber).done


def starts(spans: Column) -> Column:
    """Spans with the place where each starts: sums of what stands before."""
    ends = F.aggregate(spans, F.array(F.lit(0)), lambda sums, s: F.concat(sums, F.array(F.element_at(sums, -1) + s["head"] + s.length + len(END))))
    return F.transform(F.arrays_zip(spans.alias("s"), F.slice(ends, 1, F.greatest(F.size(spans), F.lit(0))).alias("e")), lambda z: F.struct((z.e + z.s["head"]).alias("start"), z.s.length.alias("length"), z.s.counted.alias("counted")))


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, masked) for each turn, from formatted and spans alone: masked is the text that the loss
    counts, cut out by its span, null for other turns. Placeholders stay as they are in text."""
    cells = F.arrays_zip(F.split(F.substring(F.col("formatted"), 1, 2147483647), F.lit(END), -1).alias("cell"), F.col("spans").alias("span"))
    rows = chats.select("conv_id", F.posexplode(F.slice(cells, 1, F.greatest(F.size("spans"), F.lit(0)))).alias("place", "z")).select("conv_id", "place", "z.cell", "z.span")
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("cell") + len(END)).over(before), F.lit(0)).cast("int"))
    head = F.instr("cell", ">")
    role = F.substring("cell", F.lit(len("<turn ") + 1), head - len("<turn ") - 1)
    masked = F.when(F.col("span.counted"), F.substring("cell", F.col("span.start") - F.col("at") + 1, F.col("span.length")))
    return rows.select("conv_id", "place", unescape(role).alias("role"), unescape(F.substring("cell", head + 1, F.length("cell"))).alias("text"), unescape(masked).alias("masked"))
