r"""Chat formatting of typed content parts, in DataFrame functions only.

A visitor flattens each turn's parts in order: text is escaped; an image, audio or document part
becomes a numbered placeholder, and its reference, its kind and the tokens that it will expand to
are recorded. A turn reads

    <|turn|>ROLE<|body|>BODY<|end|>\n

Neighbouring text parts are joined before they are escaped, so that no control string can form at a seam. In
texts, roles and references a backslash is doubled and `<|` becomes `<\|`, so no text can hold a
control string, and unescape() gives every text back. The loss mask is the bodies' character spans
of the roles that are learned.

Nulls: a null text or role is empty; a null part or an unknown kind of part is a text part of what
text it has. Turns go by turn (nulls first), then role and text; repeated rows are turns of their
own. A null conv_id is a conversation. A conversation is one string of one task, however long. Extra
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: Tokens that a unit of each kind of part expands to: an image tile, a second, a page.
RATES = {"image": 256, "audio": 25, "document": 512}


def escape(x: Column) -> Column:
    return F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """One text part, for tables of plain texts."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def formatted(turns: DataFrame, learned: tuple[str, ...] = ("assistant",), rates: dict[str, int] = RATES) -> DataFrame:
    """(conv_id, n_turns, formatted, loss array<struct<start,length>>, attachments, expanded_tokens) a conversation.

    turns: (conv_id, turn, role, parts array<struct<kind,text,ref,units>>). Loss spans are in
    characters from 0. attachments: (turn, place, kind, ref, tokens) in the order of the
    placeholders, which carry the place within their turn.
    """
    kind = lambda p: F.coalesce(p["kind"], F.lit("text"))
    attached = lambda p: kind(p).isin(*rates)
    tokens = lambda p: F.coalesce(p["units"], F.lit(1)) * F.coalesce(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])[kind(p)], F.lit(0)) if rates else F.lit(0)
    is_attached = lambda p: F.coalesce(attached(p), F.lit(False))
    mark = lambda p, i: F.concat(F.lit("<|"), kind(p), F.lit(":"), i.cast("string"), F.lit("|>"))
    # done: what is escaped; open: the text parts since the last placeholder
    visited = lambda acc, x: F.when(is_attached(x["p"]), F.struct(F.concat(acc["done"], escape(acc["open"]), mark(x["p"], x["i"])).alias("done"), F.lit("").alias("open"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.coalesce(x["p"]["text"], F.lit(""))).alias("open")))
    parts = F.coalesce("parts", F.array().cast("array<struct<kind:string,text:string,ref:string,units:bigint>>"))
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    placed = F.transform("parts", lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    t = t.withColumn("body", F.aggregate(placed, F.struct(F.lit("").alias("done"), F.lit("").alias("open")), visited, lambda acc: F.concat(acc["done"], escape(acc["open"]))))
    own = F.transform("parts", lambda p, i: F.struct(F.coalesce(attached(p), F.lit(False)).alias("is"), i.alias("place"), kind(p).alias("kind"), p["ref"].alias("ref"), tokens(p).cast("long").alias("tokens")))
    t = t.withColumn("attached", F.filter(own, lambda x: x["is"]))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    t = t.select("conv_id", "turn", "role", "body", "attached", head.alias("head"), F.concat(head, "body", F.lit(END)).alias("piece"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = F.coalesce(F.sum(F.char_length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("no", F.row_number().over(w)).withColumn("start", before + F.char_length("head"))
    row = F.struct("no", "piece", F.col("role").isin(*learned).alias("loss"), F.col("start").cast("long").alias("start"), F.char_length("body").cast("long").alias("length"), "attached")
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    loss = F.transform(F.filter("r", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    attachments = F.flatten(F.transform("r", lambda x: F.transform(x["attached"], lambda a: F.struct(x["no"].alias("turn"), a["place"].alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    c = c.select("conv_id", F.size("r").cast("long").alias("n_turns"), F.array_join("r.piece", "").alias("formatted"), loss.alias("loss"), attachments.alias("attachments"))
    return c.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]))


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation; placeholders are left out of the texts."""
    pieces = F.slice(F.split(text, r"<\|turn\|>"), 2, 1 << 30)
    role = lambda p: F.substring_index(p, BODY, 1)
    body = lambda p: F.substr(p, F.char_length(role(p)) + F.lit(len(BODY) + 1), F.char_length(p) - F.char_length(role(p)) - F.lit(len(BODY) + len(END)))
    plain = lambda x: unescape(F.regexp_replace(x, r"<\|[a-z]+:[0-9]+\|>", ""))
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), plain(body(p)).alias("text")))


def masked(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    part = lambda s: unescape(F.regexp_replace(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")), r"<\|[a-z]+:[0-9]+\|>", ""))
    return F.array_join(F.transform(loss, part), "")
