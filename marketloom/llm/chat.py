"""Chat formatting by prefix-target expansion: every assistant turn becomes an example whose context is all turns before it.

A conversation's turns are marked by a template and joined; control strings inside a text get a backslash after their
bracket, so that no text can end a turn, and the text can be had back exactly. Only the reply of an example is trainable:
its place is a span of code points. Everything is built-in expressions; nothing leaves the JVM.

An example is one text, so a conversation has to fit into a row; n replies give n examples, together n / 2 times as long
as the conversation. Turns are ordered by turn (those without one first), ties by role, then text; repeated rows are turns
of their own. Rows without a conv_id belong to no known conversation: each is one of its own. A null role or text is empty,
long ones are formatted whole, an empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template: a turn is START, the tag of its role, a blank, text, a blank, the closing tag, END.
START, END = "<s>", "</s>"
TAGS = {"user": "INST", "system": "SYS", "assistant": "OUT"}
#: The tag of all other roles; there the role goes before the text, up to BODY.
OTHER, BODY = "ROLE", "[TEXT] "
#: What a control string is: a bracket, any number of backslashes, and one of these ends.
CONTROL = r"([<\[]\\*)(/?s>|/?(?:INST|SYS|OUT|ROLE)\]|TEXT\])"
ESCAPED = r"([<\[]\\*)\\(/?s>|/?(?:INST|SYS|OUT|ROLE)\]|TEXT\])"


def opening(tag: str) -> str:
    return f"{START}[{tag}] "


def closing(tag: str) -> str:
    return f" [/{tag}]{END}"


def escape(text: Column) -> Column:
    """One backslash more after the bracket of each control string, escaped ones included."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    """The inverse of `escape`."""
    return F.regexp_replace(text, ESCAPED, "$1$2")


def formatted(turn: Column) -> Column:
    """A turn (role, text) between its marks."""
    text = escape(turn["text"])
    out = F.concat(F.lit(opening(OTHER)), escape(turn["role"]), F.lit(BODY), text, F.lit(closing(OTHER)))
    for role, tag in TAGS.items():
        out = F.when(turn["role"] == role, F.concat(F.lit(opening(tag)), text, F.lit(closing(tag)))).otherwise(out)
    return out


def parsed(piece: Column) -> Column:
    """(role, text) of a formatted turn without its END."""

    def inside(tag: str) -> Column:
        before, after = len(opening(tag)), len(closing(tag)) - len(END)
        return F.substring(piece, F.lit(before + 1), F.length(piece) - (before + after))

    other = inside(OTHER)
    at = F.instr(other, BODY)
    both = F.struct(unescape(F.substring(other, F.lit(1), at - 1)).alias("role"), unescape(F.substring(other, at + len(BODY), F.length(other))).alias("text"))
    for role, tag in TAGS.items():
        both = F.when(piece.startswith(opening(tag)), F.struct(F.lit(role).alias("role"), unescape(inside(tag)).alias("text"))).otherwise(both)
    return both


def turns_of(text: Column) -> Column:
    """All turns (role, text) of a formatted text, in order."""
    pieces = F.split(text, END)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parsed)  # after the last END there is nothing


def expand_replies(conversations: DataFrame) -> DataFrame:
    """(conv_id, alone, example, n_examples, text, loss_start, loss_end) of (conv_id, turn, role, text).

    One row for each assistant turn: all turns before it, then it. Code points from loss_start up to loss_end are trainable. Where no
    assistant has the last word, a further row without a trainable part holds the whole conversation, so that nothing is lost.
    `alone` is null but for rows without a conv_id, which it numbers.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"), "turn", empty("role").alias("role"), empty("text").alias("text"))
    whole = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    last = F.element_at("turns", -1)["role"]
    replies = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda k: F.get("turns", k)["role"] == "assistant")
    whole = whole.select("conv_id", "alone", F.transform("turns", formatted).alias("pieces"), F.when(last == "assistant", replies).otherwise(F.array_append(replies, F.size("turns"))).alias("targets"))
    each = whole.select("conv_id", "alone", "pieces", F.size("targets").alias("n_examples"), F.posexplode("targets").alias("example", "target"))
    reply = F.coalesce(F.get("pieces", F.col("target")), F.lit(""))
    each = each.select("conv_id", "alone", "example", "n_examples", F.array_join(F.slice("pieces", F.lit(1), F.col("target")), "").alias("context"), reply.alias("reply"))
    marks = F.when(F.col("reply") != "", F.length("reply") - (len(opening(TAGS["assistant"])) + len(closing(TAGS["assistant"])))).otherwise(0)
    start = F.length("context") + F.when(F.col("reply") != "", len(opening(TAGS["assistant"]))).otherwise(0)
    return each.select("conv_id", "alone", "example", "n_examples", F.concat("context", "reply").alias("text"), start.cast("long").alias("loss_start"), (start + marks).cast("long").alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, alone, turns, losses, formatted_chars) from the examples' texts and spans alone.

    turns: (role, text) of the whole conversation, parsed from its longest example; losses: the trainable text of each example in order, unescaped.
    """
    under = unescape(F.substring("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    whole = F.when(F.col("example") == F.col("n_examples") - 1, turns_of(F.col("text")))
    parts = examples.select("conv_id", "alone", "example", whole.alias("turns"), under.alias("loss"), F.length("text").cast("long").alias("chars"))
    sums = parts.groupBy("conv_id", "alone").agg(F.max_by("turns", "example").alias("turns"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"))
    return sums.withColumn("losses", F.transform("losses", lambda x: x["loss"]))


def digest_turns(read: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what was read back."""
    line = F.lit("\n")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.array_join("losses", "").alias("loss"), "formatted_chars")
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
