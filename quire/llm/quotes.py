"""Quotation linking in conversations.

Each line of a message has a quote level, its number of leading ``>``. Runs of lines of one level are
passages. A passage is normalised (lower case, all white space one blank, so that wrapping doesn't
matter) and hashed, and is joined to the messages whose own words hold it: originals are a message's
own words as a whole, its runs of unquoted lines, their paragraphs and their lines. A passage that is no
original as a whole is looked up by its paragraphs, and a paragraph that is none by its lines. Each is
joined to the earliest original, in the same conversation if an earlier message there has one, else
anywhere; a piece of fewer than LEAST words, as "thanks", links only if it is all that an earlier message of the
conversation says.

A message replies to the earlier message of its conversation to which most words of its outermost
quotes lead (of equals the latest, since a reply quotes what came last), and threads are the trees of
these replies. Ordered by the turn of the thread's root and then by turn, every reply follows what it
replies to, and quotes and their attribution lines are gone from the texts.

An original is one row per hash, formed before the shuffle, so a passage that stands in most messages
is joined once per quote, never message by message. Originals are only looked for among hashes that
quotes ask for. Threads are found by doubling pointers in written tables, and no conversation is
gathered into one task.

Defined cases: null text has no lines and stays null; pieces that are blank after normalising link to
nothing; null conv_id is a conversation of its own, a null turn is neither original nor reply; rows that
repeat (conv_id, turn) share their links; a quote without an original counts as unlinked; texts of any
length are read whole; other columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

QUOTE = r"^(?:[ \t]*>)+[ \t]?"
#: A line that announces a quote, as in "On Monday Ann wrote:".
ATTRIBUTION = r"(?i)^\s*(?:on|am|le|el)\b.*(?:wrote|schrieb|écrit|escribió)\s*:\s*$"
CONV = "case when conv is null then '-' else concat('+', conv) end"
#: Words of a piece that links wherever it stands.
LEAST = 3


def norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """messages (conv, turn, ...) with lines: level and content of each line of text."""
    lines = F.transform(F.split("text", "\r?\n"), lambda x: F.struct(
        (F.length(F.regexp_extract(x, QUOTE, 0)) - F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), ">", ""))).alias("level"),
        F.regexp_replace(x, QUOTE, "").alias("content"),
    ))
    return messages.withColumn("lines", lines)


def announces(line: Column, i: Column) -> Column:
    """Whether an unquoted line is the attribution of a quote that comes right after it."""
    return (line["level"] == 0) & F.coalesce(F.get("lines", i + 1)["level"] > 0, F.lit(False)) & line["content"].rlike(ATTRIBUTION)


def kept_lines() -> Column:
    """The unquoted lines without attributions."""
    return F.filter("lines", lambda x, i: (x["level"] == 0) & ~announces(x, i))


def runs(df: DataFrame) -> DataFrame:
    """A row per passage of each message of df (conv, turn, lines): place of its first line, level and its lines' contents."""
    places = F.expr("filter(sequence(0, size(lines) - 1), i -> i = 0 or lines[i].level <> lines[i - 1].level)")
    df = df.where("size(lines) > 0").withColumn("_b", places)
    df = df.select("conv", "turn", "lines", F.explode(F.expr("transform(_b, (b, k) -> struct(b as b, if(k + 1 < size(_b), _b[k + 1], size(lines)) as e))")).alias("r"))
    return df.selectExpr("conv", "turn", "r.b as first_line", "lines[r.b].level as level", "transform(slice(lines, r.b + 1, r.e - r.b), x -> x.content) as contents")


def quoted_passages(messages: DataFrame) -> DataFrame:
    """A row per quoted passage: conv, turn, its first line, level, number of lines, normalised text and its hash."""
    df = runs(parsed(messages.where("turn is not null"))).where("level > 0")
    return df.select("conv", "turn", "first_line", "level", F.size("contents").alias("n_lines"), norm(F.array_join("contents", " ")).alias("norm")).withColumn("hash", F.sha2("norm", 256))


def pieces(df: DataFrame) -> DataFrame:
    """Passages (conv, turn, first_line, level, contents) as the rows of their pieces: rank 0 the passage, 1 a paragraph, 2 a line.

    para and line tell the place of a piece; norm is its normalised text, words its number of words.
    """
    paragraphs = F.split(F.array_join("contents", "\n"), r"\n[ \t]*(?:\n[ \t]*)+")
    some = F.transform(paragraphs, lambda p, i: F.struct(F.lit(1).alias("rank"), i.alias("para"), F.lit(-1).alias("line"), norm(p).alias("norm")))
    single = F.flatten(F.transform(paragraphs, lambda p, i: F.transform(F.split(p, "\n"), lambda x, j: F.struct(F.lit(2).alias("rank"), i.alias("para"), j.alias("line"), norm(x).alias("norm")))))
    whole = F.array(F.struct(F.lit(0).alias("rank"), F.lit(-1).alias("para"), F.lit(-1).alias("line"), norm(F.array_join("contents", " ")).alias("norm")))
    df = df.select("conv", "turn", "first_line", "level", F.explode(F.concat(whole, some, single)).alias("p")).select("conv", "turn", "first_line", "level", "p.*")
    return df.where("norm <> ''").withColumns({"hash": F.sha2("norm", 256), "words": F.size(F.split("norm", " "))})


def originals(df: DataFrame) -> DataFrame:
    """(conv, turn, hash, whole) of all pieces of messages' own words; whole: it is all that the message says."""
    own = df.where("turn is not null").withColumn("own", kept_lines())
    blank = F.transform("lines", lambda x, i: F.when(announces(x, i), x.withField("content", F.lit(""))).otherwise(x))
    part = pieces(runs(own.withColumn("lines", blank)).where("level = 0")).select("conv", "turn", "hash", F.lit(False).alias("whole"))
    said = own.select("conv", "turn", norm(F.array_join(F.transform("own", lambda x: x["content"]), " ")).alias("norm")).where("norm <> ''")
    return part.union(said.select("conv", "turn", F.sha2("norm", 256).alias("hash"), F.lit(True).alias("whole")))


def linked(messages: DataFrame) -> DataFrame:
    """A row per quoted piece that settles where its passage comes from: conv, k, turn, first_line, level, rank, words, and
    the message (to_conv, to_turn) whose words it repeats; null if there is none."""
    df = parsed(messages.where("turn is not null"))
    asked = pieces(runs(df.where(F.exists("lines", lambda x: x["level"] > 0))).where("level > 0")).distinct()
    asked = written(asked, "quotes").withColumn("k", F.expr(CONV))
    own = originals(df).join(asked.select("hash").distinct(), "hash", "left_semi")
    here = own.groupBy("conv", "hash").agg(F.min("turn").alias("first"), F.min(F.when(F.col("whole"), F.col("turn"))).alias("said"))
    here = written(here.withColumn("k", F.expr(CONV)), "originals")
    anywhere = here.groupBy("hash").agg(F.min(F.struct("first", "k", "conv")).alias("o")).selectExpr("hash", "o.conv as any_conv", "o.first as any_turn")
    out = asked.join(here.selectExpr("k", "hash", "first", "said"), ["k", "hash"], "left").join(anywhere, "hash", "left")
    near, far = f"case when words >= {LEAST} then first else said end", f"words >= {LEAST} and any_conv is distinct from conv"
    out = out.withColumn("near", F.expr(near)).withColumns({
        "to_conv": F.expr(f"case when near < turn then conv when {far} then any_conv end"),
        "to_turn": F.expr(f"case when near < turn then near when {far} then any_turn end"),
    })
    # A paragraph counts where its passage is linked to nothing, a line where its paragraph isn't either.
    out = out.withColumn("hit", F.expr("to_turn is not null"))
    passage = out.where("rank = 0 and hit").select("k", "turn", "first_line", F.lit(True).alias("p")).distinct()
    paragraph = out.where("rank = 1 and hit").select("k", "turn", "first_line", "para", F.lit(True).alias("q")).distinct()
    out = out.join(passage, ["k", "turn", "first_line"], "left").join(paragraph, ["k", "turn", "first_line", "para"], "left")
    out = out.where("case rank when 0 then p when 1 then p is null and q else p is null and q is null end")
    return out.select("conv", "k", "turn", "first_line", "level", "rank", "words", "hash", "to_conv", "to_turn")


def threads(parents: DataFrame) -> DataFrame:
    """parents (k, turn, parent) with the root's turn and the depth of each reply, by doubling pointers."""
    at = written(parents.selectExpr("k", "turn", "parent as up", "1 as steps"), "threads")
    while True:
        next_ = at.selectExpr("k", "turn as up", "up as upper", "steps as more")
        at2 = written(at.join(next_, ["k", "up"], "left").selectExpr("k", "turn", "coalesce(upper, up) as up", "steps + coalesce(more, 0) as steps", "upper is not null as moved"), "threads")
        moved = at2.where("moved").isEmpty()
        at = at2.drop("moved")
        if moved:
            return at.selectExpr("k", "turn", "up as root_turn", "steps as depth")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: what it replies to, its thread and depth, its quotes, and its text without them.

    quoted_words counts the words of pieces that settle a passage, linked_words those that are linked.
    Order by conv_id, root_turn, turn for the conversations in reply order.
    """
    df = messages.select(messages["conv_id"].alias("conv"), messages["turn"].alias("turn"), messages["role"].alias("role"), messages["text"].alias("text"))
    links = written(linked(df), "links")
    votes = links.where("level = 1 and to_turn is not null and to_conv <=> conv").groupBy("k", "turn", "to_turn").agg(F.sum("words").alias("n"))
    parents = votes.groupBy("k", "turn").agg(F.max(F.struct("n", "to_turn")).alias("best")).selectExpr("k", "turn", "best.to_turn as parent")
    parents = written(parents, "parents")
    counts = links.groupBy("k", "turn").agg(F.sum("words").alias("quoted_words"), F.coalesce(F.sum(F.expr("case when to_turn is not null then words end")), F.lit(0)).alias("linked_words"), F.max("level").alias("max_level"))
    told = counts.join(parents, ["k", "turn"], "left").join(threads(parents), ["k", "turn"], "left")
    out = parsed(df).withColumn("k", F.expr(CONV)).join(told, ["k", "turn"], "left")
    clean = F.when(F.col("text").isNull(), None).otherwise(F.regexp_replace(F.array_join(F.transform(kept_lines(), lambda x: x["content"]), "\n"), r"^\s+|\s+$", ""))
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "role", F.col("parent").alias("reply_to"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("quoted_words", F.lit(0)).cast("long").alias("quoted_words"), F.coalesce("linked_words", F.lit(0)).cast("long").alias("linked_words"), F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"), clean.alias("text"),
    )


def in_reply_order(messages: DataFrame) -> DataFrame:
    """conversations() sorted over all tasks; a long conversation may span several."""
    keys = [F.col(c).asc_nulls_last() for c in ("conv_id", "root_turn", "turn")]
    return conversations(messages).repartitionByRange(*keys).sortWithinPartitions(*keys)


def op4(spark, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
