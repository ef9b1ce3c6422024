"""Operator 2: quotation linking, DataFrame operations only.

Lines are parsed into nested quote levels, runs of lines of one level become passages, and hashes of
the normalised quoted passages are joined to the earliest message of the conversation that wrote the
passage itself. The message quoted outermost is the one replied to; messages come back without their
quotes and in the order of replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import stage, table, text_or_empty

MARKS = r"^(?:[ \t]*>)+"


def normal(passage: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(passage), r"\s+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """rid, conv_id, turn, role, passages array<struct<depth, passage>> of each message, body: its own lines.

    A passage ends where the level changes and at lines without text; those without text are left out.
    """
    lines = F.split(text_or_empty(), "\r?\n")
    held = messages.select("conv_id", "turn", "role", lines.alias("lines")).withColumn("rid", F.monotonically_increasing_id())
    held = held.withColumn("depths", F.transform("lines", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, f"({MARKS})", 1), "[^>]", ""))))
    held = held.withColumn("contents", F.transform("lines", lambda x: F.regexp_replace(x, MARKS + " ?", "")))
    held = held.withColumn("blank", F.transform("contents", lambda x: F.trim(x) == ""))
    begins = "filter(sequence(0, size(lines) - 1), i -> i = 0 or depths[i] <> depths[i - 1] or blank[i] or blank[i - 1])"
    held = held.withColumn("begins", F.expr(begins))
    passages = """filter(transform(begins, (b, k) -> struct(depths[b] as depth,
        array_join(slice(contents, b + 1, coalesce(get(begins, k + 1), size(lines)) - b), '\n') as passage)), p -> trim(p.passage) <> '')"""
    own = "array_join(transform(filter(sequence(0, size(lines) - 1), i -> depths[i] = 0), i -> lines[i]), '\n')"
    return held.select("rid", "conv_id", "turn", "role", F.expr(passages).alias("passages"), F.regexp_replace(F.expr(own), r"^\s+|\s+$", "").alias("body"))


def link(messages: DataFrame) -> DataFrame:
    """Per row: conv_id, turn, role, reply_to (turn), thread (turn of its first message), reply_depth, n_quotes, n_linked, body.

    messages: conv_id, turn, role, text. A quoted passage is linked with the earliest turn below the
    quoting one, in the same conversation, that wrote it unquoted. Of the linked passages the
    outermost count, among them the latest turn is replied to. Messages without a link, and those
    whose conv_id or turn is null, begin a thread. Repeated rows stay; rows of one turn share the
    latest reply_to. An empty table gives no rows.
    """
    parsed = stage(parse(messages), "op2-parsed")
    pieces = parsed.select("rid", "conv_id", "turn", F.explode("passages").alias("p")).select("rid", "conv_id", "turn", "p.depth", F.xxhash64(normal(F.col("p.passage"))).alias("h1"), F.substring(F.sha2(normal(F.col("p.passage")), 256), 1, 16).alias("h2"))
    origins = pieces.where("depth = 0").groupBy("conv_id", "h1", "h2").agg(F.min("turn").alias("origin"))
    quotes = pieces.where("depth > 0")
    found = quotes.join(origins, ["conv_id", "h1", "h2"]).where("origin < turn")
    per_row = found.groupBy("rid").agg(F.max(F.struct((-F.col("depth")).alias("near"), "origin")).alias("best"), F.count("*").alias("n_linked"))
    rows = parsed.withColumn("n_quotes", F.size(F.filter("passages", lambda p: p["depth"] > 0)).cast("long")).drop("passages")
    rows = rows.join(per_row, "rid", "left").select("conv_id", "turn", "role", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("best.origin").alias("own_reply"), "body")
    rows = stage(rows, "op2-rows")
    tree = rows.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.max("own_reply").alias("reply_to"))
    placed = roots(tree)
    return rows.join(placed, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("reply_depth", F.lit(0)).cast("long").alias("reply_depth"), "n_quotes", "n_linked", "body")


def roots(tree: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread, reply_depth: each message's first ancestor, by doubling the reply pointers.

    A reply goes to an earlier turn, so rounds number the logarithm of the longest chain; only messages
    whose first ancestor isn't known yet take part in a round.
    """
    columns = ["conv_id", "turn", "reply_to", "thread", "reply_depth", "open"]
    began = F.col("reply_to").isNotNull()
    state = stage(tree.select("conv_id", "turn", "reply_to", F.coalesce("reply_to", "turn").alias("thread"), began.cast("long").alias("reply_depth"), began.alias("open")), "op2-roots")
    while not state.where("open").isEmpty():
        ahead = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("beyond"), F.col("reply_depth").alias("more"), F.col("open").alias("beyond_open"))
        moved = state.where("open").drop("open").join(ahead, ["conv_id", "thread"]).select("conv_id", "turn", "reply_to", F.col("beyond").alias("thread"), (F.col("reply_depth") + F.col("more")).alias("reply_depth"), F.col("beyond_open").alias("open"))
        state = stage(state.where("not open").select(columns).unionByName(moved.select(columns)), "op2-roots")
    return state.drop("open")


def in_reply_order(linked: DataFrame) -> DataFrame:
    """Adds position: the message's place in its conversation by (thread, reply_depth, turn).

    Rows are range-sorted and numbered a partition at a time, so one very long conversation is spread
    over tasks; what lies ahead of a partition is a sum over one row a partition.
    """
    order = ["conv_id", "thread", "reply_depth", "turn", "role", "body"]
    ranged = linked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    held = stage(ranged.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.expr("at & ((1L << 33) - 1)")), "op2-order")
    sizes = held.groupBy("part").agg(F.count("*").alias("n")).select("part", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("ahead"))
    numbered = held.join(F.broadcast(sizes), "part").withColumn("place", F.col("ahead") + F.col("at"))  # one row a partition
    first = numbered.groupBy("conv_id").agg(F.min("place").alias("first"))
    both = numbered.withColumnRenamed("conv_id", "c").join(first, F.col("c").eqNullSafe(F.col("conv_id")))
    return both.select(F.col("c").alias("conv_id"), "turn", "role", (F.col("place") - F.col("first")).alias("position"), "reply_to", "thread", "reply_depth", "n_quotes", "n_linked", "body")


def quoted_mail(conversations: DataFrame) -> DataFrame:
    """The conversations as mail clients write them: each message quotes the one before it, which quotes the one before that.

    Turns meet by their number, so a conversation with very many messages needs no single task.
    """
    rows = conversations.select("conv_id", "turn", "role", text_or_empty().alias("text"))
    before = rows.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))

    def earlier(n: int, name: str) -> DataFrame:
        return before.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("said").alias(name))

    held = rows.join(earlier(1, "one"), ["conv_id", "turn"], "left").join(earlier(2, "two"), ["conv_id", "turn"], "left")
    two = F.coalesce(F.concat(F.regexp_replace("two", "(?m)^", "> > "), F.lit("\n")), F.lit(""))
    one = F.coalesce(F.concat(F.regexp_replace("one", "(?m)^", "> "), F.lit("\n")), F.lit(""))
    return held.select("conv_id", "turn", "role", F.concat(two, one, F.col("text")).alias("text"))


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_reply_order(link(quoted_mail(table(spark, sf_dir, "conversations"))))
