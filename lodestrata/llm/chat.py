"""Chat formatting: quoted passages are linked to the messages they quote, and conversations come without quotes, in the
order of replies.

A message's lines are cut into runs of equal quote level (the number of > before a line). Runs of level 0 are its body,
the others its quoted passages. Passages and bodies are normalised (white space collapsed, lower case, blank lines aside)
and cut into parts, each hashed to 128 bits: the whole, paragraphs, lines, and runs of 2, 4, 8 ... lines (of a body all
runs of a length that some passage asks for; of a passage the first and the last of the longest length; a run only equals
runs of the same lines). A join on the hash finds the message that a part is from: the earliest one before it in its own conversation, else the earliest one of
any other conversation. A passage is from the message that it is a whole part of, else from the one that most characters
of its parts are from (on a tie the one of the earliest such part). The first linked passage of the lowest level gives the
message that this one replies to; without one it replies to the turn before it.

Replies make trees. A message's thread is the root of its tree, its depth the number of replies up to it, its position its
place in the thread when each answer is followed by all that answers it before the next one comes (answers to one message
in order of conv_id and turn, however many there are: they are put in order by ranges). Ordered by
(thread_conv, thread_turn, position) each conversation and each branch of it stands together, every message after what it
replies to. Where quotations between conversations run in a circle, the smallest (conv_id, turn) at which a run begins there
replies to nothing.

Only DataFrame operations; no Python runs on executors. Originals are reduced to one row a hash (and conversation) before
the join, with copies combined in each task; of each hash the earliest rows of the two first conversations are kept, as
one of them may be the passage's own. Turns are numbered in buckets of BUCKET turns, so that a window over a conversation
sees its buckets only; trees are walked by doubling over runs of consecutive turns, not over messages: positions are
running sums along the tour that enters and leaves each run between two branchings, in as many joins as the logarithm of the
longest tour, and none where nothing is quoted.

Defined results: a null text is an empty body; a null conv_id or turn links with nothing, replies to nothing and has no
thread; rows that share conv_id and turn are one message to all links, and are formatted each; blank passages are not
linked; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import drop_folder, materialise, work_folder

MARK = r"^((?:[ \t]{0,3}>)+)[ \t]?"
QUOTING = r"(?:^|\n)[ \t]{0,3}>"
BLANKS = " \t\n\x0b\f\r"
#: Turns of a bucket, a power of two.
BITS = 7
BUCKET = 1 << BITS
#: Answers that are put in order by one task, about; results do not depend on it.
SIBLINGS = 1 << 16


def _normal(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, r"[\t-\r\x{85}\p{Z}]+", " ")))


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: what a lambda captures would be computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _doubled(lines: Column, steps: Column, wanted: Column | None = None) -> Column:
    """Keys of runs of 2 ** steps lines, by place; or of all runs of the wanted lengths. A run's key is made from those of
    its halves, so that all places cost one pass a step."""
    level = F.transform(lines, _key)

    def next_level(level, half):
        rest = F.greatest(F.size(level) - half, F.lit(0))
        return F.zip_with(F.slice(level, 1, rest), F.slice(level, half + 1, rest), lambda x, y: F.struct(F.xxhash64(x["a"], y["a"]).alias("a"), F.xxhash64(x["b"], y["b"], F.lit(1)).alias("b")))

    half = lambda k: F.pow(F.lit(2.0), k - 1).cast("int")
    ks = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    if wanted is None:
        return F.aggregate(ks, level, lambda acc, k: next_level(acc, half(k)))
    none = F.filter(level, lambda x: F.lit(False))

    def both(acc, k):
        return let(next_level(acc["level"], half(k)), lambda new: F.struct(new.alias("level"), F.when(F.array_contains(wanted, half(k + 1)), F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out")))

    return F.aggregate(ks, F.struct(level.alias("level"), none.alias("out")), both)["out"]


def _steps(lines: Column) -> Column:
    """The exponent of the largest power of two that is not over the number of lines."""
    return F.floor(F.log2(F.greatest(F.size(lines), F.lit(1)) + F.lit(0.5))).cast("int")


def _parts(text: Column, wanted: Column | None = None) -> Column:
    """array of (key, n): the whole text, its paragraphs, its runs of lines (the first and last of the longest length, or
    all of the wanted lengths) and its lines, normalised, without blank ones."""

    def of(lines):
        paragraphs = F.transform(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda p: F.btrim(F.translate(p, "\n", " ")))
        part = lambda x: F.struct(_key(x).alias("key"), F.char_length(x).alias("n"))

        def cut(full):
            whole = F.transform(F.filter(F.concat(F.array(F.array_join(full, " ")), paragraphs), lambda x: x != ""), part)
            if wanted is not None:
                steps = F.least(_steps(full), F.floor(F.log2(F.coalesce(F.array_max(wanted), F.lit(1)) + F.lit(0.5))).cast("int"))
                runs = F.transform(_doubled(full, steps, wanted), lambda k: F.struct(k.alias("key"), F.lit(0).alias("n")))
            else:
                length = lambda first, n: (F.aggregate(F.transform(F.slice(full, first, n), F.char_length), F.lit(0), lambda a, x: a + x) + n - 1)
                n = F.pow(F.lit(2.0), _steps(full)).cast("int")
                ends = lambda keys: F.array(F.struct(F.get(keys, F.lit(0)).alias("key"), length(F.lit(1), n).alias("n")), F.struct(F.get(keys, F.size(keys) - 1).alias("key"), length(F.size(full) - n + 1, n).alias("n")))
                runs = F.when(F.size(full) > 1, let(_doubled(full, _steps(full)), ends)).otherwise(F.array().cast("array<struct<key:struct<a:bigint,b:bigint>,n:int>>"))
            return F.concat(whole, runs, F.transform(full, part))

        return let(F.filter(lines, lambda x: x != ""), cut)

    return let(F.transform(F.split(text, "\n"), _normal), of)


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, passages: array of (pos, level, passage), the levels in order of lines."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n", "\n")
    rows = messages.select("conv_id", "turn", "role", text.alias("plain"), F.rlike(F.coalesce("text", F.lit("")), F.lit(QUOTING)).alias("quotes"))
    marks = F.transform(F.when(F.col("quotes"), F.split("plain", "\n")), lambda x: F.struct(F.char_length(F.regexp_replace(F.regexp_extract(x, MARK, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARK, "").alias("rest")))

    def runs(marked):
        level = lambda i: F.get(marked, i)["level"]
        starts = F.filter(F.sequence(F.lit(0), F.size(marked) - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
        return let(starts, lambda starts: F.transform(starts, lambda b, k: F.struct(k.alias("pos"), level(b).alias("level"), F.array_join(F.transform(F.slice(marked, b + 1, F.coalesce(F.get(starts, k + 1), F.size(marked)) - b), lambda x: x["rest"]), "\n").alias("passage"))))

    rows = rows.select("conv_id", "turn", "role", "plain", let(marks, runs).alias("runs"))
    body = F.coalesce(F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["passage"]), "\n"), F.col("plain"))
    passages = F.coalesce(F.filter("runs", lambda r: r["level"] > 0), F.array().cast("array<struct<pos:int,level:int,passage:string>>"))
    return rows.select("conv_id", "turn", "role", F.btrim(body, F.lit(BLANKS)).alias("body"), passages.alias("passages"))


def _at(conv: str = "conv_id", turn: str = "turn") -> Column:
    return F.struct(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"))


def links(messages: DataFrame, folder: str) -> DataFrame | None:
    """conv_id, turn, target (conv_id, turn), n_linked of the messages with linked passages; None if nothing is quoted."""
    quoting = messages.filter(F.rlike("text", F.lit(QUOTING)) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    passages = parsed(quoting).select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.pos", "p.level", _parts(F.col("p.passage")).alias("parts"), F.size(F.filter(F.transform(F.split("p.passage", "\n"), _normal), lambda x: x != "")).alias("lines"))
    quoted = passages.select("conv_id", "turn", "pos", "level", "lines", F.posexplode("parts").alias("part", "p")).select("conv_id", "turn", "pos", "level", "lines", "part", "p.key", "p.n")
    quoted = quoted.groupBy("conv_id", "turn", "pos", "level", "key").agg(F.max("lines").alias("lines"), F.min("part").alias("part"), F.max("n").alias("n"))
    quoted = materialise(quoted, f"{folder}/quoted")
    if quoted.isEmpty():
        return None
    longest = F.floor(F.log2(F.col("lines") + F.lit(0.5))).cast("int")
    steps = sorted(r[0] for r in quoted.filter("lines > 1").select(longest.alias("k")).distinct().collect())  # 31 at most
    wanted = F.array(*(F.lit(2**k) for k in steps)) if steps else F.array().cast("array<int>")
    bodies = parsed(messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()))
    keys = F.transform(_parts(F.col("body"), wanted), lambda p: p["key"])
    here = bodies.select("conv_id", "turn", F.explode(keys).alias("key")).groupBy("conv_id", "key").agg(F.min("turn").alias("here_turn"))
    here = here.join(quoted.select("key").distinct(), "key", "left_semi")  # goes below the groups where the keys are few
    here = materialise(here, f"{folder}/here")
    # The limit is applied in each task before the exchange, so that a key passes on two rows a task.
    place = F.row_number().over(Window.partitionBy("key").orderBy("conv_id"))
    two = here.withColumn("place", place).filter("place <= 2")
    first = two.groupBy("key").agg(F.min(_at(turn="here_turn")).alias("first"), F.max(_at(turn="here_turn")).alias("second"))
    found = quoted.join(here, ["conv_id", "key"], "left").join(first, "key", "left")
    own = F.when(F.col("here_turn") < F.col("turn"), _at(turn="here_turn"))
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).when(F.col("second.conv_id") != F.col("conv_id"), F.col("second"))
    found = found.withColumn("target", F.coalesce(own, other)).filter("target is not null")
    agreed = found.groupBy("conv_id", "turn", "level", "pos", "target").agg(F.min("part").alias("part"), F.sum("n").alias("n"))
    best = agreed.groupBy("conv_id", "turn", "level", "pos").agg(F.min_by("target", F.struct(F.col("part") > 0, -F.col("n"), "part", "target")).alias("target"))
    replies = best.groupBy("conv_id", "turn").agg(F.min_by("target", F.struct("level", "pos")).alias("target"), F.count_distinct("pos").alias("n_linked"))
    replies = materialise(replies, f"{folder}/replies")
    for name in ("quoted", "here"):
        drop_folder(messages.sparkSession, f"{folder}/{name}")
    return replies


def places(messages: DataFrame, replies: DataFrame | None) -> DataFrame:
    """conv_id, turn, before (the turn before it), rank in its conversation, head and head_rank of its run: the turns from
    one that replies by a quotation, or begins its conversation, up to the next such one."""
    turn = F.col("turn").cast("long")
    rows = messages.filter("conv_id is not null and turn is not null").select("conv_id", turn.alias("turn"), F.lit(False).alias("replies"))
    if replies is not None:
        rows = rows.unionByName(replies.select("conv_id", turn.alias("turn"), F.lit(True).alias("replies")))
    rows = rows.groupBy("conv_id", F.shiftright("turn", BITS).alias("bucket")).agg(F.array_sort(F.collect_set("turn")).alias("turns"), F.collect_set(F.when(F.col("replies"), F.col("turn"))).alias("heads"))
    over = Window.partitionBy("conv_id").orderBy("bucket")
    rows = rows.withColumns({"last": F.lag(F.array_max("turns")).over(over), "base": F.coalesce(F.sum(F.size("turns")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rows = rows.withColumn("heads", F.when(F.col("last").isNull(), F.array_union("heads", F.slice("turns", 1, 1))).otherwise(F.col("heads")))
    rows = rows.withColumn("heads", F.transform(F.array_sort("heads"), lambda h: F.struct(h.alias("turn"), (F.col("base") + F.array_position("turns", h) - 1).alias("rank"))))
    rows = rows.withColumn("carried", F.last(F.get("heads", F.size("heads") - 1), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    each = F.transform("turns", lambda t, i: F.struct(t.alias("turn"), F.coalesce(F.get("turns", i - 1), F.col("last")).alias("before"), (F.col("base") + i).alias("rank"), F.coalesce(F.array_max(F.filter("heads", lambda h: h["turn"] <= t)), F.col("carried")).alias("head")))
    rows = rows.select("conv_id", F.explode(each).alias("x"))
    return rows.select("conv_id", "x.turn", "x.before", "x.rank", F.col("x.head.turn").alias("head"), F.col("x.head.rank").alias("head_rank"))


def _roots(steps: DataFrame, folder: str) -> tuple[DataFrame, DataFrame | None]:
    """Of steps (node, up, depth) the nodes with their root and its distance, by doubling; or, if some run in circles, the
    smallest node of each circle instead (then the first table is of no use)."""
    spark, n = steps.sparkSession, 0
    steps = materialise(steps.withColumn("low", F.col("node")), f"{folder}/0")
    rounds = steps.count().bit_length() + 1
    while True:
        above = steps.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("low").alias("low2"))
        both = steps.join(above, "up", "left")
        new = both.select("node", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.least("low", "low2").alias("low"), F.col("up2").isNotNull().alias("moved"))
        n += 1
        new = materialise(new, f"{folder}/{n}")
        moved = not new.filter("moved").isEmpty()
        drop_folder(spark, f"{folder}/{n - 1}")
        steps = new.drop("moved")
        if not moved:
            return steps, None
        if n > rounds:  # every path is longer than there are nodes: what it reaches lies in a circle, which low has seen whole
            reached = new.filter("moved").select(F.col("up").alias("node")).distinct()
            return steps, steps.join(reached, "node", "left_semi").select(F.col("low").alias("node")).distinct()


def threads(spots: DataFrame, replies: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """node (conv_id, turn: a run's head), up (its thread's root), depth; and the replies without those that close a circle."""
    where = spots.select(_at().alias("target"), _at(turn="head").alias("up"), (F.col("rank") - F.col("head_rank") + 1).alias("depth"))
    to = replies.select(F.struct("conv_id", F.col("turn").cast("long").alias("turn")).alias("node"), F.struct("target.conv_id", F.col("target.turn").cast("long").alias("turn")).alias("target"))
    steps = materialise(to.join(where, "target").select("node", "up", "depth"), f"{folder}/steps")
    found, circles = _roots(steps, f"{folder}/roots")
    if circles is not None:
        circles = materialise(circles, f"{folder}/circles")
        found, _ = _roots(steps.join(circles, "node", "left_anti"), f"{folder}/again")
        drop_folder(replies.sparkSession, f"{folder}/roots")
        cut = circles.select("node.conv_id", F.col("node.turn").cast(replies.schema["turn"].dataType).alias("turn"), F.lit(True).alias("cut"))
        replies = replies.join(cut, ["conv_id", "turn"], "left").withColumn("target", F.when(F.col("cut").isNull(), F.col("target"))).drop("cut")
    return found, replies


def _before(runs: DataFrame, folder: str) -> DataFrame:
    """node, prev of runs (node, up) that answer something: the answer to the same message before each, null for the first.
    A range of (up, node) is one task's work; the first answer in a range comes after the last one in the range before."""
    ranges = -(-runs.count() // SIBLINGS)
    runs = runs.select("node", "up").repartitionByRange(max(1, ranges), "up", "node").withColumn("part", F.spark_partition_id())
    runs = materialise(runs, folder)  # where ranges end is settled once
    groups = runs.groupBy("up", "part").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    bridges = groups.select("node", F.lag("last").over(Window.partitionBy("up").orderBy("part")).alias("bridge")).filter("bridge is not null")
    runs = runs.select("node", "up", F.lag("node").over(Window.partitionBy("up", "part").orderBy("node")).alias("prev"))
    return runs.join(bridges, "node", "left").select("node", "up", F.coalesce("prev", "bridge").alias("prev"))


def positions(spots: DataFrame, folder: str) -> DataFrame:
    """conv_id, turn, position of spots (conv_id, turn, before, target, cut)."""
    spark = spots.sparkSession
    quotes = F.col("target").isNotNull()
    target = F.struct(F.col("target.conv_id").alias("conv_id"), F.col("target.turn").cast("long").alias("turn"))
    up = F.when(quotes, target).when(F.col("before").isNotNull() & ~F.col("cut"), _at(turn="before"))
    nodes = materialise(spots.select("conv_id", "turn", up.alias("up"), quotes.alias("quotes")), f"{folder}/nodes")
    # Runs end where answers part; a run begins at what answers nothing, quotes, or is not the only answer.
    parting = nodes.filter("up is not null").groupBy("up").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    heads = nodes.filter("quotes or up is null").unionByName(nodes.filter("not quotes and up is not null").join(parting, "up", "left_semi").select(nodes.columns))
    at = materialise(places(nodes, heads.select("conv_id", "turn")), f"{folder}/runs")
    runs = at.groupBy("conv_id", "head").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("head", "turn").join(nodes, ["conv_id", "turn"]).select(_at().alias("node"), "size", "up")
    ends = at.select(_at().alias("up"), _at(turn="head").alias("above"))
    runs = materialise(runs.join(ends, "up", "left").select("node", "size", F.col("above").alias("up")), f"{folder}/tree")
    answers = materialise(_before(runs.filter("up is not null"), f"{folder}/ranges"), f"{folder}/answers")
    drop_folder(spark, f"{folder}/ranges")
    # The last answer is the one that comes before no other.
    last = answers.join(answers.select(F.col("prev").alias("node")), "node", "left_anti").select(F.col("up").alias("node"), F.col("node").alias("last"))
    runs = runs.join(answers.select("node", "prev"), "node", "left").join(last, "node", "left").filter("up is not null or last is not null")
    item = lambda node, left: F.when(node.isNotNull(), F.struct(node.alias("node"), F.lit(left).alias("left")))
    c = F.col
    enter = F.struct(item(c("node"), False).alias("item"), F.coalesce(item(c("prev"), True), item(c("up"), False)).alias("after"), c("size").alias("sum"))
    leave = F.struct(item(c("node"), True).alias("item"), F.coalesce(item(c("last"), True), item(c("node"), False)).alias("after"), F.lit(0).cast("long").alias("sum"))
    tour, n = materialise(runs.select("size", F.explode(F.array(enter, leave)).alias("x")).select("size", "x.*"), f"{folder}/tour0"), 0
    while not tour.filter("after is not null").isEmpty():
        ahead = tour.select(c("item").alias("after"), c("after").alias("next"), c("sum").alias("more"))
        going = tour.filter("after is not null").join(ahead, "after").select("size", "item", c("next").alias("after"), (c("sum") + c("more")).alias("sum"))
        n += 1
        tour = materialise(going.unionByName(tour.filter("after is null")), f"{folder}/tour{n}")
        drop_folder(spark, f"{folder}/tour{n - 1}")
    starts = tour.filter("not item.left").select("item.node.conv_id", c("item.node.turn").alias("head"), (c("sum") - c("size")).alias("start"))
    return at.join(starts, ["conv_id", "head"], "left").select("conv_id", "turn", (F.coalesce("start", F.lit(0)) + c("rank") - c("head_rank")).cast("long").alias("position"))


def format_chats(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, body, n_passages, n_linked, max_level, reply_conv, reply_turn, reply_by (quote, turn
    or null), thread_conv, thread_turn, depth, position. conversations() puts the rows in order."""
    folder = work_folder(messages.sparkSession)
    rows = parsed(messages)
    replies = links(messages, folder)
    spots = places(messages, replies)
    kind = messages.schema["turn"].dataType
    if replies is None:
        spots = spots.withColumns({"target": F.lit(None).cast(f"struct<conv_id:{messages.schema['conv_id'].dataType.simpleString()},turn:{kind.simpleString()}>"), "n_linked": F.lit(None).cast("long"), "thread": _at(turn="head"), "up_depth": F.lit(0)})
        spots = spots.withColumns({"cut": F.lit(False), "position": (F.col("rank") - F.col("head_rank")).cast("long")})
    else:
        spots = materialise(spots, f"{folder}/places")
        found, left = threads(spots, replies, folder)
        found = found.select("node.conv_id", F.col("node.turn").alias("head"), F.col("up").alias("thread"), F.col("depth").alias("up_depth"))
        spots = spots.join(found, ["conv_id", "head"], "left").join(left.withColumns({"turn": F.col("turn").cast("long"), "cut": F.col("target").isNull()}), ["conv_id", "turn"], "left")
        spots = spots.withColumns({"thread": F.coalesce("thread", _at(turn="head")), "up_depth": F.coalesce("up_depth", F.lit(0)), "cut": F.coalesce("cut", F.lit(False))})
        spots = materialise(spots, f"{folder}/threads")
        spots = spots.join(positions(spots, f"{folder}/order"), ["conv_id", "turn"])
    spots = spots.withColumn("depth", (F.col("up_depth") + F.col("rank") - F.col("head_rank")).cast("long"))
    out = rows.join(spots.withColumn("turn", F.col("turn").cast(kind)).select("conv_id", "turn", "before", "target", "n_linked", "thread", "depth", "cut", "position"), ["conv_id", "turn"], "left")
    quote, turn = F.col("target").isNotNull(), F.col("before").isNotNull() & ~F.col("cut")
    return out.select(
        "conv_id", "turn", "role", "body", F.size("passages").cast("long").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).cast("long").alias("max_level"),
        F.when(quote, F.col("target.conv_id")).when(turn, F.col("conv_id")).alias("reply_conv"),
        F.when(quote, F.col("target.turn")).when(turn, F.col("before").cast(kind)).alias("reply_turn"),
        F.when(quote, "quote").when(turn, "turn").alias("reply_by"),
        F.col("thread.conv_id").alias("thread_conv"), F.col("thread.turn").cast(kind).alias("thread_turn"), "depth", "position",
    )


def conversations(formatted: DataFrame) -> DataFrame:
    """Formatted messages in the order of replies, branch by branch: ranges of (thread, position), so that a conversation of
    any size stands in neighbouring partitions, each in order."""
    order = ["thread_conv", "thread_turn", "position", "conv_id", "turn"]
    return formatted.repartitionByRange(*order).sortWithinPartitions(*order)
