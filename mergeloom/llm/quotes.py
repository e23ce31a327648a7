"""Conversations in reply order, with quotations linked to what they quote.

A message's lines are parsed by their quote level (``>``, ``> >``, ``>>``).  A run of
quoted lines of one level is a passage, however its lines are broken: its words are
normalised and joined, and hashed as windows of ``WORDS`` words, or whole if it has
fewer.  What messages say themselves is hashed alike: windows of their words, and
lines and sentences shorter than a window.  Each hash of a passage meets the latest
earlier message of the conversation that has it; the passage is linked to the message
that most of its hashes meet, if they are ``COVER`` of them or more.

A message replies to the latest message that it quotes at level one, or else to the
one before it.  Conversations are in reply order: answers stand in the order of what
they answer, and those to one message in the order of turns, so that a message always
follows the one that it answers.

No step has a conversation in one place: messages are numbered by sorting them in
ranges, and the latest earlier message with a hash is looked for in each range, with
the last of the ranges before it carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, ship, workspace

#: What precedes quoted text on a line: any number of > with single spaces or tabs between.
PREFIX = r"^[ \t]*((?:>[ \t]?)*)"
#: Words of a window, and the least share of a passage's hashes that its source has.
WORDS, COVER = 5, 0.5
#: ``monotonically_increasing_id`` has the partition above these bits.
PART_BITS = 33


def lines(text: Column) -> Column:
    """array<struct<n, level, line>>: numbered lines, quote levels, and what follows the marks."""
    split = F.split(F.coalesce(text.cast("string"), F.lit("")), "\r\n|\n|\r")
    marks = lambda x: F.regexp_extract(x, PREFIX, 1)
    return F.transform(split, lambda x, i: F.struct(i.alias("n"), (F.length(marks(x)) - F.length(F.replace(marks(x), F.lit(">"), F.lit("")))).alias("level"), F.regexp_replace(x, PREFIX, "").alias("line")))


def normal(text: str) -> str:
    """Lower case, with runs of other than letters and digits as one space."""
    return rf"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' '))"


def _windows(words: str) -> str:
    return f"transform(sequence(1, size({words}) - {WORDS - 1}), i -> xxhash64(array_join(slice({words}, i, {WORDS}), ' ')))"


def passage_hashes(said: str) -> Column:
    """The distinct hashes of a normalised passage."""
    return F.expr(f"transform(array(split({said}, ' ')), w -> IF(size(w) >= {WORDS}, array_distinct({_windows('w')}), array(xxhash64('=', {said}))))[0]")


def own_hashes(text: str) -> Column:
    """The distinct hashes of what a message says itself: of windows, and of shorter lines and sentences."""
    short = rf"filter(transform(concat(split({text}, '\n'), split({text}, '[.!?\n]+')), x -> {normal('x')}), x -> x != '' AND size(split(x, ' ')) < {WORDS})"
    windows = f"transform(array(split({normal(text)}, ' ')), w -> IF(size(w) >= {WORDS}, {_windows('w')}, array()))[0]"
    return F.expr(f"array_distinct(concat({windows}, transform({short}, x -> xxhash64('=', x))))")


def _own(of: Column) -> Column:
    """The unquoted lines, joined."""
    return F.array_join(F.transform(F.filter(of, lambda x: x["level"] == 0), lambda x: x["line"]), "\n")


def _same(a: str, b: str, *keys: str) -> Column:
    """Equal keys, null ones too."""
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def numbered(rows: DataFrame, order: list[str], at: str) -> DataFrame:
    """``rows`` with ``seq``, ascending with conv and ``order``, and ``place`` in the conversation, from 0; written."""
    by = ["conv", *order]
    sorted_ = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("seq", F.monotonically_increasing_id()), f"{at}-sorted")
    part = F.shiftright("seq", PART_BITS)
    # A row for each range that a conversation has messages in.
    parts = sorted_.groupBy("conv", part.alias("part")).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0)))
    placed = sorted_.withColumn("part", part).alias("r").join(parts.alias("p"), _same("r", "p", "conv", "part"))
    return materialize(placed.select(*(F.col(f"r.{c}") for c in sorted_.columns), (F.col("r.seq") - F.col("p.first") + F.col("p.before")).alias("place")), at)


def _links(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """Rows (seq, island, source) of passages(conv, seq, island, level, said) and the message that each is from."""
    part = F.shiftright("seq", PART_BITS).alias("part")
    quoted = passages.select("conv", "seq", part, "island", F.size(passage_hashes("said")).alias("of"), F.explode(passage_hashes("said")).alias("hash"))
    # Only what some passage of the conversation has is looked for.
    own = rows.alias("r").join(passages.select("conv").distinct().alias("p"), _same("r", "p", "conv"), "left_semi").select("conv", "seq", _own(F.col("lines")).alias("text"))
    own = own.select("conv", "seq", part, F.explode(own_hashes("text")).alias("hash"))
    own = own.alias("r").join(quoted.select("conv", "hash").distinct().alias("p"), _same("r", "p", "conv", "hash"), "left_semi")
    none = F.lit(None)
    events = quoted.withColumn("origin", none.cast("long")).unionByName(own.select("conv", "seq", "part", none.cast("long").alias("island"), none.cast("int").alias("of"), "hash", F.col("seq").alias("origin")))
    latest = events.groupBy("conv", "hash", "part").agg(F.max("origin").alias("last"))
    latest = latest.withColumn("carried", F.max("last").over(Window.partitionBy("conv", "hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.max("origin").over(Window.partitionBy("conv", "hash", "part").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1))
    met = events.withColumn("within", within).where("island IS NOT NULL").alias("e").join(latest.alias("l"), _same("e", "l", "conv", "hash", "part"))
    votes = met.select("e.seq", "island", "of", F.coalesce("within", "carried").alias("source")).where("source IS NOT NULL").groupBy("seq", "island", "of", "source").count()
    return votes.where(F.col("count") >= COVER * F.col("of")).groupBy("seq", "island").agg(F.max_by("source", F.struct("count", "source")).alias("source"))


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, n_quoted, n_linked, quotes, parent_turn, quoted_parent, position, formatted), one for each row of ``messages``.

    text: the lines that aren't quoted, without empty lines at either end.
    n_quoted: passages with a letter or digit; n_linked: those found in an earlier
    message; quotes: array of (level, turn, text) of these, in order, with the
    turn of that message.  parent_turn: the message replied to, null for a
    conversation's first; quoted_parent: it is known from a quotation.  position:
    from 0, the place in the conversation in reply order.  formatted: the message
    between role markers.

    Null texts are empty; rows that repeat conversation and turn come in the order
    of role and MD5 of the text, and are each a message; null turns come first,
    null conversations are one.  Hashes have 64 bits, and only those of one
    conversation meet.  Further columns are ignored; an empty table gives an empty
    result.
    """
    spark = messages.sparkSession
    ship(spark)
    at = workspace(spark, "quotes")
    parsed = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("body"))
    # The last key tells equal messages apart, so that no range is beyond splitting.
    parsed = parsed.select("conv", "turn", "role", F.md5("body").alias("digest"), F.monotonically_increasing_id().alias("row"), lines(F.col("body")).alias("lines"))
    rows = numbered(parsed, ["turn", "role", "digest", "row"], f"{at}/rows")
    keys = rows.select("seq", "conv", "turn", "place")

    quoting = rows.where(F.exists("lines", lambda x: x["level"] > 0)).select("conv", "seq", F.explode("lines").alias("l")).select("conv", "seq", "l.*")
    in_message = Window.partitionBy("seq").orderBy("n")
    changed = F.coalesce((F.col("level") != F.lag("level").over(in_message)).cast("long"), F.lit(0))
    islands = quoting.withColumn("changed", changed).withColumn("island", F.sum("changed").over(in_message)).where("level > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    passages = islands.groupBy("conv", "seq", "island", "level").agg(text.alias("text")).withColumn("said", F.expr(normal("text"))).where("said != ''")
    passages = materialize(passages, f"{at}/passages")
    if passages.isEmpty():
        told = keys.select("seq", F.lit(0).alias("n_quoted"), F.lit(0).alias("n_linked"), F.lit(None).cast("array<struct<level:int,turn:bigint,text:string>>").alias("quotes"), F.lit(None).cast("long").alias("parent")).where("false")
    else:
        links = _links(rows, passages)
        sources = links.join(keys.select(F.col("seq").alias("source"), F.col("turn").alias("said_in"), F.col("place").alias("source_place")), "source")
        found = passages.join(sources.select("seq", "island", "source", "said_in", "source_place"), ["seq", "island"], "left")
        known = F.col("source").isNotNull()
        told = found.groupBy("seq").agg(
            F.count("*").alias("n_quoted"),
            F.count("source").alias("n_linked"),
            F.transform(F.array_sort(F.collect_list(F.when(known, F.struct("island", F.col("level").cast("int").alias("level"), F.col("said_in").cast("long").alias("turn"), "text")))), lambda q: F.struct(q["level"].alias("level"), q["turn"].alias("turn"), q["text"].alias("text"))).alias("quotes"),
            F.max(F.when(F.col("level") == 1, F.col("source_place"))).alias("parent"),
        )
        told = materialize(told, f"{at}/told")
    replies = keys.join(told.select("seq", "parent"), "seq", "left").select("conv", F.coalesce("parent", F.col("place") - 1).alias("parent"), F.col("place").alias("was"), F.col("seq").alias("id"), F.col("parent").isNotNull().alias("quoted_parent"))
    ordered = numbered(replies, ["parent", "was"], f"{at}/replies")
    answered = ordered.alias("r").join(keys.alias("p"), F.col("r.conv").eqNullSafe(F.col("p.conv")) & (F.col("r.parent") == F.col("p.place")), "left").select(F.col("r.id").alias("seq"), F.col("p.turn").alias("parent_turn"), "r.quoted_parent", F.col("r.place").alias("position"))

    said = F.regexp_replace(_own(F.col("lines")), r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "")
    joined = rows.select("seq", "conv", "turn", "role", said.alias("said")).join(answered, "seq").join(told.drop("parent"), "seq", "left")
    none = F.array().cast("array<struct<level:int,turn:bigint,text:string>>")
    return joined.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("said").alias(text_col),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("quotes", none).alias("quotes"),
        "parent_turn", "quoted_parent", "position",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("said"), F.lit("\n<|end|>")).alias("formatted"),
    )
