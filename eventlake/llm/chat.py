r"""Chat formatting of reply trees (operator 1).

Root-to-leaf paths come from iterative self-joins that double: after round k
each message knows its 2**k-th ancestor and the score on the way, so a tree of
depth d takes log2(d) rounds, and the same tables, read backwards, spread a
chosen leaf into its path.  Branches are ranked by mean score, then length,
then the leaf's id; each chosen path becomes one conversation.

Template: ``<s>`` and, for each turn, ``[INST]`` role, line end, text ``[/INST]``, then ``</s>``.  In roles and texts
``\`` becomes ``\\``, ``<`` becomes ``\l`` and ``[`` becomes ``\b`` (in roles a line end also becomes ``\n``), so
no control string can stand inside one, and ``read_chats`` gets all of them back.

Contract: a null text or role is "", a null tree id is a tree of its own, a row without message
id is dropped.  Rows that repeat a message id count once (the least parent, role, text).  A parent that is missing, of
another tree or null makes a root.  Messages on or below a cycle reach no root and are left out.  Null scores are
0.  An empty table gives no conversations; columns not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.rows import materialize

#: Fixed values of the template.
BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """Each escape has two characters, so pairs of backslashes are found from the left."""
    simple = lambda part: F.replace(F.replace(part, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), simple), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))), "\\")


def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit("null"))


def ancestor_tables(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """``nodes``: t, m, p (null at roots), s.

    Jump table k has the messages with a 2**k-th ancestor: t, m, j (it), n and total (messages and score on the way, without it).  The
    second result has the messages that reach a root: t, m, n, total of the whole way.  A round joins only messages that have not arrived.
    """
    start = materialize(nodes.select("t", "m", F.col("p").alias("j"), F.lit(1).cast("long").alias("n"), F.col("s").alias("total")), "chat-jumps")
    arrived, active = start.where("j is null").drop("j"), start.where("j is not null")
    rows = start.count()
    jumps: list[DataFrame] = []
    while not active.isEmpty():
        jumps.append(active)
        if 1 << len(jumps) > 2 * rows:  # only cycles go on for so long
            break
        a, b = active.alias("a"), arrived.withColumn("j", F.lit(None).cast(dict(start.dtypes)["j"])).unionByName(active).alias("b")
        joined = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.j") == F.col("b.m")))
        way = lambda c: (F.col(f"a.{c}") + F.col(f"b.{c}")).alias(c)
        further = materialize(joined.select("a.t", "a.m", F.col("b.j").alias("j"), way("n"), way("total")), "chat-jumps")
        arrived, active = arrived.unionByName(further.where("j is null").drop("j")), further.where("j is not null")
    return jumps, arrived


def format_chats(df: DataFrame, tree: str, message: str, parent: str, role: str, text: str, score: str | None = None, branches: int = 1) -> DataFrame:
    """The ``branches`` best paths of each tree: tree, branch (from 1), leaf, n_turns, score, chat, loss_spans."""
    kind = dict(df.dtypes)
    value = F.coalesce(F.col(f"`{score}`").cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    picked = df.select(_key(tree).alias("t"), F.col(f"`{tree}`").alias("tree"), F.col(f"`{message}`").alias("m"), F.col(f"`{parent}`").cast(kind[message]).alias("p"), empty(role).alias("role"), empty(text).alias("text"), value.alias("s")).where("m is not null")
    rows = picked.groupBy("t", "m").agg(F.min(F.struct("p", "role", "text", "s", "tree")).alias("x")).select("t", "m", "x.*")
    rows = materialize(rows, "chat-rows")

    known = rows.select("t", F.col("m").alias("p"), F.lit(True).alias("found"))
    nodes = rows.select("t", "m", "p", "s").join(known, ["t", "p"], "left").select("t", "m", F.when(F.col("found"), F.col("p")).alias("p"), "s")
    jumps, whole = ancestor_tables(nodes)

    parents = nodes.where("p is not null").select("t", F.col("p").alias("m"))
    rank = Window.partitionBy("t").orderBy(F.desc(F.col("total") / F.col("n")), F.desc("n"), "m")
    leaves = whole.join(parents, ["t", "m"], "left_anti").withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    path = materialize(leaves.select("t", "branch", F.col("m").alias("leaf"), (F.col("total") / F.col("n")).alias("score"), "n", "m", F.lit(0).cast("long").alias("up")), "chat-paths")
    # A path holds every 2**(k+1)-th ancestor before step k and every 2**k-th after it.
    for k in range(len(jumps) - 1, -1, -1):
        more = path.join(jumps[k].select("t", "m", "j"), ["t", "m"]).select("t", "branch", "leaf", "score", "n", F.col("j").alias("m"), (F.col("up") + (1 << k)).alias("up"))
        path = materialize(path.unionByName(more), "chat-paths")

    turns = path.join(rows.drop("s", "p"), ["t", "m"]).withColumns({"role_out": escape_role(F.col("role")), "text_out": escape(F.col("text"))})
    turns = turns.withColumn("piece", F.concat(F.lit(OPEN), "role_out", F.lit("\n"), "text_out", F.lit(CLOSE)))
    before = Window.partitionBy("t", "branch").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + len(BOS) + len(OPEN) + F.length("role_out") + 1
    turns = turns.withColumn("start", start)
    span = F.when(F.col("role") == ASSISTANT, F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.length("text_out")).cast("long").alias("end")))
    turns = turns.select("t", "branch", "tree", "leaf", "score", "n", F.struct((-F.col("up")).alias("at"), "piece", span.alias("span")).alias("turn"))
    chats = turns.groupBy("t", "branch").agg(F.first("tree").alias("tree"), F.first("leaf").alias("leaf"), F.first("score").alias("score"), F.first("n").alias("n_turns"), F.sort_array(F.collect_list("turn")).alias("turns"))
    return chats.select(
        F.col("tree").alias(tree), "branch", "leaf", "n_turns", "score",
        F.concat(F.lit(BOS), F.array_join("turns.piece", ""), F.lit(EOS)).alias("chat"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of role, text) and ``loss_text``, both read from the formatted text alone."""
    pieces = F.slice(F.split("chat", r"\[INST\]", -1), 2, F.greatest(F.size(F.split("chat", r"\[INST\]", -1)) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        body = F.split_part(piece, F.lit(CLOSE), F.lit(1))
        at = F.instr(body, "\n")
        return F.struct(unescape_role(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(F.substring(body, at + 1, F.length(body))).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("chat"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return chats.withColumns({"turns": F.transform(pieces, turn), "loss_text": F.array_join(masked, "")})


def chat_digest(chats: DataFrame, tree: str) -> DataFrame:
    read = read_chats(chats)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        tree,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("chat").cast("long").alias("formatted_chars"),
    )


def linear_threads(df: DataFrame, tree: str, turn: str, role: str, text: str) -> DataFrame:
    """A table of turns as reply chains: message (from 1) and the one before it as parent."""
    order = Window.partitionBy(f"`{tree}`").orderBy(f"`{turn}`", f"`{role}`", f"`{text}`")
    numbered = df.select(F.col(f"`{tree}`"), F.col(f"`{role}`"), F.col(f"`{text}`"), F.row_number().over(order).cast("long").alias("message"))
    return numbered.withColumn("parent", F.when(F.col("message") > 1, F.col("message") - 1))
