"""Chat formatting in budgeted windows. DataFrame functions only.

A conversation becomes windows of turns that fit a budget of tokens: the system turn that opens the
conversation, at most `history` tokens of the latest earlier turns, and new turns. What the system turn and
the history leave of the budget is the room for new turns. Prefix sums of the turns' tokens choose
turn-aligned spans: the sums are cut into units of half a room, a turn is new in the window of the unit in
which it begins, and a turn that would end beyond the room has a window of its own. So no window exceeds the
budget, unless a turn alone is larger than the room: it is not cut. (The history takes a quarter of the room
at most, so that it never reaches beyond the window before.) Only new assistant turns carry loss, so each
assistant text is a target once; what is repeated is masked.

Control strings that occur inside texts are escaped, reversibly: a backslash becomes \\0 and the k-th
control string \\k. The output is read back by splitting it at its marks.

Prefix sums have two levels: sums of blocks of turns per conversation, then within a block, so that
the sort of a conversation with very many turns is spread over tasks; windows are collected by
(conversation, window), whose size the budget bounds.

Cases: null texts and roles are empty; roles other than system, user and assistant are kept and carry
no loss; turns are ordered by turn (nulls first), then role and text, so repeated rows stand side by
side and are turns of their own; null conv_ids are one conversation; an empty table gives an empty
result; a system turn later on is an ordinary turn; an opening system turn that leaves less than
LEAST_ROOM tokens is repeated all the same. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window, of repeated turns in it, and of new ones whatever the system turn takes.
BUDGET, HISTORY, LEAST_ROOM = 1280, 256, 64
TURN_BLOCK = 256
#: Control strings of the template, in the order of their escapes \1, \2, ...
CONTROL = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[TURN]", "[/TURN]", "[ROLE]"]
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[/TURN]")


def escape(text: Column) -> Column:
    return reduce(lambda c, k: F.replace(c, F.lit(CONTROL[k]), F.lit(f"\\{k + 1}")), range(len(CONTROL)), F.replace(text, F.lit("\\"), F.lit("\\0")))


def unescape(text: Column) -> Column:
    return F.replace(reduce(lambda c, k: F.replace(c, F.lit(f"\\{k + 1}"), F.lit(CONTROL[k])), range(len(CONTROL)), text), F.lit("\\0"), F.lit("\\"))


def token_count(text: Column) -> Column:
    """Letters, digits and other signs in runs, and four for a turn's marks."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+")).cast("long") + 4


def _by_role(role: Column, side: int) -> Column:
    when = F
    for name, marks in MARKS.items():
        when = when.when(role == name, F.lit(marks[side]))
    return when.otherwise(F.lit(OTHER[side]))


def rendered(role: Column, text: Column) -> Column:
    """One turn as it stands in the output."""
    known = role.isin(*MARKS)
    body = F.when(known, escape(text)).otherwise(F.concat(escape(role), F.lit("[ROLE]"), escape(text)))
    return F.concat(_by_role(role, 0), body, _by_role(role, 1))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, loss (array of start and end in code points), repeats, again, n_turns, n_tokens."""
    if 2 * history > budget:
        raise ValueError("history may not exceed half of the budget")
    own = turns.select(F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumns({"key": F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")), "tokens": token_count(F.col("text")), "part": F.coalesce(F.floor(F.col("turn") / TURN_BLOCK), F.lit(-(2**62)))})
    order = ["turn", "role", "text"]
    # two levels of prefix sums: over blocks of a conversation, then over the turns of a block
    inside = Window.partitionBy("key", "part").orderBy(*order)
    own = own.withColumns({"within": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"), "at": F.row_number().over(inside) - 1})
    lead = F.max(F.when((F.col("at") == 0) & (F.col("role") == "system"), F.col("tokens")))
    parts = own.groupBy("key", "part").agg(F.sum("tokens").alias("sum"), F.count("*").alias("n"), lead.alias("lead"))
    by_part = Window.partitionBy("key").orderBy("part")
    parts = parts.select("key", "part", (F.sum("sum").over(by_part) - F.col("sum")).alias("before_part"), (F.sum("n").over(by_part) - F.col("n")).alias("n_before"), F.coalesce(F.first("lead").over(by_part), F.lit(0)).alias("opens"))
    parts = parts.withColumn("room", F.greatest(F.lit(budget - history) - F.col("opens"), F.lit(LEAST_ROOM)).cast("long"))
    own = own.join(parts, ["key", "part"]).select("conv_id", "key", "role", "text", "tokens", "room", (F.col("before_part") + F.col("within") - F.col("opens")).alias("start"), (F.col("n_before") + F.col("at")).alias("pos"))
    own = own.withColumns({"head": (F.col("pos") == 0) & (F.col("role") == "system"), "unit": F.expr("room div 2")})
    beyond = F.pmod("start", "unit") + F.col("tokens") > F.col("room")
    own = own.withColumn("w", F.when(F.col("head"), 0).otherwise(2 * F.expr("start div unit") + beyond.cast("long")))
    # windows with at least one new turn; the opening system turn alone makes none unless nothing follows
    spans = own.groupBy("key", "w").agg(F.min(F.when(~F.col("head"), F.col("start"))).alias("from"), F.count(F.when(~F.col("head"), 1)).alias("n"), F.max(F.when(F.col("head"), F.col("text"))).alias("head_text"), F.least(F.lit(history).cast("long"), F.expr("any_value(unit) div 2")).alias("past"), F.first("conv_id").alias("conv_id"))
    whole = Window.partitionBy("key")
    spans = spans.withColumns({"all": F.sum("n").over(whole), "opening": F.max("head_text").over(whole)})
    spans = spans.where((F.col("n") > 0) | (F.col("all") == 0))
    nxt = Window.partitionBy("key").orderBy("w")
    spans = spans.withColumns({"next_w": F.lead("w").over(nxt), "next_from": F.lead("from").over(nxt)}).select("conv_id", "key", "w", "opening", "next_w", "next_from", "past")
    body = own.where(~F.col("head")).join(spans.select("key", "w", "next_w", "next_from", "past"), ["key", "w"])
    repeated = F.col("next_w").isNotNull() & (F.col("next_from") - F.col("start") <= F.col("past"))
    place = F.when(repeated, F.array(F.struct(F.col("w").alias("w"), F.lit(False).alias("again")), F.struct(F.col("next_w").alias("w"), F.lit(True).alias("again")))).otherwise(F.array(F.struct(F.col("w").alias("w"), F.lit(False).alias("again"))))
    placed = body.withColumn("place", F.explode(place)).select("conv_id", "key", F.col("place.w").alias("w"), F.col("pos"), F.col("place.again").alias("again"), "role", "text", "tokens")
    # the opening system turn in front of every window
    opening = spans.where(F.col("opening").isNotNull()).withColumn("first", F.row_number().over(nxt) == 1)
    opening = opening.select(
        "conv_id", "key", "w", F.lit(-1).cast("long").alias("pos"),
        (~F.col("first")).alias("again"), F.lit("system").alias("role"), F.col("opening").alias("text"), token_count(F.col("opening")).alias("tokens"),
    )
    every = placed.select("conv_id", "key", "w", F.col("pos").cast("long").alias("pos"), "again", "role", "text", "tokens").unionByName(opening)
    made = every.select("conv_id", "key", "w", "pos", "again", "tokens", "role", rendered(F.col("role"), F.col("text")).alias("piece"))
    found = made.groupBy("key", "w").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("pos", "again", "role", "piece"))).alias("t"), F.sum("tokens").alias("n_tokens"))
    # where each piece begins: a fold over the lengths
    sizes = F.transform("t", lambda x: F.length(x["piece"]).cast("long"))
    begins = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    found = found.withColumns({"begins": begins})
    indexed = F.transform("t", lambda x, i: F.struct((~x["again"] & (x["role"] == "assistant")).alias("on"), (F.get("begins", i) + len(MARKS["assistant"][0])).alias("start"), (F.get("begins", i) + F.length(x["piece"]) - len(MARKS["assistant"][1])).alias("end")))
    loss = F.transform(F.filter(indexed, lambda x: x["on"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return found.select(
        "conv_id", F.col("w").alias("window"), F.array_join("t.piece", "").alias("text"), loss.alias("loss"),
        F.size(F.filter("t", lambda x: x["again"])).alias("repeats"), F.transform("t", lambda x: x["again"]).alias("again"), F.size("t").alias("n_turns"), "n_tokens",
    )


#: Any mark that opens a turn, its content, any mark that closes one.
TURN = r"(?s)(<<SYS>>|\[INST\]|<s>|\[TURN\])(.*?)(?:<</SYS>>|\[/INST\]|</s>|\[/TURN\])"


def parsed(text: Column) -> Column:
    """Array of (role, text) of a window's text."""
    marks, bodies = F.regexp_extract_all(text, F.lit(TURN), 1), F.regexp_extract_all(text, F.lit(TURN), 2)

    def turn(mark: Column, body: Column) -> Column:
        role = F
        for name, m in MARKS.items():
            role = role.when(mark == m[0], F.lit(name))
        role = role.otherwise(unescape(F.substring_index(body, "[ROLE]", 1)))
        own = F.when(mark == OTHER[0], F.substring(body, F.locate("[ROLE]", body) + 6, F.length(body))).otherwise(body)
        return F.struct(role.alias("role"), unescape(own).alias("text"))

    return F.zip_with(marks, bodies, turn)


def read_back(made: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns (role LF text LF, all), loss_text, formatted_chars, from windows."""
    fresh = F.filter(F.zip_with(parsed(F.col("text")), "again", lambda t, a: F.struct(t["role"].alias("role"), t["text"].alias("text"), a.alias("again"))), lambda x: ~x["again"])
    spans = F.transform("loss", lambda x: unescape(F.substring(F.col("text"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))
    rows = made.select(
        "conv_id", "window", F.length("text").cast("long").alias("chars"), F.size(fresh).cast("long").alias("n"), F.array_join(spans, "").alias("loss"),
        F.array_join(F.transform(fresh, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
    )
    # one row for a conversation: its digest needs all of it in order
    all_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    return all_.select("conv_id", "n_turns", F.array_join("w.turns", "").alias("turns"), F.array_join("w.loss", "").alias("loss_text"), "formatted_chars")


def oracle(extra: str) -> str:
    """The query's result in DuckDB's SQL: the same windows, their lengths summed. `extra` is a select of more turns."""

    def escaped(c: str) -> str:
        out = f"replace({c}, chr(92), chr(92) || '0')"
        for k, control in enumerate(CONTROL, 1):
            out = f"replace({out}, '{control}', chr(92) || '{k}')"
        return out

    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL {extra}),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, len(regexp_extract_all(text, '\\p{{L}}+|\\p{{N}}{{1,3}}|[^\\s\\p{{L}}\\p{{N}}]+')) + 4 AS tokens FROM t),
g AS (SELECT *, pos = 0 AND role = 'system' AS head, max(CASE WHEN pos = 0 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS opens FROM o),
h AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) - tokens - opens AS start, greatest({BUDGET - HISTORY} - opens, {LEAST_ROOM}) AS room, greatest({BUDGET - HISTORY} - opens, {LEAST_ROOM}) // 2 AS unit FROM g),
p AS (SELECT *, CASE WHEN head THEN 0 ELSE 2 * (start // unit) + CASE WHEN start % unit + tokens > room THEN 1 ELSE 0 END END AS w, least({HISTORY}, unit // 2) AS past,
  length({escaped("text")}) + CASE role {marks} ELSE {len(OTHER[0]) + len(OTHER[1]) + len("[ROLE]")} + length({escaped("role")}) END AS size FROM h),
s AS (SELECT conv_id, w, min(start) FILTER (WHERE NOT head) AS begins, count(*) FILTER (WHERE NOT head) AS n FROM p GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id) AS every FROM s) WHERE n > 0 OR every = 0),
x AS (SELECT *, lead(begins) OVER (PARTITION BY conv_id ORDER BY w) AS next_begins FROM k),
body AS (SELECT p.conv_id, sum(size * CASE WHEN x.next_begins - p.start <= p.past THEN 2 ELSE 1 END) AS chars FROM p JOIN x ON p.conv_id IS NOT DISTINCT FROM x.conv_id AND p.w = x.w WHERE NOT p.head GROUP BY 1),
head AS (SELECT p.conv_id, sum(size) AS chars FROM p JOIN x ON p.conv_id IS NOT DISTINCT FROM x.conv_id WHERE p.head GROUP BY 1),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss FROM p GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, (coalesce(body.chars, 0) + coalesce(head.chars, 0))::BIGINT AS formatted_chars
FROM d LEFT JOIN body ON d.conv_id IS NOT DISTINCT FROM body.conv_id LEFT JOIN head ON d.conv_id IS NOT DISTINCT FROM head.conv_id"""
