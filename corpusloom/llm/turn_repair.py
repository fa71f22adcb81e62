"""Repair of damaged conversations: the cheapest edits that make the turns alternate, in DataFrame functions only.

A conversation's turns are sorted, their faults flagged by windows, and the sorted structs folded by aggregate(). The fold
carries the cheapest way to each of four states: nothing said yet, after the system turn, after a user's turn, after an
assistant's. A way is a struct (cost, path), so that least() takes the cheaper one and of equally cheap ones the path that
is least in ASCII. A path has one letter an edit: D delete, I and J insert a user's or an assistant's turn, K keep, R and S
give a turn to the user or the assistant. With J read as I and S as R it is the audit. A given audit leaves no choice of the
roles it inserts or gives, so that both orders are the same; and two ways over the same turns at the same cost are never
one a prefix of the other, since what the longer one has more can only be inserts, which cost.

No conversation is folded in one piece. The rows are sorted by range and cut into blocks of 2 ** BLOCK_BITS; each block says for
each of the four states it may be entered in how it is left, and a conversation strings its blocks together. What a task must
hold of a whole conversation are its audit and its repaired text, since the result has the one and a hash of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_BITS = 9
FAR = 1 << 40  # the cost of a state that no way reaches
BLANKS = " \t\n\x0b\x0c\r"
DROP, EMPTY, CUT, REPEAT, REROLE, KINDS = 0, 1, 2, 3, 4, 20  # kinds of damage, by crc32 mod KINDS


def damaged(conversations: DataFrame) -> DataFrame:
    """(k, turn, role, text, dropped): the rows after damage; a dropped row stays, marked and without its text, for its conversation's sake."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *named).cast("binary")) % KINDS
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        F.struct("conv_id").alias("k"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == REROLE, "user").otherwise(role).alias("role"),
        F.when(kind.isin(DROP, EMPTY), "").when(kind == CUT, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == DROP).alias("dropped"),
        F.explode(F.when(kind == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def placed(rows: DataFrame) -> DataFrame:
    """rows with place, which follows the order within a conversation, block, and what the faults are told by."""
    said = F.rtrim("text", F.lit(BLANKS))
    identity = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    marked = rows.select("*", F.substring("role", 1, 1).alias("initial"), (said == "").alias("blank"), (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("open"), identity.alias("identity"))
    ordered = marked.orderBy("k", "dropped", F.col("turn").asc_nulls_first(), "identity").withColumn("place", F.monotonically_increasing_id())
    return written(ordered, "turns").withColumn("block", F.shiftright("place", BLOCK_BITS))


def _illegal(before: Column, initial: Column) -> Column:
    """Whether the second role may not follow the first."""
    return ~F.concat(before, initial).isin("su", "ua", "au")


def _way(cost: Column | int, path: Column | str) -> Column:
    return F.struct((cost if isinstance(cost, Column) else F.lit(cost)).cast("long").alias("cost"), (path if isinstance(path, Column) else F.lit(path)).alias("path"))


def _then(way: Column, cost: Column | int, letter: Column | str) -> Column:
    return _way(way["cost"] + cost, F.concat(way["path"], letter if isinstance(letter, Column) else F.lit(letter)))


def _entered(state: Column) -> Column:
    """The ways of a fold that begins in a state."""
    return F.array(*(_way(F.when(state == i, 0).otherwise(FAR), "") for i in range(4)))


def _step(ways: Column, turn: Column) -> Column:
    """The ways after one more turn.

    Inserts stand only before a turn that stays: one before a deleted turn can stand after it, which is less in ASCII. A pair
    of inserts before a turn, or instead of a lone system turn, costs more than to do without.
    """
    start, system, user, assistant = (ways[i] for i in range(4))

    def said(way: Column, initial: str, given: str) -> Column:
        keeps = turn["initial"] == initial
        return _then(way, F.when(turn["gone"], FAR).otherwise(F.when(keeps, 0).otherwise(2) + turn["open"].cast("int")), F.when(keeps, "K").otherwise(given))

    kept = F.when(turn["gone"] | (turn["initial"] != "s"), FAR).otherwise(turn["open"].cast("int"))
    over = F.least(start, system, assistant)
    return F.array(
        _then(start, 3, "D"),
        F.least(_then(system, 3, "D"), _then(start, kept, "K")),
        F.least(_then(user, 3, "D"), said(F.least(over, _then(user, 2, "J")), "u", "R")),
        F.least(_then(assistant, 3, "D"), said(F.least(user, _then(over, 2, "I")), "a", "S")),
    )


def _ended(ways: Column) -> Column:
    """The cheapest way that ends with nothing said or after an assistant's turn."""
    return F.least(ways[0], ways[3], _then(ways[2], 2, "J"), _then(ways[1], 4, "IJ"))


def _joined(ways: Column, block: Column) -> Column:
    """The ways after a block: for each state, the best of those that enter it anywhere and leave it there."""
    return F.array(*(F.least(*(_then(ways[i], block["exits"][i][o]["cost"], block["exits"][i][o]["path"]) for i in range(4))) for o in range(4)))


def _count(turns: str, flag: str) -> Column:
    return F.size(F.filter(turns, lambda t: t[flag])).cast("long")


def blocks(rows: DataFrame) -> DataFrame:
    """(k, block, turns, exits, and counts) of placed rows: exits[i][o] is the best way from state i to state o."""
    here = Window.partitionBy("k", "block").orderBy("place")
    same = Window.partitionBy("k", "block", "identity").orderBy("place")
    flagged = rows.withColumn("again", F.row_number().over(same) > 1)
    # a turn that is the first of its kind in its block may have been said in an earlier one
    first = flagged.where(~F.col("again") & ~F.col("blank") & ~F.col("dropped")).groupBy("k", "identity").agg(F.sort_array(F.collect_list("place")).alias("at"))
    later = first.where(F.size("at") > 1).select("k", F.explode(F.slice("at", F.lit(2), F.size("at"))).alias("place"))
    later = later.groupBy("k", F.shiftright("place", BLOCK_BITS).alias("block")).agg(F.collect_list("place").alias("later"))
    told = flagged.select("*", F.lag("initial").over(here).alias("before"), F.lag("turn").over(here).alias("turn_before"))
    stays = ~F.col("dropped")
    turn = F.struct("place", "turn", "role", "text", "initial", "blank", "again", "open")
    new = F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn_before") != F.col("turn")))
    got = told.groupBy("k", "block").agg(
        F.sort_array(F.collect_list(F.when(stays, turn))).alias("turns"),
        F.min(F.when(stays, F.col("turn"))).alias("least"),
        F.max(F.when(stays, F.col("turn"))).alias("most"),
        F.count(F.when(stays & new, 1)).alias("distinct"),
        F.count(F.when(stays & _illegal(F.col("before"), F.col("initial")), 1)).alias("illegal"),
    )
    got = got.join(later, ["k", "block"], "left")

    def judged(t: Column) -> Column:
        duplicate = ~t["blank"] & (t["again"] | F.coalesce(F.array_contains("later", t["place"]), F.lit(False)))
        gone = t["blank"] | duplicate
        return F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"), t["initial"].alias("initial"), t["blank"].alias("blank"), duplicate.alias("duplicate"), gone.alias("gone"), (t["open"] & ~gone).alias("open"))

    got = got.withColumn("turns", F.transform("turns", judged))
    counts = [_count("turns", flag).alias(name) for flag, name in (("blank", "blank"), ("duplicate", "duplicate"), ("open", "truncated"))]
    exits = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.aggregate("turns", _entered(i), _step))
    ends = [F.get("turns", F.lit(0) if end == "first" else F.size("turns") - 1)[c].alias(f"{end}_{c}") for end in ("first", "last") for c in ("turn", "initial")]
    return got.select("k", "block", "least", "most", "distinct", "illegal", *counts, *ends, exits.alias("exits"), F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def _lines(inserts: Column) -> Column:
    return F.replace(F.replace(inserts, F.lit("I"), F.lit("user:\n")), F.lit("J"), F.lit("assistant:\n"))


def _edited(turn: Column, edits: Column) -> Column:
    """The lines of one turn and of what is inserted before it."""
    edit = F.right(edits, F.lit(1))
    role = F.when(edit == "K", turn["role"]).when(edit == "R", "user").otherwise("assistant")
    return F.concat(_lines(F.regexp_replace(edits, ".$", "")), F.when(edit == "D", "").otherwise(F.concat(role, F.lit(":"), turn["text"], F.lit("\n"))))


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of each conversation, damaged and repaired.

    Null conv_id: a conversation of its own. Null turns come first. Null role or text: one space, whose row is blank. Turns of one
    number come in the order of the SHA-256 of role and text, repeated rows after each other. Texts of any length are kept whole; an
    audit and a repaired text are one string each and so under 2 GB. A conversation whose rows are all dropped has zeros and empty
    strings. An empty table gives an empty result. Other columns are not read.
    """
    parts = blocks(placed(damaged(conversations)))
    whole = parts.groupBy("k").agg(
        F.sort_array(F.collect_list(F.struct(*(c for c in parts.columns if c not in ("k", "least", "most"))))).alias("blocks"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        *(F.sum(c).alias(c) for c in ("distinct", "illegal", "blank", "duplicate", "truncated")),
    )

    def at_seams(seen) -> Column:
        """How many of the seams between blocks are seen to be so."""
        return F.size(F.filter("blocks", lambda b, i: (i > 0) & F.coalesce(seen(F.get("blocks", i - 1), b), F.lit(False)))).cast("long")

    shared = at_seams(lambda a, b: a["last_turn"] == b["first_turn"])
    clashes = at_seams(lambda a, b: _illegal(a["last_initial"], b["first_initial"]))
    best = whole.withColumn("best", F.aggregate("blocks", _entered(F.lit(0)), _joined, _ended)).withColumn("turns", F.flatten(F.col("blocks.turns")))
    edits = F.regexp_extract_all("best.path", F.lit("([IJ]*[DKRS])"), F.lit(1))
    lines = F.concat(F.array_join(F.zip_with("turns", edits, _edited), ""), _lines(F.regexp_extract("best.path", "([IJ]*)$", 1)))
    return best.select(
        F.col("k.conv_id").alias("conv_id"),
        F.coalesce(F.col("most") - F.col("least") + 1 - (F.col("distinct") - shared), F.lit(0)).cast("long").alias("gaps"),
        *(F.col(c) for c in ("blank", "duplicate", "truncated")),
        (F.col("illegal") + clashes).alias("illegal"),
        F.col("best.cost").alias("cost"),
        F.translate("best.path", "JS", "IR").alias("audit"),
        F.regexp_replace(lines, "\\n\\z", "").alias("repaired"),
    )


def repair_digests(conversations: DataFrame) -> DataFrame:
    """repaired() with the SHA-256 of the repaired text in the text's place."""
    return repaired(conversations).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2("repaired", 256).alias("repaired_sha256"))


#: The same by a recursion over the turns. crc32 is computed from its polynomial, a byte a step.
ORACLE = rf"""
WITH RECURSIVE bits(n, v, i) AS (SELECT n, n, 0 FROM range(256) t(n) UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM bits WHERE i < 8),
tbl AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE i = 8),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT c.*, xor(list_reduce([ascii(x)::BIGINT FOR x IN string_split(name, '')], lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % {KINDS} AS kind FROM c, tbl),
d AS (SELECT conv_id, turn, CASE WHEN kind = {REROLE} THEN 'user' ELSE role END AS role,
  CASE WHEN kind = {EMPTY} THEN '' WHEN kind = {CUT} THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, range(2) r(copy) WHERE kind <> {DROP} AND (copy = 0 OR kind = {REPEAT})),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS i, left(role, 1) AS c,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM d),
f AS (SELECT *, said = '' AS blank, said <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM n),
g AS (SELECT *, blank OR dup AS gone, NOT blank AND NOT dup AND right(said, 1) NOT IN ('.', '!', '?') AS trunc FROM f),
-- the best (cost, path, text) by state after turn i
w AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'p': '', 't': ''}} AS a, {{'c': {FAR}::BIGINT, 'p': '', 't': ''}} AS b, {{'c': {FAR}::BIGINT, 'p': '', 't': ''}} AS u, {{'c': {FAR}::BIGINT, 'p': '', 't': ''}} AS z FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL
SELECT conv_id, i, {{'c': a.c + 3, 'p': a.p || 'D', 't': a.t}},
  least({{'c': b.c + 3, 'p': b.p || 'D', 't': b.t}}, {{'c': a.c + CASE WHEN gone OR c <> 's' THEN {FAR} ELSE trunc::INT END, 'p': a.p || 'K', 't': a.t || role || ':' || text || chr(10)}}),
  least({{'c': u.c + 3, 'p': u.p || 'D', 't': u.t}}, {{'c': nu.c + CASE WHEN gone THEN {FAR} WHEN c = 'u' THEN trunc::INT ELSE 2 + trunc::INT END, 'p': nu.p || CASE WHEN c = 'u' THEN 'K' ELSE 'R' END, 't': nu.t || CASE WHEN c = 'u' THEN role ELSE 'user' END || ':' || text || chr(10)}}),
  least({{'c': z.c + 3, 'p': z.p || 'D', 't': z.t}}, {{'c': na.c + CASE WHEN gone THEN {FAR} WHEN c = 'a' THEN trunc::INT ELSE 2 + trunc::INT END, 'p': na.p || CASE WHEN c = 'a' THEN 'K' ELSE 'R' END, 't': na.t || CASE WHEN c = 'a' THEN role ELSE 'assistant' END || ':' || text || chr(10)}})
FROM (SELECT w.*, g.* EXCLUDE (conv_id, i), w.i + 1 AS j,
  least(a, b, z, {{'c': u.c + 2, 'p': u.p || 'I', 't': u.t || 'assistant:' || chr(10)}}) AS nu,
  least(u, {{'c': a.c + 2, 'p': a.p || 'I', 't': a.t || 'user:' || chr(10)}}, {{'c': b.c + 2, 'p': b.p || 'I', 't': b.t || 'user:' || chr(10)}}, {{'c': z.c + 2, 'p': z.p || 'I', 't': z.t || 'user:' || chr(10)}}) AS na
  FROM w JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = w.i + 1) s(conv_id, before, a, b, u, z, turn, role, text, c, said, blank, dup, pair, gone, trunc, i, nu, na)),
e AS (SELECT conv_id, arg_max(least(a, z, {{'c': u.c + 2, 'p': u.p || 'I', 't': u.t || 'assistant:' || chr(10)}}, {{'c': b.c + 4, 'p': b.p || 'II', 't': b.t || 'user:' || chr(10) || 'assistant:' || chr(10)}}), w.i) AS best FROM w GROUP BY conv_id)
SELECT e.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, any_value(best.c) AS cost, any_value(best.p) AS audit, sha256(any_value(CASE WHEN best.t = '' THEN '' ELSE left(best.t, length(best.t) - 1) END)) AS repaired_sha256
FROM e LEFT JOIN g ON e.conv_id IS NOT DISTINCT FROM g.conv_id GROUP BY e.conv_id
"""
