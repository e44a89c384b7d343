"""Repair of conversation structure by a fold over sorted turns, with Spark expressions only.

A sound conversation's role initials match (s?(ua)+)?: an optional system turn, then user and assistant in turns. That
is an automaton of four states (nothing yet, after s, after u, after a) in which every edit's role follows from the
state. Windows flag each row's fault; the turns of a conversation are collected as sorted structs; aggregate() carries
four structs (cost, audit), the cheapest edits that reach each state, and takes the least of those that meet, nulls being
states out of reach. Edits: keep (0), give the role user or assistant (2), delete (3; blank and duplicate turns must be),
insert an empty turn (2); a truncated turn that stays costs 1. Equal costs go to the audit that is least in ASCII.

Conversations of more than BLOCK turns are folded block by block from each of the four states, and the blocks'
results are joined by a second fold, so audits aren't copied once for each turn. One conversation is one value, as its
digest is; conversations are spread over tasks by id, and everything of one is computed with one shuffle.

Defined results: a null role or text is one space; rows without conversation id form one conversation; null turns come
first; rows that tie in turn sort by role, then text; repeated rows are duplicates; a conversation without rows that are
there has zeros, an empty audit and the empty text's digest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 128
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: (state before, role initial, state after)
MOVES = [(0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)]
ENDS = (0, 3)
STATE = "struct<cost:bigint,audit:string>"


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: int = 20) -> DataFrame:
    """conv_id, turn, role, text, there: rows damaged by crc32("conv_id:turn") mod every.

    0: not there any more; 1: empty text; 2: text without `.!?`; 3: twice; 4: role user; others as they were."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col(conv_id).cast("string"), blank), F.coalesce(F.col(turn).cast("string"), blank))
    kind, body = F.crc32(key.cast("binary")) % every, F.coalesce(F.col(text), blank)
    out = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), blank)).alias("role"),
                      F.when(kind == 1, "").when(kind == 2, F.regexp_replace(body, "[.!?]", "")).otherwise(body).alias("text"), kind.alias("kind"))
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        "conv_id", "turn", "role", "text", (F.col("kind") != 0).alias("there"))


def flag_faults(rows: DataFrame) -> DataFrame:
    """Adds place, before (role of the row before) and fault (blank, duplicate, truncated or null) to rows (conv_id, turn, role, text, there)."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    whole = W.partitionBy("conv_id", "there").orderBy(*order)
    same = W.partitionBy("conv_id", "there", "role", "text").orderBy("place")
    visible = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    return (rows.withColumn("place", F.row_number().over(whole)).withColumn("before", F.lag("role").over(whole))
            .withColumn("seen", F.row_number().over(same) > 1)
            .withColumn("fault", F.when(visible == "", "blank").when(F.col("seen"), "duplicate").when(~F.right(visible, F.lit(1)).isin(".", "!", "?"), "truncated")).drop("seen"))


# The fold is written as SQL text, which Spark parses at once: states are arrays of four structs.


def _then(state: str, cost: int | str, letter: str) -> str:
    """The state's struct with one edit more; null stays null."""
    return f"if(isnull({state}), null, named_struct('cost', {state}.cost + {cost}, 'audit', concat({state}.audit, '{letter}')))"


def _four(found: dict[int, list[str]]) -> str:
    """An array of four structs, each the least of what reaches its state."""
    return f"array({', '.join(f'least({chr(44).join(found[k])}, cast(null as {STATE}))' for k in range(4))})"


def _let(name: str, value: str, body: str) -> str:
    """body, in which name stands for value, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _with_inserts(states: str) -> str:
    """Inserted turns: two in a row reach every state that inserts reach."""

    def once(s: str) -> str:
        found = {k: [f"get({s}, {k})"] for k in range(4)}
        for a, role, b in MOVES:
            if role != "s":
                found[b].append(_then(f"get({s}, {a})", INSERT, "I"))
        return _four(found)

    return _let("one", states, _let("two", once("one"), once("two")))


def _step(states: str, turn: str) -> str:
    extra = f"if({turn}.fault <=> 'truncated', {TRUNCATED}, 0)"
    stays = f"({turn}.fault is null or {turn}.fault = 'truncated')"
    found = {k: [_then(f"get({states}, {k})", DELETE, "D")] for k in range(4)}
    for a, role, b in MOVES:
        found[b].append(f"if({stays} and {turn}.initial = '{role}', {_then(f'get({states}, {a})', f'{extra} + {KEEP}', 'K')}, null)")
        if role != "s":
            found[b].append(f"if({stays}, {_then(f'get({states}, {a})', f'{extra} + {REROLE}', 'R')}, null)")
    return _with_inserts(_four(found))


def _begin(state: int) -> str:
    value = {True: f"cast(named_struct('cost', 0, 'audit', '') as {STATE})", False: f"cast(null as {STATE})"}
    return f"array({', '.join(value[k == state] for k in range(4))})"


def _fold(turns: str, state: int) -> str:
    return f"aggregate({turns}, {_with_inserts(_begin(state))}, (reached, turn) -> {_step('reached', 'turn')})"


def cheapest_edits(turns: str) -> Column:
    """(cost, audit) for a column of turns with `initial` and `fault`."""
    parts = f"transform(sequence(0, greatest(size({turns}) - 1, 0), {BLOCK}), at -> slice({turns}, at + 1, {BLOCK}))"
    tables = f"transform({parts}, part -> array({', '.join(_fold('part', k) for k in range(4))}))"
    both = lambda a, b: f"if(isnull({a}) or isnull({b}), null, named_struct('cost', {a}.cost + {b}.cost, 'audit', concat({a}.audit, {b}.audit)))"
    joined = _four({k: [both(f"get(reached, {a})", f"get(get(block, {a}), {k})") for a in range(4)] for k in range(4)})
    ends = f"if(size({turns}) <= {BLOCK}, {_fold(turns, 0)}, aggregate({tables}, {_begin(0)}, (reached, block) -> {joined}))"
    return F.expr(_let("last", ends, f"least({', '.join(f'get(last, {k})' for k in ENDS)})"))


def repaired_turns(turns: Column, audit: Column) -> Column:
    """The turns after repair: an array of (edit, role, text). Behind an s, if there is one, users have even places and assistants odd ones."""
    closing = F.array(F.regexp_extract(audit, "I*$", 0))
    each = F.concat(F.regexp_extract_all(audit, F.lit("(I*[KRD])"), F.lit(1)), closing)
    edits = F.flatten(F.transform(each, lambda part, i: F.transform(F.array_remove(F.split(part, ""), ""), lambda x: F.struct(x.alias("edit"), i.alias("at")))))
    left = F.filter(edits, lambda x: x["edit"] != "D")

    def turn(x: Column, k: Column, shift: Column) -> Column:
        source = F.get(turns, x["at"])
        due = F.when((k - shift) % 2 == 0, "user").otherwise("assistant")
        return F.struct(x["edit"].alias("edit"), F.when(x["edit"] == "K", source["role"]).otherwise(due).alias("role"),
                        F.when(x["edit"] == "I", "").otherwise(source["text"]).alias("text"))

    def all_turns(xs: Column) -> Column:
        first = F.get(xs, 0)
        shift = F.when((first["edit"] == "K") & (F.get(turns, first["at"])["initial"] == "s"), 1).otherwise(0)
        return F.transform(xs, lambda x, k: turn(x, k, shift))

    return F.get(F.transform(F.array(left), all_turns), 0)


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired, the turns after repair (edit, role, text).

    there: a column that is false for rows that don't count, but whose conversation has a result all the same."""
    plain = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.col(there) if there else F.lit(True)).alias("there"))
    flagged = flag_faults(plain.repartition("conv_id")).withColumn("initial", F.left("role", F.lit(1)))
    row = F.struct("place", "turn", "role", "initial", "text", "fault")
    count = lambda what: F.count(F.when(F.col("there") & what, 1))
    pair = F.concat(F.left("before", F.lit(1)), F.col("initial"))
    turns = F.col("turn")
    one = flagged.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("there"), row))).alias("turns"),
        *[count(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")],
        count(F.col("before").isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"),
        (F.max(F.when(F.col("there"), turns)) - F.min(F.when(F.col("there"), turns)) + 1).cast("long").alias("span"))
    known = F.array_distinct(F.array_compact(F.transform("turns", lambda t: t["turn"])))
    edits = one.withColumn("edits", cheapest_edits("turns"))
    return edits.select("conv_id", F.coalesce(F.col("span") - F.size(known), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
                        F.col("edits.cost").alias("cost"), F.col("edits.audit").alias("audit"), repaired_turns(F.col("turns"), F.col("edits.audit")).alias("repaired"))


def digest(repaired: DataFrame) -> DataFrame:
    """The same, with the digest of the repaired turns' `role:text` lines in their place."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired.withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).drop("repaired")
