"""Conversation structure repair: signatures of roles and faults, each distinct one solved once, edits replayed.

A row's letter is its role and fault; a conversation's letters in order are its signature. Equal signatures have equal cheapest
edits, so Spark solves the distinct ones by memoised recursion and joins the audits back. A long conversation is a chain of
blocks of bounded length: a block's costs from each state to each state compose, so no task holds a whole conversation. Rows
are numbered by ranges of turns and copies counted first, so one conversation may hold a third of all rows.

Grammar: nothing, or an optional system turn and then user and assistant in turn, the assistant last. Edits: K keep (0), R give
it the role that is due (1), D delete (2), I insert an empty turn of the role that is due (5); a truncated row that stays costs
5 more; blank and repeated rows must go. Of the cheapest audits the least in ASCII order is taken.

Defined cases: a null role or text is one space (so blank, or a role outside of the grammar), null turns come first, rows of one
turn follow by role and text, equal rows stand together (the first is the original), a null conversation id is a conversation
of its own, no rows give no conversations. Extra columns are ignored, whatever their names."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import materialize, table

#: Rows of a block, and turns of a range in which rows are numbered.
BLOCK, TURNS = 1024, 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What was written last: nothing, system, user, assistant. A conversation may end at the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
END, GONE, NEVER = "$", "d", 1 << 40
NAMES = {USER: "user", ASSISTANT: "assistant"}
WORD = r"[^\x20\x09-\x0D]"


def solved(signature: str, future: tuple[int, ...] = (0, 0, 0, 0), stride: int = 100) -> list[tuple[int, str, int]]:
    """For each state before the signature: the least cost, its audit, the state behind it. future: what each state behind
    still costs. Letters: s, u, a, x (other role), upper case if truncated, d if it must go, $ the end of a conversation."""
    memo: dict[tuple[int, int, int], tuple[int, str, int, int, int]] = {}

    def best(i: int, state: int, inserts: int = 2) -> tuple[int, str, int, int, int]:
        """Cost to the end, first edit and where it leads. Its letters differ, so the first decides among equal costs; more
        than two inserts in a row never pay, as two lead from the last state back to it."""
        at = i, state, inserts
        if at not in memo:
            ways = []
            if i == len(signature):
                ways.append((future[state], "", i, state, 0))
            else:
                row = signature[i]
                if inserts:
                    ways.append((INSERT + best(i, NEXT[state], inserts - 1)[0], "I", i, NEXT[state], inserts - 1))
                if row == END:
                    if state in (NOTHING, ASSISTANT):
                        ways.append((best(i + 1, state)[0], "", i + 1, state, 2))
                else:
                    ways.append((DELETE + best(i + 1, state)[0], "D", i + 1, state, 2))
                    if row != GONE:
                        more, role = TRUNCATED if row.isupper() else 0, row.lower()
                        kept = SYSTEM if role == "s" and state == NOTHING else NEXT[state] if role == NAMES[NEXT[state]][0] else None
                        if kept is not None:
                            ways.append((KEEP + more + best(i + 1, kept)[0], "K", i + 1, kept, 2))
                        ways.append((REROLE + more + best(i + 1, NEXT[state])[0], "R", i + 1, NEXT[state], 2))
            memo[at] = min(ways, default=(NEVER, "", len(signature), state, 0))
        return memo[at]

    for i in range(len(signature), 0, -stride):  # from the end, so that no recursion is deep
        for state in range(4):
            best(i, state)
    out = []
    for state in range(4):
        cost, audit, at = best(0, state)[0], [], (0, state, 2)
        while True:
            _, edit, *then = best(*at)
            audit.append(edit)
            if at[0] == len(signature) or tuple(then) == at:
                break
            at = tuple(then)
        out.append((min(cost, NEVER), "".join(audit), at[1]))
    return out


def replay(rows: list[dict], audit: str, state: int) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the turns that a block's audit leaves."""
    out, i = [], 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append((edit, NAMES[state], ""))
            continue
        row, i = rows[i], i + 1
        if edit == "R":
            state = NEXT[state]
            out.append((edit, NAMES[state], row["text"]))
        elif edit == "K":
            state = SYSTEM if row["role"].startswith("s") else NEXT[state]
            out.append((edit, row["role"], row["text"]))
    return out


def _mapped(df: DataFrame, schema: str, f) -> DataFrame:
    """Rows (dicts) to rows, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([f(r) for r in b.to_pylist()], schema=arrow)

    return df.mapInArrow(run, schema)


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """_c (key of the conversation), turn, role, text, fault (blank, duplicate, truncated or null), letter, initial, pos (from
    0, within the conversation). Written."""
    rows = conversations.select(key(F.col(conv)).alias("_c"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    # equal rows of a turn become one with a count before anything is sorted
    rows = materialize(rows.groupBy("_c", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("same", F.sha2(F.concat_ws("\u0000", "role", "text"), 256)), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy(F.col("_c").alias("_c1"), F.col("same").alias("same1")).agg(F.min(place).alias("first"))
    rows = rows.join(first, (F.col("_c") == F.col("_c1")) & (F.col("same") == F.col("same1"))).withColumn("again", ~place.eqNullSafe(F.col("first")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("range", F.floor(F.col("turn") / TURNS))
    ends = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), -1, 1)
    fault = F.when(~F.col("text").rlike(WORD), "blank").when(F.col("again") | (F.col("copy") > 1), "duplicate").when(~ends.rlike("[.!?]"), "truncated")
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    rows = rows.select("_c", "turn", "role", "text", "copy", "range", fault.alias("fault"), initial.alias("initial"))
    rows = materialize(rows, "copies")
    before = W.partitionBy("_c").orderBy(F.col("range").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    ranges = rows.groupBy("_c", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranges = ranges.select(F.col("_c").alias("_c1"), F.col("range").alias("range1"), "before")
    within = W.partitionBy("_c", "range").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    rows = rows.withColumn("at", F.row_number().over(within)).join(ranges, (F.col("_c") == F.col("_c1")) & F.col("range").eqNullSafe(F.col("range1")))
    letter = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return materialize(rows.select("_c", "turn", "role", "text", "fault", letter.alias("letter"), "initial", (F.col("before") + F.col("at") - 1).alias("pos")), "numbered")


def key(conv: Column) -> Column:
    """A conversation id as text that is never null; no id has the empty one."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def blocks_of(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """_c, block, blocks, signature, illegal and counts of faults: bounded pieces of the conversations."""
    count = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    cells = F.sort_array(F.collect_list(F.struct("pos", "letter", "initial")))
    d = rows.groupBy("_c", F.floor(F.col("pos") / size).alias("block")).agg(cells.alias("cells"), count("blank"), count("duplicate"), count("truncated"))
    order = W.partitionBy("_c").orderBy("block")
    d = d.select("*", F.array_join("cells.letter", "").alias("letters"), F.array_join("cells.initial", "").alias("initials"))
    d = d.withColumn("then", F.lead(F.substring("initials", 1, 1)).over(order)).withColumn("blocks", F.count("*").over(W.partitionBy("_c")))
    pairs = F.concat("initials", F.coalesce("then", F.lit("")))
    illegal = F.length(pairs) - 1 - F.regexp_count(pairs, F.lit("(?=su|ua|au)"))
    signature = F.concat("letters", F.when(F.col("then").isNull(), END).otherwise(""))
    return materialize(d.select("_c", "block", "blocks", signature.alias("signature"), illegal.alias("illegal"), "blank", "duplicate", "truncated"), "blocks")


def audits_of(blocks: DataFrame) -> DataFrame:
    """_c, block, audit, state (before the block), cost (from the block to the end). Three steps: costs of distinct signatures
    in chains, what each state still costs behind a block, and the distinct pairs of signature and such costs, solved."""
    chained = blocks.where("blocks > 1")

    def table_of(r):
        return {"signature": r["signature"], "costs": [c for out in range(4) for c, _, _ in solved(r["signature"], tuple(0 if s == out else NEVER for s in range(4)))]}

    costs = _mapped(chained.select("signature").distinct(), "signature string, costs array<long>", table_of)
    chain = chained.join(costs, "signature").groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("chain"))

    def behind(r):
        future, out = [0] * 4, []
        for b in reversed(r["chain"]):
            out.append({"block": b["block"], "future": future})
            future = [min(min(b["costs"][4 * x + s] + future[x] for x in range(4)), NEVER) for s in range(4)]
        return {"_c": r["_c"], "futures": out}

    futures = _mapped(chain, "_c string, futures array<struct<block: long, future: array<long>>>", behind).select(F.col("_c").alias("_c1"), F.inline("futures"))
    futures = futures.withColumnRenamed("block", "block1")
    rows = blocks.join(futures, (F.col("_c") == F.col("_c1")) & (F.col("block") == F.col("block1")), "left")
    rows = materialize(rows.select("_c", "block", "blocks", "signature", F.coalesce("future", F.array(*[F.lit(0).cast("long")] * 4)).alias("future")), "asked")

    def answers(r):
        found = [{"cost": c, "audit": a, "out": s} for c, a, s in solved(r["signature"], tuple(r["future"]))]
        return {"signature": r["signature"], "future": r["future"], "ways": found}

    ways = _mapped(rows.select("signature", "future").distinct(), "signature string, future array<long>, ways array<struct<cost: long, audit: string, out: int>>", answers)
    rows = materialize(rows.join(ways, ["signature", "future"]), "ways")
    # a chain's states in order; a conversation of one block begins with nothing
    step = F.sort_array(F.collect_list(F.struct("block", F.col("ways.out").alias("out"))))

    def walked(r):
        state, out = NOTHING, []
        for b in r["steps"]:
            out.append({"block1": b["block"], "state": state})
            state = b["out"][state]
        return {"_c1": r["_c"], "states": out}

    states = _mapped(rows.where("blocks > 1").groupBy("_c").agg(step.alias("steps")), "_c1 string, states array<struct<block1: long, state: int>>", walked).select("_c1", F.inline("states"))
    rows = rows.join(states, (F.col("_c") == F.col("_c1")) & (F.col("block") == F.col("block1")), "left").withColumn("state", F.coalesce("state", F.lit(NOTHING)))
    way = F.get("ways", F.col("state"))
    return materialize(rows.select("_c", "block", "state", way["audit"].alias("audit"), way["cost"].alias("cost")), "audits")


def repaired(rows: DataFrame, audits: DataFrame, size: int = BLOCK) -> DataFrame:
    """_c, block, turns (array<struct<edit, role, text>>): the repaired conversations, in blocks."""
    d = rows.groupBy("_c", F.floor(F.col("pos") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("rows"))

    def turns(r):
        return {"_c": r["_c"], "block": r["block"], "turns": [{"edit": e, "role": o, "text": t} for e, o, t in replay(r["rows"], r["audit"], r["state"])]}

    return _mapped(d.join(audits, ["_c", "block"]), "_c string, block long, turns array<struct<edit: string, role: string, text: string>>", turns)


def digests(blocks: DataFrame) -> DataFrame:
    """_c1, repaired_sha256 of the lines role:text, newline-joined: a running hash over the sorted blocks, however many."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    sorted_ = blocks.select("_c", "block", F.size("turns").alias("n"), lines.alias("lines")).repartition("_c").sortWithinPartitions("_c", "block")
    schema = pa.schema([("_c1", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        held, running, begun = None, None, False
        for b in batches:
            done = []
            for r in b.to_pylist():
                if r["_c"] != held:
                    if held is not None:
                        done.append((held, running.hexdigest()))
                    held, running, begun = r["_c"], hashlib.sha256(), False
                if r["n"]:
                    running.update((("\n" if begun else "") + r["lines"]).encode())
                    begun = True
            yield pa.RecordBatch.from_pylist([{"_c1": c, "repaired_sha256": h} for c, h in done], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"_c1": held, "repaired_sha256": running.hexdigest()}], schema=schema)

    return sorted_.mapInArrow(run, "_c1 string, repaired_sha256 string")


def repair_conversations(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Reports (_c, gaps, counts of faults, cost, audit), one for each conversation that has rows, and the repaired turns in
    blocks (_c, block, turns). Turns are whole numbers."""
    rows = numbered(conversations, conv, turn, role, text)
    blocks = blocks_of(rows, size)
    audits = audits_of(blocks)
    sums = blocks.groupBy("_c").agg(*[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal")])
    whole = audits.groupBy(F.col("_c").alias("_c1")).agg(
        F.min_by("cost", "block").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    turns = rows.where("turn is not null").select("_c", "turn").distinct().groupBy(F.col("_c").alias("_c2"))
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    reports = sums.join(whole, F.col("_c") == F.col("_c1")).join(gaps, F.col("_c") == F.col("_c2"), "left")
    reports = reports.select("_c", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return reports, repaired(rows, audits, size)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with the faults that the checksum of `conv_id:turn` chooses."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), chance.alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "conversations")
    reports, turns = repair_conversations(damaged(raw))
    every = raw.select("conv_id").distinct().withColumn("_k", key(F.col("conv_id")))
    rows = every.join(reports, F.col("_k") == F.col("_c"), "left").join(digests(turns), F.col("_k") == F.col("_c1"), "left")
    numbers = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
