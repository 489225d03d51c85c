"""op13: the repair against a plain version that carries whole audits, on given and generated conversations."""

import hashlib
import random
import re
import zlib

import pytest

from quire.llm.conversations import blocks_of, digests, op13_conversation_repair, repair_conversations, solved

WHITE = " \t\n\x0b\x0c\r"


def plain_audit(rows):
    """rows: (initial, fault). The least (cost, audit), by carrying every state's best audit from the end."""
    follow = {"0": ("u", "U"), "S": ("u", "U"), "U": ("a", "A"), "A": ("u", "U")}
    later = {}
    for i in range(len(rows), -1, -1):
        now = {}
        for state in "0SUA":
            ways = [(0, "")] if i == len(rows) and state in "0A" else []
            if i < len(rows):
                initial, fault = rows[i]
                ways.append((2 + later[state][0], "D" + later[state][1]))
                if fault not in ("blank", "duplicate"):
                    more = 5 if fault == "truncated" else 0
                    due, into = follow[state]
                    if initial == due:
                        ways.append((more + later[into][0], "K" + later[into][1]))
                    if initial == "s" and state == "0":
                        ways.append((more + later["S"][0], "K" + later["S"][1]))
                    ways.append((more + 1 + later[into][0], "R" + later[into][1]))
            now[state] = min(ways, default=(10**9, ""))
        for _ in range(4):  # inserts, until nothing changes
            for state in "0SUA":
                cost, audit = now[follow[state][1]]
                now[state] = min(now[state], (cost + 5, "I" + audit))
        later = now
    return later["0"]


def plain(rows):
    """rows of one conversation, damaged: (turn, role, text). The report's columns."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = plain_audit(list(zip(initials, faults)))
    out, i, last = [], 0, None
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        due = "assistant" if last == "u" else "user"
        role, text = (rows[i][1], rows[i][2]) if edit == "K" else (due, "") if edit == "I" else (due, rows[i][2])
        i += edit != "I"
        out.append(f"{role}:{text}")
        last = role[0]
    turns = {r[0] for r in rows if r[0] is not None}
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def expected(rows):
    by = {r[0]: [] for r in rows}
    for conv, *rest in plain_damage(rows):
        by[conv].append(tuple(rest))
    return {c: plain(r) for c, r in by.items()}


def found(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def saved(spark, rows, path):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_equals_plain_version_on_the_tables(spark, size):
    sf = f"/root/testdata/sf{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_conversation_repair(spark, sf)) == expected(rows)


def test_odd_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(None, None, None, None), (None, 3, "user", "a."), (7, None, "assistant", "b"), (7, None, "assistant", "b"), (8, 5, "", "x!"), (9, -4, "User", "é?　"), (9, 4, "system", ".")]
    for c in range(10, 120):
        for t in range(r.randrange(12)):
            rows.append((c, r.choice([t, t, t * 3, None]), r.choice(["user", "assistant", "system", "tool", None]), r.choice(["Yes.", "no", " ", "", None, "Why?\n", "Yes."])))
    got = found(op13_conversation_repair(spark, saved(spark, rows, tmp_path)))
    assert got == expected(rows)


def test_empty_table(spark, tmp_path):
    assert op13_conversation_repair(spark, saved(spark, [], tmp_path)).count() == 0


def test_conversations_longer_than_a_block(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool"]), r.choice(["Yes.", "no", " ", f"Turn {t}.", f"turn {t}"])) for c in range(6) for t in range([1, 7, 8, 9, 40, 700][c])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    reports, turns = repair_conversations(df, size=8)
    hashes = {x["_c1"]: x["repaired_sha256"] for x in digests(turns).collect()}
    for x in reports.collect():
        want = plain([row[1:] for row in rows if f"={row[0]}" == x["_c"]])
        assert {k: v for k, v in x.asDict().items() if k != "_c"} | {"repaired_sha256": hashes[x["_c"]]} == want


def test_solved_is_not_deep():
    cost, audit, state = solved("ua" * 20_000 + "$")[0]
    assert (cost, set(audit), state) == (0, {"K"}, 3)


def test_one_conversation_of_many_copies(spark):
    """Equal rows are counted before they are sorted, and blocks stay bounded."""
    df = spark.range(20_000).selectExpr("1L as conv_id", "cast(id % 10 as long) as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "'Same.' as text", "id as pos", "'x' as letter")
    reports, _ = repair_conversations(df, size=512)
    (row,) = reports.collect()
    assert (row["duplicate"], row["cost"], row["audit"].count("K")) == (19_998, 2 * 19_998, 2)
    assert blocks_of.__defaults__ == (1024,)


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", "q", 1, 2), (1, 1, "assistant", "Ho.", "q", 1, 2)], "conv_id long, turn long, role string, text string, _c string, block int, pos int")
    assert [r["audit"] for r in repair_conversations(df)[0].collect()] == ["KK"]
