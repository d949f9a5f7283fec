import random

import duckdb
import pytest

from spanloom.llm import structure

SCHEMA = "conv_id long, turn long, role string, text string, m long, block long, h string"


def against_sql(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = sorted(map(tuple, structure.damaged_report(df).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert got == sorted(con.execute(structure.REPAIR_SQL).fetchall(), key=str)
    return got


def odd_rows(n, seed):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u2"], ["Done.", "and then", "", " \t\n", None, "Why? ", "so!\r\n", "x" * 3000]
    turns = lambda: rnd.choice([None, *range(-2, 9)])
    return [(rnd.choice([None, *range(60)]), turns(), rnd.choice(roles), rnd.choice(texts)) for _ in range(n)]


def test_nulls_ties_repeats_and_odd_roles(spark):
    rows = odd_rows(500, 1)
    assert len(against_sql(spark, rows + rows[:40])) == 61


@pytest.mark.parametrize("bits", [(1, 1), (3, 2)])
def test_conversations_of_many_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(structure, "BLOCK_BITS", bits[0])
    monkeypatch.setattr(structure, "LEVEL_BITS", bits[1])
    rnd = random.Random(2)
    rows = [(7, i, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice([f"text {i}.", f"cut {i}", "again.", ""])) for i in range(150)]
    against_sql(spark, rows + odd_rows(60, 3))


def test_empty_table_and_dropped_conversations(spark):
    assert against_sql(spark, []) == []
    got = against_sql(spark, [(i, 0, "user", "Hi.") for i in range(60)])
    gone = [r for r in got if r[7] == "" and r[6] == 0]
    assert gone and all(r[1:7] == (0,) * 6 and r[8].startswith("e3b0c442") for r in gone)


def test_search_equals_all_edits():
    """A* against every sequence of edits, over short rows."""
    import itertools

    def all_ways(kinds, entry):
        best = {}

        def go(i, state, cost, done, put):
            if i == len(kinds):
                best[state] = min(best.get(state, (99, "")), (cost, done))
                return
            more = 3 if kinds[i].isupper() else 0
            go(i + 1, state, cost + 4, done + "D-", 0)
            for c, to in structure.FOLLOWS[state]:
                if kinds[i].lower() == c:
                    go(i + 1, to, cost + more, done + "K" + c, 0)
                if c != "s" and kinds[i] != "x":
                    go(i + 1, to, cost + 3 + more, done + "R" + c, 0)
                if c != "s" and put < 3:
                    go(i, to, cost + 3, done + "I" + c, put + 1)

        go(0, entry, 0, "", 0)
        return best

    for n in (1, 2, 3):
        for kinds in itertools.product("suaxUAo", repeat=n):
            for entry in range(4):
                assert structure._solve("".join(kinds), entry) == all_ways("".join(kinds), entry)


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", ""), (1, 3, "user", "Bye")], "conv_id long, turn long, role string, text string")
    got = [(r.role, r.text, r.edit) for r in structure.repair(df).rows().orderBy("m", "at").collect()]
    assert got == [("system", "Be kind.", "K"), ("user", "", "I"), ("assistant", "Hello.", "K")]
