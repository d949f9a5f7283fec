from collections import defaultdict

import duckdb

from spanloom.llm import chat


def brute(chosen, rejected):
    def turns(rows):
        out = defaultdict(dict)
        for p, t, r, x in rows:
            if p is not None and t is not None:
                v = (r or "", x or "")
                out[p][t] = min(out[p].get(t, v), v)
        return out

    a, b = turns(chosen), turns(rejected)
    out = []
    for p in a.keys() & b.keys():
        differ = [t for t in a[p].keys() | b[p].keys() if a[p].get(t) != b[p].get(t)]
        first = min(differ, default=None)
        for t in sorted(a[p].keys() | b[p].keys()):
            if first is None or t < first:
                out.append((p, "prompt", t, a[p][t], False))
            else:
                out += [(p, n, t, s[p][t], s[p][t][0] == "assistant") for n, s in (("chosen", a), ("rejected", b)) if t in s[p]]
    return sorted((p, n, t, v[0], f"<|{v[0]}|>\n{v[1]}<|end|>\n", loss) for p, n, t, v, loss in out)


def test_against_brute_force(spark):
    same = [(i, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for i in range(6) for t in range(5)]
    chosen = [*same, (0, 5, "user", "x"), (1, 6, "assistant", None), (None, 1, "user", "y"), (3, None, "user", "y"), (7, 0, "user", "alone"), *[(9, t, "user", "long") for t in range(500)], (2, 1, "a", "tie"), (2, 1, "a", "tie")]
    rejected = [(p, t, r, x + "!" if t >= p else x) for p, t, r, x in same] + [(9, t, "user", "long") for t in range(499)] + [(8, 0, None, None)]
    kinds = "pair_id long, turn long, role string, text string"
    a, b = spark.createDataFrame(chosen, kinds).selectExpr("*", "1 x", "2 first"), spark.createDataFrame(rejected, kinds)
    got = sorted(tuple(r) for r in chat.preferences(a, b).collect())
    assert got == brute(chosen, rejected)
    assert {r[1] for r in got} == {"prompt", "chosen", "rejected"}
    assert chat.preferences(a.limit(0), b).collect() == []


def test_pairs_share_the_prefix_up_to_the_last_answer(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} says {t}") for c in range(8) for t in range(1 + c)]
    rows += [(20, 0, "assistant", "alone"), (22, 0, "user", "q"), (22, 1, "assistant", "same"), (23, 3, "assistant", "same"), (24, 0, "user", "no answer"), (30, 0, "user", "x" * 3_000_000), (30, 1, "assistant", "y"), (31, 7, "assistant", "z"), (None, 0, "assistant", "n")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 pair_id", "2 l_id")
    chosen = [r for r in rows if r[0] is not None]
    last = {c: max((r[1], r[3]) for r in chosen if r[0] == c and r[2] == "assistant") for c in {r[0] for r in chosen if r[2] == "assistant"}}
    chosen = [r for r in chosen if r[0] in last]
    rejected = [r if r[1] != last[r[0]][0] else (*r[:3], last[r[0] ^ 1][1]) for r in chosen if r[1] != last[r[0]][0] or r[0] ^ 1 in last]
    got = chat.answer_turns(d)
    assert sorted(tuple(r) for r in got.collect()) == brute(chosen, rejected)
    prompts = [r.pair_id for r in got.filter("part = 'prompt'").collect()]
    assert {p: prompts.count(p) for p in (1, 6, 7, 22, 30, 31)} == {1: 1, 6: 5, 7: 7, 22: 2, 30: 1, 31: 0}
    one = {r.pair_id: r for r in chat.assemble(got).collect()}
    for p, r in one.items():
        mine = [x for x in got.collect() if x.pair_id == p]
        for part in ("prompt", "chosen", "rejected"):
            assert r[part] == "".join(x.rendered for x in sorted(mine, key=lambda x: x.turn) if x.part == part)
        for part in ("chosen", "rejected"):
            assert [r[part][a:b] for a, b in r[f"{part}_trained"]] == [x.rendered for x in sorted(mine, key=lambda x: x.turn) if x.part == part and x.loss]
    assert one[22].chosen == "" and one[22].prompt.count("<|end|>") == 2
    pairs = {r.pair_id: r for r in chat.answer_pairs(d).collect()}
    assert pairs.keys() == one.keys()
    for p, r in pairs.items():
        assert (r.prompt, r.chosen, r.rejected) == (one[p].prompt, one[p].chosen, one[p].rejected)
        assert r.chosen_mask == ",".join(f"{a}:{b}" for a, b in one[p].chosen_trained) and r.rejected_mask == ",".join(f"{a}:{b}" for a, b in one[p].rejected_trained)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(tuple, pairs.values())) == sorted(con.execute(chat.PAIRS_SQL).fetchall())
    assert chat.answer_pairs(d.limit(0)).collect() == [] and chat.assemble(got.limit(0)).collect() == []
