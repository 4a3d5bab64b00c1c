"""The machine against a plain Python one, and round trips through the formatted text."""

import collections
import random

import duckdb

from tidemark.llm import queries
from tidemark.llm.chat_format import Template, format_chats, read_back

SCHEMA = "conv_id long, turn long, role string, text string, segments string, `a.b` int"
BITS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "[ROLE:x]", "[/ROLE]", "\\", "\\e", "\\l", "]", "a", "\n", "\u20ac", "\U0001f600", " "]


def machine(roles, t):
    """(valid, state after each turn)."""
    state, ok, path = "start", True, []
    for role in roles:
        legal = [s for s in t.moves.get(state, ()) if t.states[s][0] == role]
        ok = ok and bool(legal)
        state = (legal or [s for s, spec in t.states.items() if spec[0] == role] or ["other"])[0]
        path.append(state)
    return ok and state in t.final, path


def chats(seed=0, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        orderly = rng.random() < 0.5
        for k in range(rng.randint(1, 7)):
            role = ("user", "assistant")[k % 2] if orderly else rng.choice(["system", "user", "assistant", "tool", "[x]", None])
            rows.append((c, k, role, rng.choice([None, "", "".join(rng.choices(BITS, k=rng.randint(0, 6)))])))
    rows += [(None, 0, "user", "no id"), (n, 0, "user", "x" * 100_000), (n, 1, "assistant", "]" * 100_000), (n + 1, 3, "user", "tie"), (n + 1, 3, "assistant", "tie"), (n + 1, 3, "user", "tie"), (n + 2, None, "user", "null turn"), (n + 2, 0, "assistant", "after")]
    return rows


def check(spark, rows, template):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    got = read_back(format_chats(df, template), template).collect()
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((-1 if turn is None else turn, role or "", text or ""))
    assert len(got) == len(by)
    for r in got:
        turns = sorted(by[r.conv_id])
        valid, path = machine([t[1] for t in turns], template)
        assert [(t.role, t.text) for t in r.turns] == [t[1:] for t in turns] and r.n_turns == len(turns)
        assert r.valid == valid and r.end_state == path[-1]
        flags = [s in template.loss for s in path]
        assert r.loss_text == "".join(t[2] for t, f in zip(turns, flags) if f)
        assert r.loss_mask == [s.loss for s in r.segments] == [x for f in flags for x in (False, f, False)]
        assert "".join(s.text for s in r.segments) == r.formatted


def test_machine_and_round_trip(spark):
    check(spark, chats(), Template())


def test_another_template(spark):
    # Two states for one role: only the first answer is under the loss.
    states = {"ask": ("user", "[Q]", "[/Q]"), "first": ("assistant", "<a>", "</a>"), "later": ("assistant", "<b>", "</b>")}
    t = Template(states, ("[R:", "[/R]"), frozenset({"first", "other"}), {"start": ("ask",), "ask": ("first",), "first": ("later",), "later": ("later", "ask")}, frozenset({"later"}))
    rows = [r for c in range(30) for r in [(c, 0, "user", "q"), (c, 1, "assistant", "one")] + [(c, 2 + k, "assistant" if k < c % 4 else "tool", f"more {k}") for k in range(c % 6)]]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    back = {r.conv_id: r for r in format_chats(df, t).collect()}
    assert back[2].valid and back[2].formatted == "[Q]q[/Q]<a>one</a><b>more 0</b><b>more 1</b>" and [s.text for s in back[2].segments if s.loss] == ["one"]
    assert not back[0].valid and back[0].end_state == "first" and not back[5].valid
    assert [x.text for x in back[5].segments if x.loss] == ["one", "more 1", "more 2", "more 3", "more 4"]


def test_machine_is_in_the_plan(spark):
    plan = queries.op2_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "start" in plan and "Python" not in plan and "Arrow" not in plan


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    found = con.execute(queries.ORACLES["op2_chat_format"])
    names = [d[0] for d in found.description]
    got = queries.op2_chat_format(spark, sf).collect()
    assert sorted(str([r[n] for n in names]) for r in got) == sorted(str(list(r)) for r in found.fetchall())


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert read_back(format_chats(none)).count() == 0
