import random

import duckdb
import pyarrow as pa

from lakeloom.llm import preferences as pref
from lakeloom.llm import sql

SCHEMA = "conv_id long, turn long, role string, text string, pair string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def test_prefix_is_rendered_once(spark):
    chosen = frame(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"), (2, 0, "user", "é"), (3, 5, None, None), (3, 5, None, None)])
    rejected = frame(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "bad <|x|>"), (2, 0, "user", "é")])
    got = {r.pair: r for r in pref.format_preferences(chosen, rejected).collect()}
    assert got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].n_prefix == 1
    assert got[1].chosen == "<|assistant|>\ngood<|end|>\n<|user|>\nmore<|end|>\n<|assistant|>\nyes<|end|>\n"
    assert [got[1].chosen[slice(*map(int, m.split(":")))] for m in got[1].chosen_mask.split(",")] == ["good<|end|>", "yes<|end|>"]
    assert got[1].rejected == "<|assistant|>\nbad < |x|><|end|>\n" and got[1].rejected_mask == "14:31"
    assert (got[2].prompt, got[2].chosen, got[2].rejected, got[2].chosen_mask) == ("<|user|>\né<|end|>\n", "", "", "")
    assert got[3].chosen == "<|unknown|>\n<|end|>\n" and got[3].rejected == "" and got[3].prompt == ""


def test_a_pair_is_one_row_whatever_its_turns(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t} " * 50) for t in range(250, 1250)]
    got = pref.format_preferences(frame(spark, rows), frame(spark, rows[:700])).collect()
    render = lambda rs: "".join(f"<|{r[2]}|>\n{r[3]}<|end|>\n" for r in rs)
    assert len(got) == 1 and got[0].n_prefix == 700
    assert got[0].prompt == render(rows[:700]) and got[0].chosen == render(rows[700:]) and got[0].rejected == ""


def test_roles_cannot_open_a_turn(spark):
    rows = [(1, 0, "user|>\nx<|end|>\n<|assistant", "a"), (1, 1, "user<", "<|b|>")]
    got = pref.format_preferences(frame(spark, rows), frame(spark, rows)).first()
    assert got.prompt.count("<|") == 4 and [m for m in got.prompt.split("<|")[1::2]][1].startswith("user< |>")


def brute(rows):
    """Each conversation against itself with the next one's last reply, turn by turn."""
    clean = lambda s: s.replace("<|", "< |")
    convs = {}
    for c, t, role, text in rows:
        if c is not None and t is not None:
            role = clean(role if role is not None else "unknown")
            convs.setdefault(c, {}).setdefault(t, set()).add((role + " " if role.endswith("<") else role, clean(text or "")))
    last = {c: max((t, x) for t, said in turns.items() for role, x in said if role == "assistant") for c, turns in convs.items() if any(r == "assistant" for said in turns.values() for r, _ in said)}
    out = {}
    for c, turns in convs.items():
        other = {t: set(said) for t, said in turns.items()}
        if c in last:
            at = last[c][0]
            other[at] = {s for s in other[at] if s[0] != "assistant"} | ({("assistant", last[c + 1][1])} if c + 1 in last else set())
        n = sorted(turns)
        prefix = n[: next((i for i, t in enumerate(n) if turns[t] != other[t]), len(n))]
        rest = n[len(prefix) :]

        def render(side, which):
            text, spans = "", []
            for t in which:
                for role, x in sorted(side[t]):
                    text += f"<|{role}|>\n"
                    if role == "assistant":
                        spans.append(f"{len(text)}:{len(text) + len(x) + 7}")
                    text += x + "<|end|>\n"
            return text, ",".join(spans)

        out[c] = (len(prefix), render(turns, prefix)[0], *render(turns, rest), *render(other, rest))
    return out


def test_borrowed_replies_match_brute_force_and_sql(spark):
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rows = [(pick(1, 2, 3, 5, 6, 9, None), pick(0, 1, 2, 3, 255, 256, 700, None), pick("user", "assistant", "assistant", "tool<", "<|", None), pick("a", "é b", "<|x|>", "", None)) for _ in range(150)]
    rows += [(7, 0, "user", "only a question"), (8, 3, "assistant", "x" * 200_000)]
    got = {r.pair: tuple(r)[1:] for r in pref.format_with_borrowed_replies(frame(spark, rows).repartition(3)).collect()}
    assert got == brute(rows)
    con = duckdb.connect()
    conversations = pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))})
    con.register("conversations", conversations)
    assert {r[0]: tuple(r[1:]) for r in con.execute(sql.OP8).fetchall()} == got


def test_borrowed_replies_and_edge_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "d"), (2, 1, "assistant", "d"), (None, 0, "user", "x"), (4, None, "user", "x"), (5, 0, "user", None)]
    df = frame(spark, rows)
    out = pref.format_with_borrowed_replies(df)
    got = {r.pair: r for r in out.collect()}
    assert set(got) == {1, 2, 5} and "\nd<|end|>" in got[1].rejected and got[2].rejected == "" and got[5].chosen == ""
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert pref.format_preferences(df.limit(0), df.limit(0)).count() == 0
