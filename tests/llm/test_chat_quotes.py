import random

import pytest

from lakewright.llm.chat_quotes import link_quotes

SCHEMA = "conv_id long, turn long, role string, text string"
A = "The cache is cold after a restart. We should warm it up first!"
B = "Who owns the warm-up job? I could take it over next week."
C = "Fine by me."


def rows(spark, data):
    return {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(data, SCHEMA)).collect()}


@pytest.fixture(scope="module")
def linked(spark):
    data = [
        (1, 0, "user", A),
        (1, 1, "assistant", B),
        (1, 2, "user", f"On Monday, Ann wrote:\n> {A}\n\nYes, let us do that.\n"),
        (1, 3, "assistant", f"> On Tuesday Bob wrote:\n>> the cache is COLD after a restart.\n> Yes, let us do that.\nDone then."),
        (1, 4, "user", f"> Who owns the warm-up\n> job? I could take it over next week.\n{C}"),
        (1, 5, "user", "> something that nobody said\nWhat was that?"),
        (1, 6, "user", "no quotes > here\n    > indented code"),
        (2, 0, "user", f"> {A}\nanother conversation"),
        (2, 1, "user", f"> {C}"),
        (2, 2, None, C),
        (3, 0, "user", None),
        (3, 1, "user", ""),
        (3, 2, "user", ">"),
        (3, 3, "user", "> > > deep\r\n> > deep\r\nmine"),
        (None, 1, "user", f"> {A}\nx"),
        (1, None, "user", f"> {A}\ny"),
        (4, 0, "user", "same here."),
        (4, 0, "user", "same here."),
        (4, 1, "user", "> same here.\nok"),
        (4, 1, "user", "> same here.\nok"),
    ]
    return rows(spark, data), data


def test_replies_are_linked_to_their_sources(linked):
    got, _ = linked
    want = {2: 0, 3: 2, 4: 1, 5: None, 6: None, 0: None, 1: None}
    assert {t: got[1, t].parent_turn for t in want} == want
    assert got[1, 3].thread == 0 and got[1, 3].depth == 2 and got[1, 4].thread == 1 and got[1, 4].depth == 1
    assert got[1, 3].n_quotes == 3 or got[1, 3].n_linked == 2
    assert got[1, 5].n_quotes == 1 and got[1, 5].n_linked == 0 and got[1, 5].thread == 5


def test_content_is_without_quotes(linked):
    got, _ = linked
    assert got[1, 2].content == "Yes, let us do that." and got[1, 3].content == "Done then." and got[1, 4].content == C
    assert got[1, 6].content == "no quotes > here\n    > indented code"
    assert got[3, 0].content is None and got[3, 1].content == "" and got[3, 2].content == "" and got[3, 3].content == "mine"
    assert got[3, 3].n_quotes == 2 and got[1, 2].formatted == "<|user|>\nYes, let us do that."
    assert got[2, 2].formatted == "<|>\n".replace("<|>", "<||>") + C


def test_links_stay_within_earlier_turns_of_a_conversation(linked):
    got, _ = linked
    assert got[2, 0].parent_turn is None and got[2, 1].parent_turn is None
    assert got[None, 1].parent_turn is None and got[1, None].parent_turn is None and got[1, None].content == "y"


def test_no_row_is_lost(spark, linked):
    _, data = linked
    df = spark.createDataFrame(data, SCHEMA)
    out = link_quotes(df.selectExpr("*", "1 AS thread", "'x' AS content"))
    assert out.count() == len(data) and out.where("conv_id = 4 and turn = 1 and parent_turn = 0").count() == 2
    assert link_quotes(df.limit(0)).count() == 0


def test_positions_follow_replies(linked):
    got, _ = linked
    assert [got[1, t].position for t in (0, 2, 3, 1, 4, 5, 6, None)] == list(range(8))
    assert got[None, 1].position is None and [got[4, t].position for t in (0, 1)] == [0, 1]
    for (c, _), r in got.items():
        assert r.parent_turn is None or got[c, r.parent_turn].position < r.position


def generated(seed, conversations=120):
    """Conversations with thousands of quotes, some of several messages, nested, announced, cut or made up."""
    r = random.Random(seed)
    say = lambda c, t: " ".join(f"{r.choice(['The plan', 'Café', 'No. 7', 'It'])} of {r.choice('abcde')}{r.randint(0, 40)} is {w}{r.choice('.!?')}" for w in (f"c{c}t{t}", "fine", r.choice(["old", "new"])))
    announce = ["On Monday, Ann wrote:", "Am Montag schrieb Bo: ", "Le 3 mai, Cy a écrit :", "El lunes Di escribió:", "Ed said:", "  wrote:", " wrote:", "On wrote:", "They spoke:", "x" * 90 + " wrote:"]
    data = []
    for c in range(conversations):
        said = []
        for t in range(r.randint(1, 40 if c else 400)):
            body = say(c, t)
            lines = []
            for q in r.sample(said, min(len(said), r.randint(0, 3))):
                mark = r.choice(["> ", ">", ">> ", "> > ", "  > ", "\t>"])
                if r.random() < 0.5:
                    lines.append(r.choice(announce))
                lines += [mark + x for x in q.replace(". ", ".\n" if r.random() < 0.3 else ". ").split("\n")]
                lines.append(r.choice(["", "", "I see.", "\n\n", "  "]))
            lines.append(body)
            said.append(body)
            data.append((c, t, r.choice(["user", "assistant", None]), r.choice(["\n", "\n", "\r\n"]).join(lines)))
    return data


def test_a_generated_corpus_equals_sql(spark):
    data = generated(5)
    got = against_sql(spark, data)
    assert sum(r.n_quotes for r in got) > 3000 and sum(r.n_linked for r in got) > 2000 and max(r.depth for r in got) > 5


def test_long_lines_and_runs_do_not_overflow(spark):
    n = 100_000
    texts = [">" * n + "x", "> " * n, " \t>" + ">\t" * n, "> a\n" + "b" + " " * (10 * n) + "c", "> a\n" + " " * (10 * n), "am x schrieb" + " schrieb" * n + " " * n + "x\n> a", "on " + "x wrote " * n + "\n> a", " " * n + ":" + " " * n + ":\n> a", "> a\nb" + "\n" * n + "c", "> a\nb\n" * (n // 10)]
    got = rows(spark, [(1, i, "user", t) for i, t in enumerate(texts)])
    assert [got[1, i].n_quotes for i in range(len(texts))] == [1] * 9 + [n // 10]
    assert got[1, 3].content == "b" + " " * (10 * n) + "c" and got[1, 4].content == "" and got[1, 8].content == "b\n\nc"


def test_against_sql(spark, linked):
    against_sql(spark, linked[1])


def against_sql(spark, data):
    import duckdb
    import pandas as pd

    from lakewright.llm.queries import ORACLE_SQL, op9_columns

    con = duckdb.connect()
    frame = pd.DataFrame(data, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    rows = con.execute(ORACLE_SQL["op9_quotation_linking"])
    names = [d[0] for d in rows.description]
    want = sorted(map(repr, rows.fetchall()))
    got = op9_columns(link_quotes(spark.createDataFrame(data, SCHEMA))).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    return got


def test_long_chains_and_long_texts(spark):
    data = [(7, 0, "user", "Line number 0 of the chain.")]
    data += [(7, i, "user", f"> Line number {i - 1} of the chain.\nLine number {i} of the chain.") for i in range(1, 40)]
    data += [(8, 0, "user", "\n".join(f"> line {i} here.\nline {i} there." for i in range(1500)))]
    got = rows(spark, data)
    assert all(got[7, i].depth == i and got[7, i].thread == 0 for i in range(40))
    assert got[8, 0].n_quotes == 1500


def test_runs_without_python(spark):
    df = spark.createDataFrame([(1, 0, "user", A)], SCHEMA)
    plan = link_quotes(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
