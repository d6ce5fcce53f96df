import random

import duckdb

from heapspan.llm.chat import ORACLE, conversations, link


def rows(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, depth string")


def test_threads(spark):
    df = rows(spark, [
        (1, 0, "a", "Hello there.\n\nHow ARE you?", "x"),
        (1, 1, "b", "a wrote:\n> How are  you?\nFine.", None),
        (1, 2, "a", ">> how are you?\n> Fine.\nGood", None),
        (1, 3, "c", "no quotation\nbut two lines", None),
        (1, 4, "c", "> but two lines\nyes\n> never said\n", None),
        (1, 5, "c", "> Good\n\nok\n", None),
        (2, 0, "a", "Fine.", None),
        (2, 1, "b", "> Hello there.\nother conversation", None),
        (2, 1, "b", "> Fine.\nagain", None),
        (2, 2, None, None, None),
        (2, 3, None, "", None),
        (None, 3, None, "> Fine.", None),
        (3, None, None, "> Fine.", None),
    ])
    got = {(r.conv_id, r.turn, r.text): r for r in link(df).collect()}
    assert len(got) == 13
    t = lambda c, n, x: tuple(got[c, n, x])[4:10]
    # quote_levels, n_quotes, n_linked, reply_to, thread_turn, depth
    assert t(1, 0, "Hello there.\n\nHow ARE you?") == (0, 0, 0, None, 0, 0)
    assert t(1, 1, "Fine.") == (1, 1, 1, 0, 0, 1)
    assert t(1, 2, "Good") == (2, 2, 2, 1, 0, 2)
    assert t(1, 3, "no quotation\nbut two lines") == (0, 0, 0, None, 3, 0)
    assert t(1, 4, "yes") == (1, 2, 1, 3, 3, 1)
    assert t(1, 5, "ok") == (1, 1, 1, 2, 0, 3)
    assert t(2, 1, "again")[3:] == (0, 0, 1) and t(2, 2, None) == (0, 0, 0, None, 2, 0) and t(2, 3, "")[3:] == (None, 3, 0)
    assert [got[1, n, x].position for n, x in ((0, "Hello there.\n\nHow ARE you?"), (1, "Fine."), (2, "Good"), (4, "yes"), (5, "ok"))] == [0, 1, 2, 1, 3]
    built = {(r.conv_id, r.thread_turn): [(m.turn, m.text) for m in r.messages] for r in conversations(link(df)).collect()}
    assert built[1, 0] == [(0, "Hello there.\n\nHow ARE you?"), (1, "Fine."), (2, "Good"), (5, "ok")] and built[1, 3] == [(3, "no quotation\nbut two lines"), (4, "yes")]
    assert len(built) == 5
    assert t(None, 3, "") == (1, 1, 0, None, 3, 0) and t(3, None, "") == (1, 1, 0, None, None, 0)


def test_long_chain_and_empty(spark):
    chain = [(1, i, "a", (f"> m{i - 1}\n" if i else "") + f"m{i}", None) for i in range(40)]
    got = {r.turn: r for r in link(rows(spark, chain)).collect()}
    assert all(got[i].depth == i == got[i].position and got[i].thread_turn == 0 and got[i].text == f"m{i}" for i in range(40))
    parts = sorted((r.part, [m.turn for m in r.messages]) for r in conversations(link(rows(spark, chain)), most=16).collect())
    assert parts == [(0, list(range(16))), (1, list(range(16, 32))), (2, list(range(32, 40)))]
    assert link(rows(spark, chain).limit(0)).collect() == []


def test_quoting_what_comes_later_or_itself(spark):
    got = {r.turn: r for r in link(rows(spark, [(1, 0, "a", "> later\nx", None), (1, 1, "b", "later", None), (1, 2, "b", "> same\nsame", None)])).collect()}
    assert got[0].reply_to is None and got[2].reply_to is None and got[2].n_quotes == 1


def test_hot_line_and_long_nested_thread(spark, monkeypatch):
    """A line that every message quotes, replies to the last message in five levels, and two rows of each turn; against the SQL."""
    from heapspan.llm import chat

    monkeypatch.setattr(chat, "SPAN", 16)
    data = [(1, 0, "a", "agreed\n\nm0", None)]
    for i in range(1, 120):
        quoted = "".join(f"{'>' * k} m{i - k}\n" for k in range(min(5, i), 0, -1))
        data += [(1, i, "b", f"> agreed\n\nx wrote:\n{quoted}m{i}", None)] * (2 if i % 3 else 1)
    data += [(2, i, "c", "> agreed\nyes" if i else "agreed", None) for i in range(60)]
    df = rows(spark, data)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [x[:4] for x in data])
    got = link(df).collect()
    assert sorted(map(str, con.sql(ORACLE).fetchall())) == sorted(str(tuple(x)) for x in got)
    assert max(r.depth for r in got) == 119 and max(r.position for r in got) == 119 and max(r.quote_levels for r in got) == 5


def test_very_long_text(spark):
    """Tens of thousands of lines of one level."""
    long = "\n".join(f"line {i}" for i in range(20_000))
    df = rows(spark, [(1, 0, "a", long, None), (1, 1, "b", "\n".join("> " + x for x in long.split("\n")) + "\nall of it", None)])
    got = {r.turn: r for r in link(df).collect()}
    assert (got[1].reply_to, got[1].n_quotes, got[1].text) == (0, 1, "all of it")


def test_sql(spark):
    r = random.Random(2)
    said = ["Hello  there", "fine.", "how are\nyou", "one\n\ntwo two", "and so on", ""]
    data = []
    for conv in range(12):
        for turn in range(r.randint(1, 9)):
            text = r.choice(said)
            for _ in range(r.choice([0, 0, 1, 2])):
                mark = r.choice(["> ", ">", ">> ", "> > "])
                text = r.choice(["", "x wrote:\n"]) + "\n".join(mark + x for x in r.choice(said).upper().split("\n")) + "\n" + text
            data.append((conv, turn, r.choice("ab"), text, None))
    data += [(1, 1, None, "> fine.", None), (3, None, "a", "> fine.", None), (None, 3, "a", "fine.", None), (4, 20, "a", None, None)]
    df = rows(spark, data)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [x[:4] for x in data])
    want = con.sql(ORACLE).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in link(df).collect())
