"""Chat formatting against its SQL on thousands of messages with nested quotes, and worked cases."""

import random
from collections import Counter

import duckdb
import pyarrow as pa

from lodestrata.llm import chat, chat_sql

SCHEMA = "conv_id long, turn long, role string, text string"


def formatted(spark, rows):
    return chat.format_chats(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS body", "3 AS depth"))


def by_sql(rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    con = duckdb.connect()
    con.register("conversations", pa.table({n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(("conv_id", "turn", "role", "text"))}))
    found = con.sql(chat_sql.SQL)
    return found.columns, Counter(found.fetchall())


def made(seed, n, convs):
    """Messages that quote each other: nested levels, parts of bodies, other case, edits, repeated ids, ties and nulls."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Straße", "naïve x", "😀"]

    def line():
        return " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))

    rows, bodies = [], []
    for _ in range(n):
        out, body = [], []
        if bodies and rng.random() < 0.6:
            for _ in range(rng.randrange(1, 3)):
                for depth in rng.sample([1, 2, 3], rng.randrange(1, 3)):
                    source = rng.choice(bodies[-40:] if rng.random() < 0.5 else bodies)
                    at = rng.randrange(len(source))
                    part = source[at : at + rng.randrange(1, 9)]
                    part = [p.upper() for p in part] if rng.random() < 0.3 else part
                    part = part + [line()] * (rng.random() < 0.2)
                    mark = rng.choice([">", "> ", ">\t"]) if depth == 1 else rng.choice([">" * depth + " ", "> " * depth])
                    out += [mark + p for p in part]
                    if rng.random() < 0.5:
                        body.append(line())
                        out.append(body[-1])
        new = [rng.choice([line(), line(), line(), "", "common line", "  " + line()]) for _ in range(rng.randrange(9))]
        body, out = body + new, out + new
        if body:
            bodies.append(body)
        null = lambda x: None if rng.random() < 0.01 else x
        rows.append((null(rng.randrange(convs)), null(rng.randrange(3 * n // convs)), rng.choice(["user", "assistant", None]), null(rng.choice(["\n", "\n", "\r\n"]).join(out))))
    ring = [(10**6, 0, "a", "> zz 1\nzz 2"), (10**6 + 1, 0, "a", "> zz 2\nzz 3"), (10**6 + 2, 0, "a", "> zz 3\nzz 1"), (10**6 + 2, 1, "a", "tail")]
    chain = [(2 * 10**6, t, "a", f"> chain {t - 1}\nchain {t}" if t else "chain 0") for t in range(300)]
    long = "\n".join(f"long {i}" for i in range(3000))
    return [*rows, *rows[:20], *ring, *chain, (3 * 10**6, 500, "a", long), (3 * 10**6, 999, "a", "> " + long.replace("\n", "\n> ") + "\nyes"), (3 * 10**6, 10**12, "a", "> long 7\n> long 8\n> long 9")]


def test_generated_messages_against_sql(spark):
    for seed, n, convs in ((1, 200, 5), (2, 2500, 40)):
        rows = made(seed, n, convs)
        df = formatted(spark, rows)
        names, want = by_sql(rows)
        got = Counter(tuple(r) for r in df.collect())
        assert df.columns == names and got == want
        kinds = Counter(r[9] for r in got.elements())
        assert kinds["quote"] > n / 3 and kinds["turn"] and max(r[12] or 0 for r in got) >= 299


def test_given_messages_against_sql(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in df.collect()]
    assert Counter(tuple(r) for r in chat.format_chats(df).collect()) == by_sql(rows)[1]


def test_worked_cases(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIt is long."), (1, 1, "assistant", "> how do I sort  a list?\nUse sorted().\n\nIt is stable."), (1, 2, "user", ">> How do I sort a list?\n> Use sorted().\nThanks"),
        (1, 3, "user", "> never said\nhm"), (2, 0, "user", "> It is stable.\nIs it?"), (2, 1, "user", None), (None, 0, "user", "> It is stable."), (2, None, "x", ""), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "user", "> a"), (3, 9, "user", "b"),
    ]
    got = [tuple(r) for r in formatted(spark, rows).collect()]
    assert len(got) == len(rows)
    by = {r[:2]: r[3:-1] for r in got}
    assert by[1, 0] == ("How do I sort a list?\nIt is long.", 0, 0, 0, None, None, None, 1, 0, 0)
    assert by[1, 1] == ("Use sorted().\n\nIt is stable.", 1, 1, 1, 1, 0, "quote", 1, 0, 1)
    assert by[1, 2] == ("Thanks", 2, 2, 2, 1, 1, "quote", 1, 0, 2)
    assert by[1, 3] == ("hm", 1, 0, 1, 1, 2, "turn", 1, 0, 3)
    assert by[2, 0] == ("Is it?", 1, 1, 1, 1, 1, "quote", 1, 0, 2) and by[2, 1] == ("", 0, 0, 0, 2, 0, "turn", 1, 0, 3)
    assert by[3, 1][3:] == (1, 3, 0, "quote", 3, 0, 1) and by[3, 9][4:] == (3, 1, "turn", 3, 0, 2) and by[None, 0][4:] == (None,) * 6
    ordered = [r[:2] for r in map(tuple, chat.conversations(formatted(spark, rows)).collect()) if None not in r[:2]]
    assert ordered == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (3, 0), (3, 0), (3, 1), (3, 9)]
    assert formatted(spark, rows[:0] or []).count() == 0


def test_its_own_conversation_does_not_hide_the_original(spark):
    rows = [("a", 0, "x", "> hello world"), ("a", 1, "x", "hello world"), ("b", 0, "x", "hello world")]
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string"))).collect()}
    assert got["a", 0] == ("b", 0) and got["a", 1] == ("a", 0)


def test_circles_and_parts(spark):
    ring = [(1, 0, "x", "> two\none"), (2, 0, "x", "> one\ntwo"), (2, 1, "x", "more")]
    got = {(r.conv_id, r.turn): tuple(r)[7:-1] for r in formatted(spark, ring).collect()}
    assert got == {(1, 0): (None, None, None, 1, 0, 0), (2, 0): (1, 0, "quote", 1, 0, 1), (2, 1): (2, 0, "turn", 1, 0, 2)}
    rows = [(1, 0, "x", "c\nd"), (1, 1, "x", "a\nb\nc\nd\ne"), (1, 2, "x", "z"), (1, 3, "x", "> a\n> b\n> c\n> d"), (1, 4, "x", "> a\n>\n> new\n> d\n> e")]
    got = {(r.conv_id, r.turn): (r.reply_turn, r.reply_by) for r in formatted(spark, rows).collect()}
    assert got[1, 3] == (1, "quote") and got[1, 4] == (1, "quote")


def test_branches_stay_together(spark, monkeypatch):
    """Two branches of one root, an answer in each, and many answers to one message, put in order in one task and in groups."""
    rows = [(1, 0, "x", "root words here"), (2, 0, "x", "> root words here\nfirst branch"), (3, 0, "x", "> root words here\nsecond branch"), (4, 0, "x", "> first branch\nanswer one"), (5, 0, "x", "> second branch\nanswer two"), (2, 1, "x", "own next"), (1, 1, "x", "tail")]
    got = [(r.conv_id, r.turn, r.position) for r in chat.conversations(formatted(spark, rows)).collect()]
    assert got == [(1, 0, 0), (1, 1, 1), (2, 0, 2), (2, 1, 3), (4, 0, 4), (3, 0, 5), (5, 0, 6)]
    rows = [(0, 0, "x", "the question"), *((i, t, "x", "> the question\nsaid %d" % i if t == 0 else "more") for i in range(1, 41) for t in range(3))]
    assert [(r.conv_id, r.turn) for r in chat.conversations(formatted(spark, rows)).collect()] == [(r[0], r[1]) for r in rows]
    monkeypatch.setattr(chat, "SIBLINGS", 8)
    found = chat.conversations(formatted(spark, rows)).collect()
    assert [r.position for r in found] == list(range(121)) and [r.conv_id for r in found[1::3]] == [r.conv_id for r in found[3::3]]
    assert [r.turn for r in found[1:]] == [0, 1, 2] * 40 and sorted(r.conv_id for r in found[1::3]) == list(range(1, 41))


def test_order_of_answers_does_not_depend_on_their_number(spark, monkeypatch):
    """beyond SIBLINGS answers, groups by hash were put one after the other. Two messages with many answers, in ranges of few."""
    rows = [(i, 0, "x", f"question {i}") for i in range(2)] + [(100 * i + j, 0, "x", f"> question {i % 2}\nsaid {i} {j}") for i in range(1, 7) for j in range(9)]
    want = by_sql(rows)[1]
    monkeypatch.setattr(chat, "SIBLINGS", 5)
    assert Counter(tuple(r) for r in formatted(spark, rows).collect()) == want
