import random

from corpusloom.llm import queries as q
from corpusloom.llm import quote_threads as qt


def test_parse():
    text = "Hello\n\nOn Monday, Ann wrote:\n> First line\n> second line\n>\n> > Deep  ONE\n>> deep two\n> Back\nMy answer\n"
    own, originals, quoted = qt.parse(text)
    assert own == "Hello\nMy answer"
    assert originals == qt.keys(["Hello"]) + qt.keys(["My answer"])
    assert quoted == [(1, k) for k in qt.keys(["First line", "second line", ""])] + [(2, k) for k in qt.keys(["deep one", "deep two"])] + [(1, k) for k in qt.keys(["Back"])]
    assert qt.parse(None) == qt.parse("") == ("", [], [])
    assert qt.parse("a > b\nOn it he wrote:")[0] == "a > b\nOn it he wrote:"
    assert len(qt.keys(["a", "b", "", "A  ", "c"])) == 5  # "a b", "a c", "a", "b", "c"


def brute(rows):
    """(parent, root, depth, linked) of each (conversation, turn)."""
    parsed = {}
    for c, t, text in rows:
        if c is not None and t is not None:
            _, o, qd = qt.parse(text)
            a = parsed.setdefault((c, t), (set(), set()))
            a[0].update(o)
            a[1].update(qd)
    parent, linked = {}, {}
    for (c, t), (_, quoted) in parsed.items():
        found = []
        for level, h in quoted:
            owners = [t2 for (c2, t2), (o, _) in parsed.items() if c2 == c and h in o]
            if owners and min(owners) < t:
                found.append((-level, min(owners)))
        if found:
            parent[c, t], linked[c, t] = max(found)[1], len(found)
    out = {}
    for c, t, _ in rows:
        up, depth = t, 0
        while (c, up) in parent:
            up, depth = parent[c, up], depth + 1
        out[c, t] = (parent.get((c, t)), up, depth, linked.get((c, t), 0))
    return out


def test_threads_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in range(12):
        said = []
        for t in range(rng.randint(1, 14)):
            lines = [f"words {rng.randrange(40)} of {c % 3}" for _ in range(rng.randint(0, 3))]
            text = "\n".join(lines)
            if said and rng.random() < 0.7:
                old = rng.choice(said)
                text = "\n".join("> " + x for x in old.split("\n")[: rng.randint(1, 5)]) + "\n" + text
            said.append(text)
            rows.append((c, t, "user", text))
    # one conversation with most messages, all quoting its first, and a chain of replies
    rows += [(50, 0, "user", "the very first words")] + [(50, i, "user", f"> the very first words\nreply {i}") for i in range(1, 200)]
    rows += [(60, i, "user", (f"> step {i - 1}\n" if i else "") + f"step {i}") for i in range(40)]
    rows += [(None, 1, "user", "> step 1"), (60, None, "user", "> step 1"), (70, 1, None, None), (70, 2, "user", ""), (70, 3, "user", "> " + "x" * 1_000_000)]
    rows += rows[:4]
    df = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, reply_p string").repartition(4)
    want = brute([(c, t, text) for c, t, _, text in rows])
    got = q.op3(spark, df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["parent_turn"], r["root_turn"], r["depth"], r["n_linked"]) == want[r["conv_id"], r["turn"]]
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[60, 39]["depth"] == 39 and by[50, 150]["parent_turn"] == 0 and by[50, 150]["own_text"] == "reply 150" and by[70, 1]["own_text"] == ""
    ordered = qt.reply_ordered(qt.thread(df.where("conv_id IS NOT NULL AND turn IS NOT NULL"))).collect()
    seen = set()
    for r in ordered:
        assert r["reply"]["parent_turn"] is None or (r["conv_id"], r["reply"]["parent_turn"]) in seen
        seen.add((r["conv_id"], r["turn"]))
    assert q.op3(spark, df.where("turn < -5")).count() == 0


def test_texts_without_quotes_pass_unchanged(spark):
    sf = "/root/testdata/sf0.01"
    want = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    for r in q.QUERIES["op3_quote_threads"](spark, sf).collect():
        assert want[r["conv_id"], r["turn"]].strip("\n") == r["own_text"] and r["root_turn"] == r["turn"] and r["n_quoted"] == 0


def test_conversations_against_plain_python(spark):
    """Every thread in the order of its turns, own texts only, cut into parts; one with most messages among them."""
    rng = random.Random(9)
    rows, said = [], {}
    for c, n in [(1, 300), (2, 7), (3, 1), (4, 40)]:
        for t in range(n):
            text = f"message {t} of {c}, {rng.random()}"
            if t and rng.random() < 0.8:
                text = f"> {said[c, rng.randrange(t)]}\n\n{text}"
            said[c, t] = text.split("\n")[-1]
            rows.append((c, t, rng.choice(["user", "assistant"]), text))
    rows += [(None, 1, "user", "no conversation"), (2, None, "user", "no turn"), (5, 1, None, None), (2, 3, "user", "again")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, position int, C string").repartition(7)
    out = qt.thread(df)
    assert out.columns == ["conv_id", "turn", "role", "text", "position", "C", "reply"]
    want = {}
    answers = brute([(c, t, x) for c, t, _, x in rows])
    for c, t, role, text in rows:
        want.setdefault((c, answers[c, t][1]), []).append((t, role, qt.parse(text)[0]))
    built = {}
    for r in qt.conversations(out, most=16).collect():
        assert len(r["messages"]) <= 16
        built.setdefault((r["conversation"], r["root_turn"]), []).append((r["part"], r["messages"]))
    assert set(built) == set(want)
    for key, parts in built.items():
        parts.sort()
        assert [p for p, _ in parts] == list(range(len(parts)))
        got = [m for _, ms in parts for m in ms]
        assert [m["position"] for m in got] == list(range(len(got)))
        assert [m["turn"] for m in got] == sorted((t for t, _, _ in want[key]), key=lambda t: t or 0)
        assert sorted((m["turn"] or 0, m["role"] or "", m["text"]) for m in got) == sorted((t or 0, r or "", x) for t, r, x in want[key])
        assert all(not m["text"].startswith(">") for m in got)


def test_query_of_built_conversations(spark):
    rows = [(1, 0, "user", "How are you?"), (1, 1, "assistant", "> How are you?\n\nFine."), (1, 2, "user", "Another matter."), (1, 3, "user", "> Fine.\n\nGood."), (2, 0, None, None), (None, 5, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["root_turn"], r["part"]): (r["n_messages"], r["text"]) for r in q.quote_conversations(spark, df).collect()}
    assert got[1, 0, 0] == (3, "user: How are you?\n\nassistant: Fine.\n\nuser: Good.") and got[1, 2, 0] == (1, "user: Another matter.")
    assert got[2, 0, 0] == (1, ": ") and got[None, 5, 0] == (1, "user: lost") and len(got) == 4
    sf = "/root/testdata/sf0.01"
    whole = q.QUERIES["quote_conversations"](spark, sf)
    assert whole.selectExpr("sum(n_messages)").first()[0] == spark.read.parquet(f"{sf}/conversations.parquet").count()
    assert q.quote_conversations(spark, df.where("turn > 99")).count() == 0
