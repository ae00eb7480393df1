import random

from twinleaf.llm import quote_threads as q

SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows):
    return {(r.conv_id, r.turn): r for r in q.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_levels_and_own_text():
    text = "On Monday, Ann wrote:\n> first LINE \n> > deeper\n>>deeper two\nmy answer\n\n> 5 is no mark only here"
    own, lines, quoted = q.parse(text)
    assert own == "my answer" and lines == ["my answer"]
    assert quoted == [(1, "first line"), (2, "deeper"), (2, "deeper two"), (1, "5 is no mark only here")]
    assert q.parse("a < b\nx > y") == ("a < b\nx > y", ["a < b", "x > y"], [])
    assert q.parse("") == ("", [], [])


def test_replies_follow_their_originals(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nAnd how do I group?"),
        (1, 1, "assistant", "> how do i  SORT?\nUse sort."),
        (1, 2, "user", "Unrelated remark"),
        (1, 3, "user", "> Use sort.\n> > How do I sort?\nThat fails."),
        (1, 4, "assistant", "> And how do I group?\nUse group."),
        (1, 5, "user", "> quotes nothing known\nhm"),
        (2, 0, "user", "> Use sort.\nother conversation"),
    ]
    got = run(spark, rows)
    assert [got[1, t].reply_to for t in range(6)] == [None, 0, None, 1, 0, None]
    assert [got[1, t].thread for t in range(6)] == [0, 0, 2, 0, 0, 5]
    assert [got[1, t].depth for t in range(6)] == [0, 1, 0, 2, 1, 0]
    assert got[1, 3].body == "That fails." and got[2, 0].reply_to is None
    order = sorted((r.position, r.turn) for k, r in got.items() if k[0] == 1)
    assert order == [(0, 0), (1, 1), (2, 3), (3, 4), (4, 2), (5, 5)]


def test_passages_are_found_however_they_are_wrapped(spark):
    long = "the first of many words that someone wrote down on one line and then more of them"
    rows = [
        (1, 0, "user", f"{long}\nkind regards"),
        (1, 1, "assistant", "nothing of it\nkind regards"),
        (1, 2, "user", "> The first of many words that\n> someone wrote down on one\n> line and then\nyes"),  # wrapped anew, and part of a line
        (1, 3, "user", f"> {long}\n> kind regards\nyes"),  # turn 1 has the second line too
        (1, 4, "user", "> many words that nobody wrote down on one line\nno"),
        (2, 0, "user", "hello\nkind regards"),
        (2, 1, "user", "bye\nkind regards"),
        (2, 2, "user", "> hello\n> kind regards\nshort lines, both of turn 0"),
    ]
    got = run(spark, rows)
    assert [got[1, t].reply_to for t in range(5)] == [None, None, 0, 0, None]
    assert got[2, 2].reply_to == 0


def naive(rows):
    """reply_to and thread of each message, a message at a time."""
    own = {(c, t): q.parse(x) for c, t, _, x in rows}
    out = {}
    for c, t, _, text in rows:
        votes = {}
        earlier = [u for d, u in own if d == c and u < t]
        for level, lines in q.passages(text):
            said = " ".join(lines).split()

            def holds(u):
                words = " ".join(own[c, u][0].lower().split()).split()
                if len(said) >= q.WORDS:
                    return any(words[i : i + len(said)] == said for i in range(len(words)))
                return set(lines) <= set(own[c, u][1])

            if found := [u for u in earlier if holds(u)]:
                weight = len(q.windows([" ".join(lines)])[0]) or len(set(lines))
                votes.setdefault((max(found), 1), []).append((level, weight, (level, tuple(lines))))
        counted = {}
        for level, line in own[c, t][2]:
            n, low = counted.get(line, (0, 99))
            counted[line] = n + 1, min(low, level)
        for line, (n, level) in counted.items():
            if found := [u for u in earlier if line in own[c, u][1]]:
                votes.setdefault((max(found), 0), []).append((level, n, line))
        best = None
        for (found, whole), each in votes.items():
            each = list({k: (level, n) for level, n, k in each}.values())
            best = max(filter(None, [best, (-min(x[0] for x in each), whole, sum(x[1] for x in each), found)]))
        out[c, t] = best[3] if best else None
    threads = {}
    for key in out:
        top = key
        while out[top] is not None:
            top = (top[0], out[top])
        threads[key] = top[1]
    return out, threads


def test_against_a_message_at_a_time(spark):
    rng = random.Random(5)
    rows = []
    for c in range(6):
        texts = []
        for t in range(25):
            lines = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 3))]
            quotes = []
            if texts and rng.random() < 0.8:
                for _ in range(rng.randint(1, 2)):
                    words = rng.choice(texts).replace(">", " ").split()
                    a = rng.randrange(len(words))
                    words = words[a : a + rng.randint(1, 20)]
                    mark = rng.choice(["> ", ">> "])
                    quotes += [mark + " ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
            texts.append("\n".join(quotes + lines))
            rows.append((c, t, "user", texts[-1]))
    got = run(spark, rows)
    links, threads = naive(rows)
    assert {k: r.reply_to for k, r in got.items()} == links and {k: r.thread for k, r in got.items()} == threads
    assert sum(x is not None for x in links.values()) > 40


def test_the_latest_earlier_turn_wins_and_most_lines_decide(spark, monkeypatch):
    rows = [(1, t, "user", "same line" if t % 2 == 0 else f"own {t}") for t in range(6)]
    rows += [(1, 6, "user", "> same line"), (1, 7, "user", "> same line\n> own 3\n> own 3 \n x")]
    for size in (1024, 2):
        monkeypatch.setattr(q, "RANGE", size)
        got = run(spark, rows)
        assert got[1, 6].reply_to == 4 and got[1, 7].reply_to == 3


def test_a_long_chain_and_a_hot_line(spark):
    rows = [(7, 0, "user", "line 0")] + [(7, t, "user", f"> line {t - 1}\nline {t}") for t in range(1, 150)]
    rows += [(8, t, "user", "> thanks\nthanks") for t in range(300)]
    got = run(spark, rows)
    assert all(got[7, t].thread == 0 and got[7, t].depth == t and got[7, t].position == t for t in range(150))
    assert all(got[8, t].reply_to == (t - 1 if t else None) and got[8, t].thread == 0 for t in range(300))


def test_awkward_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 1, "user", "> x"), (2, None, "user", "x"), (3, 0, "user", ""), (3, 1, "user", ">"), (4, 0, "u", "word " * 20000)]
    out = q.reply_ordered(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS body", "2 AS position")).collect()
    assert len(out) == len(rows)
    assert sorted(str(r.position) for r in out) == sorted(["0", "1", "None", "None", "0", "1", "0"])
    assert q.reply_ordered(spark.createDataFrame([], SCHEMA)).collect() == []
