import random
import re
from collections import Counter

import pytest
from helpers import SF

from quire.llm import quotes


def lines_of(text):
    out = []
    for x in re.split(r"\r?\n", text or "") if text is not None else []:
        m = re.match(quotes.QUOTE, x)
        head = m[0] if m else ""
        out.append((head.count(">"), x[len(head) :]))
    return out


def norm(x):
    return re.sub(r"\s+", " ", x.lower()).strip(" ")


def announces(ls, i):
    return ls[i][0] == 0 and i + 1 < len(ls) and ls[i + 1][0] > 0 and bool(re.match(quotes.ATTRIBUTION, ls[i][1]))


def passages(ls):
    """(first line, level, contents) of runs of one level."""
    out = []
    for i, (level, x) in enumerate(ls):
        if not i or ls[i - 1][0] != level:
            out.append((i, level, []))
        out[-1][2].append(x)
    return out


def paragraphs(contents):
    return re.split(r"\n[ \t]*(?:\n[ \t]*)+", "\n".join(contents))


def brute(messages):
    first, said = {}, {}
    for c, t, _, text in messages:
        if t is None:
            continue
        ls = lines_of(text)
        own = [(level, "" if announces(ls, i) else x) for i, (level, x) in enumerate(ls)]
        whole = norm(" ".join(x for i, (level, x) in enumerate(ls) if level == 0 and not announces(ls, i)))
        found = {norm(" ".join(xs)) for _, level, xs in passages(own) if level == 0}
        found |= {norm(y) for _, level, xs in passages(own) if level == 0 for p in paragraphs(xs) for y in [p, *p.split("\n")]}
        for n in (found | {whole}) - {""}:
            first[c, n] = min(t, first.get((c, n), t))
        if whole:
            said[c, whole] = min(t, said.get((c, whole), t))
    anywhere = {}
    for (c, n), t in first.items():
        k = (t, c is not None, "" if c is None else f"+{c}")
        if n not in anywhere or k < anywhere[n][0]:
            anywhere[n] = (k, c, t)

    def origin(c, t, n):
        long = len(n.split(" ")) >= quotes.LEAST
        near = (first if long else said).get((c, n), t)
        if near < t:
            return c, near
        return anywhere[n][1:] if long and n in anywhere and anywhere[n][1] != c else None

    found, parent = {}, {}
    for c, t, _, text in messages:
        if t is None:
            continue
        votes, counts = Counter(), [0, 0, 0]
        for _, level, xs in passages(lines_of(text)):
            if not level:
                continue
            settled = []
            n = norm(" ".join(xs))
            if n and origin(c, t, n):
                settled.append(n)
            else:
                for p in paragraphs(xs):
                    if norm(p) and origin(c, t, norm(p)):
                        settled.append(norm(p))
                    else:
                        settled += [norm(x) for x in p.split("\n") if norm(x)]
            for n in settled:
                words = len(n.split(" "))
                counts[0] += words
                counts[2] = max(counts[2], level)
                if o := origin(c, t, n):
                    counts[1] += words
                    if level == 1 and o[0] == c:
                        votes[o[1]] += words
        found[c, t] = votes, counts
    for key, (votes, _) in found.items():
        if votes:
            parent[key] = max(votes, key=lambda p: (votes[p], p))
    out = []
    for c, t, role, text in messages:
        root, depth = t, 0
        while (c, root) in parent:
            root, depth = parent[c, root], depth + 1
        ls = lines_of(text)
        keep = [x for i, (level, x) in enumerate(ls) if level == 0 and not announces(ls, i)]
        counts = found[c, t][1] if t is not None else [0, 0, 0]
        out.append((c, t, role, parent.get((c, t)), root, depth, *counts, None if text is None else re.sub(r"^\s+|\s+$", "", "\n".join(keep))))
    return sorted(out, key=repr)


def check(df):
    got = sorted(map(tuple, quotes.conversations(df).collect()), key=repr)
    assert got == brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


SCHEMA = "conv_id long, turn long, role string, text string"


def test_sample(spark):
    check(spark.read.parquet(f"{SF}/conversations.parquet"))


@pytest.mark.parametrize("seed", [1, 2])
def test_quoting(spark, seed):
    r = random.Random(seed)
    data, said = [], {}
    for c in [None, *range(8)]:
        for t in range(r.randrange(1, 12) if c != 1 else 60):
            text = [r.choice(["Yes.", f"Line {r.randrange(40)} of   text", "", "thanks", f"unique {c} {t}"]) for _ in range(r.randrange(1, 5))]
            if t and r.random() < 0.8:
                source = r.choice([x for (a, _), x in said.items() if a == c] or [["?"]])
                if r.random() < 0.3:  # wrapped anew
                    source = re.sub(r"(\S+ \S+) ", lambda m: m[1] + "\n", " ".join(source)).split("\n")
                elif r.random() < 0.4:  # in part
                    source = source[r.randrange(len(source)) :]
                quoted = [r.choice([">", "> ", " >"]) + x for x in source]
                text = [r.choice(["On Monday, Ann wrote:", "hm"]), *quoted, *text] if r.random() < 0.7 else [*text, *quoted]
            said[c, t] = text
            data.append((c, t, "user", "\n".join(text)))
    data += [(3, None, "user", "> Yes.\nx"), (5, 70, "user", None), (6, 71, "a", "")]
    data += [(7, 80, "user", "word " * 40_000), (7, 81, "user", "> " + "word " * 40_000 + "\nshort")]
    check(spark.createDataFrame(data, SCHEMA))


def test_other_columns_and_repeated_rows(spark):
    data = [(1, 0, "u", "what is the plan"), (1, 1, "u", "> what is the plan\nnone"), (1, 1, "u", "> what is the plan\nnone")]
    df = spark.createDataFrame(data, SCHEMA)
    extra = df.selectExpr("*", "turn as k", "text as hash", "1 as first_line", "role as lines", "2 as words")
    got = [tuple(r) for r in quotes.conversations(extra).orderBy("turn").collect()]
    assert [g[:3] for g in got] == [d[:3] for d in data] and [g[3] for g in got] == [None, 0, 0]


def test_passages_decide_and_common_lines_do_not(spark):
    data = [(1, 0, "u", "thanks\nBudget is 5"), (1, 1, "u", "I propose plan B\nthanks"), (1, 2, "u", "> I propose plan B\n> thanks\nfine"), (2, 0, "u", "hello there"), (2, 1, "u", "> thanks\nwhat?")]
    data += [(3, 0, "u", "a long paragraph that a mail program wraps anew"), (3, 1, "u", "some other words here"), (3, 2, "u", "> a long paragraph that\n> a mail program wraps anew\nyes"), (3, 3, "u", ">> a long paragraph that a mail\n>> program wraps anew\n> yes\ngood")]
    df = spark.createDataFrame(data, SCHEMA)
    check(df)
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(df).collect()}
    assert got[1, 2].reply_to == 1 and got[3, 2].reply_to == 0 and got[3, 3].reply_to == 2 and got[3, 3].max_level == 2
    assert got[2, 1].reply_to is None and got[2, 1].linked_words == 0 and got[2, 1].quoted_words == 1


def test_passages_chain_and_empty(spark):
    chain = [(1, 0, "u", "start")] + [(1, t, "u", f"> {'start' if t == 1 else f'reply {t - 1}'}\nreply {t}") for t in range(1, 40)]
    df = spark.createDataFrame(chain, SCHEMA)
    check(df)
    assert quotes.conversations(df).agg({"depth": "max"}).first()[0] == 39
    assert [r.turn for r in quotes.in_reply_order(df).collect()] == list(range(40))
    p = quotes.quoted_passages(spark.createDataFrame([(1, 0, "u", "> A  b\n> c\n>> deep\nown\n> last")], SCHEMA).withColumnRenamed("conv_id", "conv"))
    assert sorted((x.first_line, x.level, x.n_lines, x.norm) for x in p.collect()) == [(0, 1, 2, "a b c"), (2, 2, 1, "deep"), (4, 1, 1, "last")]
    assert quotes.conversations(df.limit(0)).collect() == []
