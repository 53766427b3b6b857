import random
import re
from collections import Counter, defaultdict

from lorekeep.llm import common
from lorekeep.llm import line_templates as lt


def masked(line):
    return re.sub(lt.VARIABLE, "<*>", line)


def brute(rows, least=4, depth=3, min_tokens=3, min_chars=12, max_leaf=64, share=0.95, constant=0.5):
    """Positions to drop of each (id, text), by plain counting."""
    lines = []
    for key, text in rows:
        own = [x.strip(" ") for x in (text or "").split("\n")]
        for k, line in enumerate(own):
            before, after = (own[k - 1] if k else None), (own[k + 1] if k + 1 < len(own) else None)
            before, after = (before if before is not None else after), (after if after is not None else before)
            tokens = masked(line).split(" ")
            if len(tokens) >= min_tokens and len(line) >= min_chars:
                lead = tuple(tokens[:depth])
                lines.append((key, k, tuple(tokens), (len(tokens), lead), masked(line), before, after))

    def recurring(uses):
        sides = defaultdict(lambda: (set(), set()))
        for tpl, before, after in uses:
            sides[tpl][0].add(before)
            sides[tpl][1].add(after)
        return {t for t, (a, b) in sides.items() if len(a - {None}) >= least and len(b - {None}) >= least}

    gone = {(l[0], l[1]) for l in lines if l[4] in recurring([(l[4], l[5], l[6]) for l in lines])}
    leaves = defaultdict(list)
    for l in lines:
        if len(l[2]) <= max_leaf:
            leaves[l[3]].append(l)
    forms = []
    for leaf, own in leaves.items():
        if len(own) < least or len({l[4] for l in own}) < 2:
            continue
        fixed = [(p, w) for p in range(leaf[0]) for w, c in Counter(l[2][p] for l in own).items() if c >= len(own) * share]
        if len(fixed) >= max(leaf[0] * constant, depth + 1):
            forms += [(leaf, l) for l in own if all(l[2][p] == w for p, w in fixed)]
    good = recurring([(leaf, l[5], l[6]) for leaf, l in forms])
    return gone | {(l[0], l[1]) for leaf, l in forms if leaf in good}


def test_lines_equal_brute_force(spark):
    rnd = random.Random(8)

    def sentence():
        return " ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(rnd.randint(1, 9)))

    rows = []
    for i in range(120):
        body = [sentence() for _ in range(rnd.randint(0, 6))]
        for extra in ("Copyright 20%d by Someone Inc." % rnd.randint(10, 30), "Subscribe to our weekly news letter today " + rnd.choice("Ann Bob Cid Dan Eve Flo".split()), "visit http://x.org/%d for more stuff" % i, "short one"):
            if rnd.random() < 0.2:
                body.insert(rnd.randint(0, len(body)), extra)
        rows.append((i, "\n".join(body)))
    rows += [(200 + i, "A whole copied document line one\nits second line is here too\nand a third line of it") for i in range(30)]
    rows += [(300 + i, "A single line document copied often") for i in range(30)]
    rows += [(400, None), (401, ""), (402, "\n\n"), (None, "no id here at all\nCopyright 2001 by Someone Inc."), (403, "word " * 5000)]
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in rows] + [(0, rows[0][1], 5, "k")], "doc_id long, text string, n_dropped int, `id` string")
    gone = brute([*rows, rows[0]])
    want = []
    for i, t in [*rows, rows[0]]:
        own = (t or "").split("\n")
        keep = [x for k, x in enumerate(own) if (i, k) not in gone]
        want.append((str(i), None if t is None else "\n".join(keep), "k", 0 if t is None else len(own), len(own) - len(keep)))
    got = [(str(r["doc_id"]), r["text"], r["id"], r["n_lines"], r["n_dropped"]) for r in lt.drop_recurring_lines(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any("Copyright" in t for _, t in rows if t) and not any("Copyright" in (r[1] or "") for r in got)
    assert any("Subscribe" in t for _, t in rows if t) and not any("Subscribe" in (r[1] or "") for r in got)
    assert sum("copied" in (r[1] or "") for r in got) == 60
    assert lt.drop_recurring_lines(df.limit(0)).count() == 0


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_blocks_and_lines_between_blank_ones_go_but_copies_stay(spark):
    rnd = random.Random(9)
    block = ["First line of the boilerplate block", "its second line follows at once", "and the third one ends it"]
    rows = [(i, "\n\n".join([words(rnd, 12), *block, words(rnd, 12)])) for i in range(8)]
    body = [words(rnd, 12) for _ in range(12)]
    for i in range(10):  # copies with a line changed each
        rows.append((100 + i, "\n".join(body[:i] + [words(rnd, 12)] + body[i + 1 :])))
    got = {r["doc_id"]: r["text"] for r in lt.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = [x for x in text.split("\n") if x not in block]
        assert got[i].split("\n") == want


def test_a_leaf_may_hold_several_templates(spark):
    rnd = random.Random(10)
    tail = " ".join(f"w{c}" for c in "abcdefghijklmnopqrst")
    forms = ["you are reading the daily paper of " + tail, "you are reading some other sheet by " + tail[::-1]]
    rows = []
    for i in range(24):
        rows.append((i, "\n".join([words(rnd, 9), f"{forms[i % 2]} {words(rnd, 1)}", words(rnd, 9)])))
    n = len(forms[0].split(" ")) + 1
    plain = ["you are reading " + words(rnd, n - 3) for _ in range(6)]
    rows += [(50 + i, "\n".join([words(rnd, 9), x, words(rnd, 9)])) for i, x in enumerate(plain)]
    rows += [(1000 + i, rows[0][1]) for i in range(600)]  # one text copied often
    got = {r["doc_id"]: r["text"] for r in lt.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i].split("\n") == [x for x in text.split("\n") if not x.startswith(tuple(forms))]


def test_tables_that_nothing_reads_again_go_before_the_texts_are_joined(spark, monkeypatch):
    rnd = random.Random(11)
    often = "Read more of this on our front page"
    rows = [(i, "\n".join([words(rnd, 9), often, words(rnd, 9)])) for i in range(8)]
    made = []

    def settle(df, label):
        made.append((label, common.settle(df, label)))
        return made[-1][1]

    monkeypatch.setattr(lt, "settle", settle)
    out = lt.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(made[0][1]._settled).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert {"lines", "in-leaf", "around"} < {label for label, _ in made}
    assert [label for label, df in made if files.exists(path(df._settled))] == ["dropped"]
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(i, t.replace(often + "\n", "")) for i, t in rows}
