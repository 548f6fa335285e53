import random

from wayfold.llm.near_dup import prefixes
from wayfold.llm.passages import remove_passages, repeated_passages


def brute(rows, n=50):
    """(doc, start, end) of maximal runs of n-word windows that another document holds."""
    words = {d: (t or "").lower().split() for d, t in rows}
    where = {}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), set()).add(d)
    out = []
    for d, w in words.items():
        hit = [i for i in range(len(w) - n + 1) if len(where[tuple(w[i : i + n])]) > 1]
        while hit:
            s = e = hit.pop(0)
            while hit and hit[0] == e + 1:
                e = hit.pop(0)
            out.append((d, s, e + n))
    return sorted(out)


def test_verbatim_same_as_brute_force(spark):
    r = random.Random(7)
    word = lambda: f"w{r.randrange(4000)}"
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 90, 200)]
    rows = []
    for i in range(60):
        w = text(r.randint(0, 250))
        for _ in range(r.choice([0, 0, 1, 2])):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(shared)
        rows.append((i, r.choice([" ", "\n", "  "]).join(w)))
    rows += [(70, "a " * 120), (71, "b c " * 5 + "a " * 70), (72, None), (73, ""), (74, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as keys", "'z' as kept")
    got = repeated_passages(df).collect()
    assert sorted((x.doc_id, x.start_word, x.end_word) for x in got if x.kind == "passage") == brute(rows)
    assert all(x.kept_doc_id <= x.doc_id and x.component_id <= x.kept_doc_id for x in got)


def test_near_paragraphs_and_edges(spark):
    w = [f"t{i}" for i in range(120)]
    v = list(w)
    v[20] = v[60] = v[100] = "x"  # no 50 equal words in a row, Jaccard 101 / 131 is under 0.8
    u = list(w)
    u[49] = u[99] = "x"  # 106 / 126 is over 0.8
    rows = [(1, "intro line\n" + " ".join(w)), (2, " ".join(u) + "\nend"), (3, " ".join(v)), (4, "short text"), (4, "short text"), (None, " ".join(w))]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.start_word, x.end_word, x.kept) for x in got if x.kind == "paragraph") == [(1, 2, 122, True), (2, 0, 120, False)]
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert remove_passages("a b  c\nd", [(1, 3)]) == "a\nd" and remove_passages(None, [(0, 1)]) is None


def test_repeated_sets_have_the_same_prefixes(spark):
    sets = [((i, 0), list(range(i, i + 20))) for i in range(4)]
    df = spark.createDataFrame(sets, "id struct<doc:bigint,line:bigint>, items array<long>")
    again = df.union(df.filter("id.doc < 2"))
    once, twice = (sorted(map(str, prefixes(x, 85).collect())) for x in (df, again))
    assert once == twice and once
