import random
import re

from wayfold.llm.decontam import DecontamParams, contamination, contamination_digest, decontaminate, items_digest, mask_spans

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, n=13):
    windows = {}
    for k, t in items:
        w = WORD.findall(lowered(t))
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(k))
    out = []
    for d, t in docs:
        w = WORD.findall(lowered(t))
        hit, owners = set(), set()
        for i in range(len(w)):
            for size in {len(x) for x in windows}:
                if i + size <= len(w) and tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    owners |= windows[tuple(w[i : i + size])]
        out.append((d, len(w), len(hit), len(owners), items_digest(list(owners)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_same_as_brute_force(spark):
    r = random.Random(5)
    vocab = ["Ab", "ça", "x9", "THE", "of", "ñ", "Q"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 5, 13, 14, 40])))) for i in range(12)]
    items += [(90, None), (91, "unique-one, two")]
    docs = []
    for i in range(80):
        w = [r.choice([*vocab, f"z{r.randrange(99)}"]) for _ in range(r.choice([0, 1, 12, 50, 400]))]
        if r.random() < 0.5:
            w[len(w) // 2 : len(w) // 2] = (r.choice(items)[1] or "").split()
        docs.append((i, r.choice([" ", ", ", "\n--"]).join(w)))
    docs += [(900, None), (901, ""), (902, "UNIQUE one/TWO!")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, contamination_digest(d, b).collect())) == brute(docs, items)
    # the same by many blocks
    assert sorted(map(tuple, contamination_digest(d, b, DecontamParams(block_bytes=100)).collect())) == brute(docs, items)


def test_edges(spark):
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x a b c y", 7, "en"), (1, "x a b c y", 7, "en"), (2, "q " * 30, 8, "de"), (None, None, 9, None)], "doc_id long, text string, n_hit long, items string")
    assert sorted(r.doc_id or 0 for r in decontaminate(d, b).collect()) == [0, 2]
    assert decontaminate(d, b).columns == d.columns
    assert decontaminate(d, b.limit(0)).count() == 4 and decontaminate(d.limit(0), b).count() == 0
    got = contamination(d, b).filter("doc_id = 1").first()
    assert got.spans == [1, 4] and got.n_hit == 3 and mask_spans("x A, b. c y", got.spans) == "x , .  y"


def test_any_column_names_and_many_blocks(spark):
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 5, 20, 40])))) for i in range(60)]
    docs = [(i, " ".join([r.choice(items)[1], *(r.choice(vocab) for _ in range(r.choice([0, 30])))])) for i in range(40)]
    names = "`earlier` string, `row` int, `a b` array<int>, `items` string, `spans` int, `x.y` double, `t``k` int, doc_id long, text string"
    d = spark.createDataFrame([("e", 1, [2], "i", 3, 0.5, 4, *x) for x in docs], names)
    b = spark.createDataFrame(items, "item_id int, text string")
    one, many = DecontamParams(), DecontamParams(block_bytes=300)  # the items are dealt into over 20 blocks
    shown = lambda p: sorted((x.doc_id, x.n_words, x.spans, x["items"], x.n_hit, x.contaminated, x["a b"], x["x.y"]) for x in contamination(d, b, p).collect())
    assert shown(one) == shown(many) and any(x[5] for x in shown(one))
    left = decontaminate(d, b, many)
    assert left.columns == d.columns and sorted(x.doc_id for x in left.collect()) == [x[0] for x in shown(one) if not x[5]]


def test_very_long_text(spark):
    item = " ".join(f"k{i}" for i in range(20))
    text = "filler words of no item " * 60_000 + item
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id int, text string")
    assert [(x.n_words, x.n_hit, x.spans) for x in contamination(d, b).collect()] == [(300_020, 20, [300_000, 300_020])]
