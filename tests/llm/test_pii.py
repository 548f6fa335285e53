import hashlib
import random
import re

from wayfold.llm.pii import PiiParams, mentions, personal_data, pii_digest, scanned

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute_spans(t):
    t = t or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def brute(t):
    names, out = ["email", "ip", "card", "phone"], brute_spans(t)
    s = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in out)
    return [sum(k == i for _, k, _ in out) for i in range(4)] + [hashlib.sha256(s.encode()).hexdigest()]


def brute_mentions(t):
    """(pattern, start, end, instance, seed), by walking over the words."""
    spans, left, out = brute_spans(t), [], []
    for w in re.finditer(r"[^\x20\x09-\x0D]+", t or ""):
        a, b, word = w.start(), w.end(), w[0]
        if not re.search("[0-9@]", word):
            left.append(word.lower())
            continue
        for s, _, e in spans:
            if a <= s < b:
                before = t[a:s]
                own = ["#" if re.search("[0-9@]", before) else before.lower()] if re.search(r"[A-Za-z0-9@]|[^\x00-\x7F]", before) else []
                out.append((tuple((left + own)[-2:]), s, e, t[s:e].lower(), 1))
        bare = re.sub(r"[.,;:!?)\]\"']+$", "", word)
        if (len(re.sub("[^0-9]", "", word)) >= 3 or "@" in word) and not any(s < a + len(bare) and e > a for s, _, e in spans):
            out.append((tuple(left[-2:]), a, a + len(bare), bare.lower(), 0))
        left.append("#")
    return [(" ".join(p), s, e, i, k) for p, s, e, i, k in out if p and s < e]


def brute_discovered(texts, p):
    seed = {}
    for t in texts:
        for pattern, _, _, i, k in brute_mentions(t):
            seed[pattern, i] = max(k, seed.get((pattern, i), 0))
    of = {}
    for (pattern, i), k in seed.items():
        of.setdefault(pattern, []).append((i, k))
    score = {q: sum(k for _, k in x) / len(x) for q, x in of.items()}
    support = {q: sum(k for _, k in x) for q, x in of.items()}
    for _ in range(p.rounds - 1):
        doubt = {}
        for (q, i), k in seed.items():
            if not k:
                doubt[i] = doubt.get(i, 1.0) * max(1 - score[q] * support[q] / (support[q] + 1), 1e-9)
        score = {q: sum(1.0 if k else 1 - doubt[i] for i, k in x) / len(x) for q, x in of.items()}
    good = {q for q in of if score[q] >= p.confidence and support[q] >= p.support}
    return {t: sorted((s, e) for q, s, e, _, k in brute_mentions(t) if not k and q in good) for t in texts}


def test_discovery_same_as_brute_force(spark):
    r, p = random.Random(11), PiiParams()
    lead = ["mail me:", "call", "Kunde Nr.", "id", "ref (é", "about", "server at", "x,"]
    ids = [lambda: f"u{r.randrange(99)}@m{r.randrange(9)}.org", lambda: f"10.0.{r.randrange(300)}.7", lambda: f"+49 ({r.randrange(100, 999)}) 555-{r.randrange(9999):04d}", lambda: f"AB-{r.randrange(99999)}.", lambda: str(r.randrange(10**r.randint(1, 6)))]
    likely = {k: r.choice(ids) for k in lead}
    texts = [" ".join(x for _ in range(r.randint(0, 8)) for k in [r.choice(lead)] for x in (k, (likely[k] if r.random() < 0.8 else r.choice(ids))(), r.choice(["and", "", "\n", "then 5"]))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_discovered(texts, p)
    got = {x.doc_id: [(s.start, s.end) for s in x.spans if s.kind == 4] for x in personal_data(df).collect()}
    assert got == {i: want[t] for i, t in enumerate(texts)} and sum(map(len, got.values())) > 20


def test_base_same_as_brute_force(spark):
    r = random.Random(2)
    bits = ["a.b", "@", "ex-1.com", ".", "c_d", "1.2.3.4", "0255.10.256.1", "12", "4111 1111 1111 1111", "4111-1111", "+1 (456) 555-2186", "+49", "(", ")", "-", " ", "é🙂", "\n", "x", "%", "7", "00012345678901"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(500)]
    rows += [(1000, None), (1001, ""), (1002, "7 " * 60_000 + "@" * 5 + "a" * 60_000), (1003, "1." * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: [x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256] for x in pii_digest(df).collect()}
    assert got == {d: brute(t) for d, t in rows}


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"Please contact me at user{i}@mail{i}.example.com today") for i in range(6)]
    rows += [(10, "é Please contact me at XK-99812-77. thanks"), (11, "there were about 5512 people"), (11, "there were about 5512 people"), (12, None), (None, "contact me at QQ-1234567")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as spans", "3 as pattern")
    got = {(x.doc_id, x.n_email): x.spans for x in pii_digest(df, PiiParams()).collect()}
    assert got[10, 0] == "context:23:34" and got[None, 0] == "context:14:24" and got[11, 0] == "" and got[0, 1].startswith("email:21:")
    full = personal_data(df).collect()
    assert len(full) == len(rows) and pii_digest(df.limit(0)).count() == 0


def test_contexts_across_numbers(spark):
    rows = [(i, f"My phone number is +1 (017) 555-77{i:02d} or 12 Main") for i in range(6)] + [(10, "the phone number is 99-1122 now")]
    rows += [(20 + i, f"mail: u{i}@x{i}.org, mail: v{i}@y{i}.org") for i in range(6)] + [(30, "mail: AB-1234, mail: CD-5678")]
    long = "w" * 150
    rows += [(40 + i, f"{long} {long}: z{i}@q{i}.org") for i in range(4)] + [(50, f"{long} {long}: ZZ-9876")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rows_of = scanned(df, PiiParams(), keep=False)
    found = {(r.doc_id, r.start): (r.pattern, r.end, r.instance, r.seed) for r in mentions(rows_of).join(rows_of.select("_row", "doc.doc_id"), "_row").collect()}
    assert found[0, 19] == ("number is", 36, "+1 (017) 555-7700", 1)
    assert found[30, 6] == ("mail:", 13, "ab-1234", 0) and found[30, 21] == ("# mail:", 28, "cd-5678", 0)
    got = {x.doc_id: x.spans for x in pii_digest(df).collect()}
    assert got[10] == "context:20:27" and got[30] == "context:6:13,context:21:28" and got[50] == "context:303:310"
