import time
from dataclasses import replace

from wayfold.llm import quality as quality_module
from wayfold.llm.quality import QualityParams, base_rules, clean, common_lines, quality, quality_digest, rated_rows

P = QualityParams(least_docs=2, min_words=4)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, n_chars long")


def test_base_columns(spark):
    rows = [(1, "a b c a b c x #é\nx\n x\nx", "s", "", 0), (2, None, "s", "", 0), (3, "", None, "", 0), (4, " \n\t", "s", "", 0), (5, "q q q q q", "s", "", 0)]
    got = {r.doc_id: r for r in quality_digest(docs(spark, rows)).collect()}
    r = got[1]
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (11, 12, 1, 1, 6)
    assert all(got[i].n_words == 0 and got[i].base_failed and not got[i].kept for i in (2, 3, 4))
    assert got[5].n_repeat_words == 5 and got[5].base_failed


def test_common_lines_per_host(spark):
    own = lambda i: f"line {i} has its own words here\nand another one {i}"
    rows = [(i, f"Read  MORE here\n{own(i)}", "h1", "", 0) for i in range(5)]
    rows += [(10 + i, f"read more here\n{own(10 + i)}", "h2", "", 0) for i in range(2)]
    rows += [(20 + i, "same copy of one text\nwith a second line", "h1", "", 0) for i in range(6)]
    rows += [(30, "read more here\nread more here\nread more here\nx y", "h1", "", 0), (31, "read more here", None, "", 0)]
    df = docs(spark, rows)
    assert [r.host for r in common_lines(rated_rows(df, P, keep=False), P).collect()] == ["h1"]
    got = {r.doc_id: r for r in quality(df, P).collect()}
    assert got[0].n_common_words == 3 and got[0].kept and got[10].n_common_words == 0 and got[20].kept
    assert got[30].n_common_words == 9 and not got[30].kept
    texts = {r.doc_id: (r.text, r.n_chars) for r in clean(df, P).collect()}
    assert texts[0] == (own(0), len(own(0))) and texts[10][0].startswith("read more") and 30 not in texts
    assert clean(df, P).columns == df.columns and clean(df.limit(0), P).count() == 0


def test_repeated_rows(spark):
    rows = [(1, "a b c d e", "s", "", 0)] * 3 + [(None, "a b c d e", "s", "", 0)]
    assert [r.kept for r in quality_digest(docs(spark, rows), P).collect()] == [True] * 4


def test_distinct_documents_that_share_other_lines(spark):
    # one template of many lines and one own line: few values of any other line, but 40 documents
    template = "\n".join(f"template line number {j}" for j in range(60))
    rows = [(i, f"{template}\nown words of document {i}", "h", "", 0) for i in range(40)]
    rows += [(100 + i, "copied line of all\nsecond copied line", "h", "", 0) for i in range(40)]
    df = docs(spark, rows)
    got = {r.doc_id: (r.n_common_words, r.kept) for r in quality(df, QualityParams(min_words=4)).collect()}
    assert all(got[i] == (240, False) for i in range(40)) and all(got[100 + i] == (0, True) for i in range(40))


def test_header_and_footer_of_a_site(spark):
    # two lines that all documents share do not hide each other
    rows = [(i, f"the header line of the site\nown words of document number {i} and {i * 7}\nthe footer line", "h", "", 0) for i in range(1000)]
    df = docs(spark, rows)
    assert common_lines(rated_rows(df, QualityParams(), keep=False)).count() == 2
    got = clean(df, QualityParams(min_words=4)).collect()
    assert len(got) == 1000 and all(r.text == f"own words of document number {r.doc_id} and {r.doc_id * 7}" for r in got)


def test_a_filter_on_a_long_text_ends(spark):
    long = " ".join(f"w{i % 900} v{i}" for i in range(10_000))
    df = docs(spark, [(1, long, "s", "", 0), (2, long + " " + long, "s", "", 0), (3, " ".join(f"u{i}" for i in range(60)), "s", "", 0)])
    began = time.time()
    assert sorted(r.doc_id for r in base_rules(df).filter("not base_failed").collect()) == [1, 3]
    assert sorted(r.doc_id for r in clean(df).collect()) == [1, 3]
    assert time.time() - began < 60


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e", "s", 1, 2, 3, 4)], "doc_id long, text string, source string, _row int, host int, lines int, copy int")
    assert clean(df, P).collect() == df.collect()
    assert set(df.columns) < set(quality(df, P).columns)


def test_clean_writes_no_texts(spark, monkeypatch):
    rows = [(i, f"the header line of the site\nown words of document number {i % 50}\nthe footer line" + "\nagain and again" * (i % 3), f"h{i % 2}", "", 0) for i in range(200)]
    df = docs(spark, [*rows, (300, None, "h0", "", 0), (301, "a line of no host\nthe header line of the site", None, "", 0)])
    written, write = [], quality_module.materialize
    monkeypatch.setattr(quality_module, "materialize", lambda df, name: (written.append((name, df.columns)), write(df, name))[1])
    p = QualityParams(min_words=4, depleted_percent=60)
    one = sorted(map(str, clean(df, p).collect()))
    assert written == [("common", ["host", "line"])]  # before, a table with the texts
    assert one == sorted(map(str, clean(df, replace(p, broadcast_lines=0)).collect())) and 0 < len(one) < 202
