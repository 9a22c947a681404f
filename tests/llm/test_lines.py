import random

from tests.llm.helpers import ODD, docs, odd_docs

from quern.llm.line_dedup import BLANKS, Spread, drop_boilerplate


def brute(rows, spread):
    sites, first = {}, {}
    for i, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            k = line.strip(BLANKS)
            if len(k) >= spread.min_chars:
                sites.setdefault(k, set()).add(site or "")
                first[k] = min(first.get(k, i), i)
    bad = {k for k, s in sites.items() if len(s) >= spread.min_sites}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if x.strip(BLANKS) not in bad or first[x.strip(BLANKS)] == i) for i, t, _ in rows}


def test_equals_brute_force(spark):
    rng = random.Random(1)
    common = [f"common line number {k} of the sites" for k in range(30)] + ["short", "", "  common line number 3 of the sites\t"]
    rows = [(i, None if i == 7 else "\n".join(rng.choices(common[: 5 + i % 29], k=rng.randint(0, 6)) + [f"own line of document {i} and no other"]), rng.choice([None, *[f"s{k}" for k in range(12)]])) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for spread in (Spread(), Spread(min_sites=11, lg_k=4, band=0.9), Spread(min_sites=13)):
        got = {r.doc_id: r.text for r in drop_boilerplate(frame, spread).collect()}
        assert got == brute(rows, spread)
    n = {r.doc_id: (r.n_lines, r.n_removed) for r in drop_boilerplate(frame, counts=True).collect()}
    assert n[7] == (0, 0) and sum(x for _, x in n.values()) > 100


def test_no_python_in_the_plan(spark):
    frame = drop_boilerplate(docs(spark, ["one line that is long enough"] * 3))
    assert "Python" not in frame._jdf.queryExecution().toString() and "Pandas" not in frame._jdf.queryExecution().toString()


def test_odd_rows(spark):
    frame = odd_docs(spark)
    got = drop_boilerplate(frame)
    assert got.columns == frame.columns and got.count() == len(ODD) + 2
    assert drop_boilerplate(docs(spark, [])).count() == 0
    same = {r.doc_id: r.text for r in got.collect() if r.doc_id is not None}
    assert same == dict(enumerate(ODD))


def test_query_equals_its_sql(spark):
    import duckdb

    from quern.llm import queries

    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(duckdb.sql(queries.oracle_sql()["op4_line_dedup"]).fetchall())
    got = sorted(tuple(r) for r in queries.op4_line_dedup(spark, folder).select("doc_id", "n_lines", "n_removed", "clean_text").collect())
    assert got == want and sum(r[2] for r in got) > 0
