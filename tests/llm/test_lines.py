import hashlib

import duckdb

from tallyforge.llm import lines
from tallyforge.llm.queries import OP7


def brute(rows, least):
    sites, first = {}, {}
    key = lambda line: line.strip(" \t\r")
    for doc, text, _, source in rows:
        for line in (text.split("\n") if text is not None else []):
            if key(line):
                sites.setdefault(key(line), set()).add(source)
                home = -1 if doc is None else doc
                first[key(line)] = min(first.get(key(line), home), home)
    out = []
    for doc, text, _, source in rows:
        own = text.split("\n") if text is not None else []
        kept = [x for x in own if not (key(x) and len(sites[key(x)]) >= least and first[key(x)] != (-1 if doc is None else doc))]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept) if text is not None else None))
    return sorted(out, key=repr)


def run(docs, least):
    got = lines.remove_boilerplate(docs, least).collect()
    return sorted(((r["doc_id"], r["_tf_lines"], r["_tf_removed"], r["text"]) for r in got), key=repr)


def rows():
    out = []
    for i in range(60):
        parts = [f"own {i}", "everywhere", f"half {i % 2}", "", f"site {i % 15}", " everywhere\t" if i % 3 else "x"]
        out.append((i, "\n".join(parts), "en", f"s{i % 15}"))
    out += [(100, None, "en", "s0"), (101, "", "en", None), (None, "everywhere\nnull id", "en", None), (5, "twice\ntwice", "en", "s1"), (5, "twice\ntwice", "en", "s2")]
    out += [(200, "everywhere\n" * 20_000 + "end", "en", "s3"), (201, "\n\n", "en", "s4")]
    return out


def test_against_brute_force(docs_of):
    some = rows()
    for least in (2, 8, 15, 17):
        assert run(docs_of(some), least) == brute(some, least)


def test_twin_on_fixture(docs_of):
    some = rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [list(r) for r in some])
    theirs = sorted(con.execute(OP7).fetchall(), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert theirs == sorted(((*r[:3], sha(r[3])) for r in brute(some, lines.MIN_SITES)), key=repr)


def test_native_plan_and_clashing_columns(spark, docs_of):
    assert run(docs_of([]), 2) == []
    docs = spark.createDataFrame([(1, "a", "s", 3)], "doc_id bigint, text string, source string, sites int")
    plan = lines.remove_boilerplate(docs)
    assert plan.columns[:4] == docs.columns
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
