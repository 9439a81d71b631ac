from collections import defaultdict

import pytest

from barwise.llm.lines import OP4_SQL, drop_frequent_lines, op4_line_dedup
from conftest import SF_SMALL
from llm_helpers import docs_of
from oracle_check import compare

WS = " \t\n\x0b\x0c\r"


def brute(rows, min_docs, min_chars=1):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                docs[low(line.strip(WS))].add(i)
    bad = {k for k, v in docs.items() if len(v) >= min_docs and len(k) >= min_chars}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if low(x.strip(WS)) not in bad]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (3, 1), (2, 3)])
def test_edge_cases(spark, min_docs, min_chars):
    rows = [(1, "a\n B\t\nkeep é"), (2, "A\nb\n\n"), (3, None), (4, ""), (5, "keep É\na"), (5, "a\nnew"),
            (5, "a\nnew"), (None, "b\na\nzz"), (None, "zz"), (6, "x " * 40000 + "\nABC"), (7, "abc \x0b")]
    got = drop_frequent_lines(docs_of(spark, rows), min_docs, min_chars).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str) == brute(rows, min_docs, min_chars)


def test_empty_and_clashing_columns(spark):
    assert drop_frequent_lines(docs_of(spark, [])).count() == 0
    df = docs_of(spark, [(1, "a\nb", 7, "k"), (2, "a", 8, None)], "doc_id long, text string, n_lines int, key string")
    got = drop_frequent_lines(df, min_docs=2).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_dropped, r.key) for r in got] == [("b", 2, 1, "k"), ("", 1, 1, None)]


def test_matches_sql(spark, duck_small):
    res = compare(op4_line_dedup(spark, SF_SMALL), OP4_SQL, duck_small)
    assert res["ok"], res["problems"]




def test_clashing_names_and_rows_without_id(spark):
    rows = [(i, f"own {i}\nshared", 1, "a", 2) for i in range(12)] + [(None, f"x{i}\nSHARED ", 1, "b", 2) for i in range(3)] * 2 + [(None, None, 1, "c", 2)]
    df = docs_of(spark, rows, "doc_id long, text string, __r int, __lost string, n_lines int")
    got = sorted(((r.doc_id, r.text, r["__r"], r["__lost"], r.n_lines, r.n_dropped) for r in drop_frequent_lines(df).collect()), key=str)
    assert got == sorted([(i, f"own {i}", 1, "a", 2, 1) for i in range(12)] + [(None, f"x{i}", 1, "b", 2, 1) for i in range(3)] * 2
                         + [(None, "", 1, "c", 1, 0)], key=str)
