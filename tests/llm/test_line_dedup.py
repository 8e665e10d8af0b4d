import re

import pytest
from pyspark.sql import functions as F

from eventloom.llm import line_dedup, queries
from tests.oracle import duck, spark_rows


def brute(rows, size):
    key = lambda i: (i is None, i or 0)
    full = {k: [(n, x) for n, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] for k, (i, t) in enumerate(rows)}
    first = {}
    for k, (i, _) in enumerate(rows):
        for s in range(len(full[k]) - size + 1):
            w = tuple(x for _, x in full[k][s : s + size])
            first[w] = min(first.get(w, (key(i), s)), (key(i), s))
    out = []
    for k, (i, t) in enumerate(rows):
        gone = set()
        for s in range(len(full[k]) - size + 1):
            if first[tuple(x for _, x in full[k][s : s + size])] < (key(i), s):
                gone.update(n for n, _ in full[k][s : s + size])
        lines = (t or "").split("\n")
        out.append((i, len(lines), len(gone), None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in gone)))
    return sorted(out, key=repr)


def found(df, size):
    return sorted([tuple(r) for r in line_dedup.drop_repeated_lines(df, size).select("doc_id", "n_lines", "n_removed", "kept_text").collect()], key=repr)


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_by_definition(make, size):
    rows = [(i, "\n".join(f"line {(i * 7 + k * (1 + i % 3)) % 11}" if k % 6 != 5 else " " for k in range(i % 14))) for i in range(40)]
    assert found(make(rows), size) == brute(rows, size)


def test_hard_cases(hard, none):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    clash = hard.withColumn("n_removed", F.lit("x")).withColumn("__runs", F.lit(1)).withColumn("pos", F.lit(2))
    assert found(clash, 3) == brute(rows, 3)
    assert found(none, 3) == []


def test_texts_of_very_many_lines(make):
    """Time grows with the number of lines, not with its square."""
    n = 200_000
    lines = [f"line {i}" for i in range(n)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(x for i in range(0, n, 4) for x in [*lines[i : i + 3], f"own {i}", ""]))]
    out = {r.doc_id: r for r in line_dedup.drop_repeated_lines(make(rows), 3).collect()}
    assert out[1].n_removed == 0 and out[1].kept_text == rows[0][1]
    assert out[2].n_removed == 3 * (n // 4) and out[2].kept_text == "\n".join(x for i in range(0, n, 4) for x in [f"own {i}", ""])


def test_hot_ranks_are_joined_like_others(make, monkeypatch):
    from eventloom.llm import ranks

    monkeypatch.setattr(ranks, "LEAST_HOT", 2)
    rows = [(i, "\n".join(f"line {(i * 7 + k * (1 + i % 3)) % 11}" for k in range(i % 14))) for i in range(40)]
    assert found(make(rows), 2) == brute(rows, 2)


def test_query_matches_its_sql(spark, data):
    columns, rows = duck(data, queries.LINE_DEDUP_SQL)
    assert spark_rows(queries.op4_line_dedup(spark, data)) == rows


def test_exact_dedup_query_matches_its_sql(spark, data):
    columns, rows = duck(data, queries.EXACT_DEDUP_SQL)
    assert spark_rows(queries.op3_exact_dedup(spark, data)) == rows
