import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import exact_dedup as ed


@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 5), max_size=40), min_size=1, max_size=5))
def test_filters_merge_losslessly(parts):
    filters = [ed.CountingQuotientFilter.build(np.array(p, np.uint64)) for p in parts]
    merged = ed.CountingQuotientFilter.merge([ed.CountingQuotientFilter.from_bytes(f.to_bytes()) for f in filters])
    every = np.array([x for p in parts for x in p], np.uint64)
    values, counts = np.unique(every, return_counts=True)
    assert merged.fingerprints().tolist() == values.tolist()
    assert merged.counts.tolist() == counts.tolist()
    assert all(merged.count(int(v)) == c for v, c in zip(values, counts, strict=True))
    assert merged.count(77) == (every == 77).sum()


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm, strict=True):
        groups.setdefault(n, []).append(i)
    keep = {n: min((i for i in g if i is not None), default=None) for n, g in groups.items()}
    return sorted([(i, keep[n], len(groups[n]), i == keep[n]) for (i, _), n in zip(rows, norm, strict=True)], key=repr)


def test_hard_cases(hard, none):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    found = sorted([tuple(r)[:4] for r in ed.exact_groups(hard).collect()], key=repr)
    assert found == brute(rows)
    assert ed.exact_groups(none).count() == 0


def test_clashing_columns_pass(hard):
    clash = hard.withColumn("fp", F.lit(1)).withColumn("body", F.lit("x")).withColumn("keep_id", F.lit(0))
    assert ed.exact_groups(clash).count() == hard.count()
    assert set(ed.drop_exact_copies(clash).columns) == set(clash.columns)


def test_what_stays(make):
    rows = [(None, "only without id"), (None, "a  b"), (2, "a b"), (2, "other"), (1, "other"), (3, None), (4, "")]
    kept = sorted(((r.doc_id, r.text) for r in ed.drop_exact_copies(make(rows)).collect()), key=repr)
    assert kept == sorted([(None, "only without id"), (2, "a b"), (1, "other"), (3, None)], key=repr)
