import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import simhash
from eventloom.llm.components import components, forest


def slow_fingerprint(text, words=3):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@given(st.text(max_size=200))
def test_fingerprint_by_definition(text):
    text = text.encode("utf-8", "ignore").decode()
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def brute_classes(values, k):
    values = np.unique(np.array(values, np.uint64))
    root = {int(v): int(v) for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v in enumerate(values):
        for w in values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ v) <= k]:
            a, b = find(int(v)), find(int(w))
            root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


def classes(spark, values, k):
    df = spark.createDataFrame([(int(np.int64(np.uint64(v))), int(np.int64(np.uint64(v)))) for v in set(values)], "fp long, node long")
    edges = [(r.u, r.v) for r in simhash.links(df, k).collect()]
    if not edges:
        return {v: v for v in values}
    root = {}
    nodes, roots = forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    root = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    return {v: root.get(int(np.int64(np.uint64(v))), int(np.int64(np.uint64(v)))) for v in values}


def same_partition(a, b):
    return len({(a[v], b[v]) for v in a}) == len(set(a.values())) == len(set(b.values()))


def near_values(seed, n, flips):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 2**64, 8, dtype=np.uint64)]
    out = []
    for _ in range(n):
        v = base[rng.integers(8)]
        for b in rng.choice(64, rng.integers(flips + 1), replace=False):
            v ^= 1 << int(b)
        out.append(v)
    return out


def test_links_lose_none(spark):
    values = near_values(1, 300, 5)
    for k in (3, 7):
        assert same_partition(classes(spark, values, k), brute_classes(values, k))


def test_crowded_buckets_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 16)
    values = near_values(2, 250, 4)
    assert same_partition(classes(spark, values, 3), brute_classes(values, 3))


def test_allocation_covers_the_distance():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    for k in (3, 7):
        for n in (100, 10**6, 10**9):
            plan = simhash.allocate(n, bits.T @ bits * n / 500, k)
            assert sum(t + 1 for _, t in plan) == k + 1
            groups = [b for g, _ in plan for b in g]
            assert len(groups) == len(set(groups))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, edges):
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    expected = {}
    for _ in range(14):
        for a, b in edges:
            low = min(expected.get(a, a), expected.get(b, b))
            expected[a] = expected[b] = low
    assert found == {v: r for v, r in expected.items() if v != r}


def test_hard_cases(hard, none):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    prints = [slow_fingerprint(t) for _, t in rows]
    root = brute_classes(prints, 3)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    expected = sorted([(i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints, strict=True)], key=repr)
    clash = hard.withColumn("fp", F.lit("x")).withColumn("first", F.lit(0))
    assert sorted([tuple(r) for r in simhash.near_duplicates(clash).collect()], key=repr) == expected
    assert simhash.near_duplicates(none).count() == 0


def test_similar_documents_link_light_edits_only(make):
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    edited = list(words)
    edited[100], edited[300] = "changed", "again"
    other = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    half = words[:200] + other[200:]
    df = make([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(other)), (4, " ".join(half)), (5, " ".join(words)), (6, None), (7, "")])
    assert {r.doc_id: r.class_id for r in simhash.similar_documents(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6, 7: 6}
    assert sorted(r.doc_id for r in simhash.drop_similar(df).collect()) == [1, 3, 4, 6]


def made_and_exact(make, rows):
    """Classes of documents as made, and by brute force over exact shingle sets at 0.8."""
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return {r.doc_id: r.class_id for r in simhash.similar_documents(make(rows)).collect()}, root


def changed(words, every):
    return " ".join("other" if k % every == every // 2 else w for k, w in enumerate(words))


def test_linked_documents_have_the_exact_similarity(make, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for group in range(12):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        rows += [(10 * group, " ".join(words)), *((10 * group + k, changed(words, every)) for k, every in enumerate((25, 30, 35, 40, 60, 100), 1))]
    found, expected = made_and_exact(make, rows)
    assert found == expected and len(set(expected.values())) > 12
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 2)
    assert made_and_exact(make, rows)[0] == expected


def test_exact_links_are_complete():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 12, 9)).astype(np.uint64) for _ in range(60)]
    near = [(i, j) for i in range(60) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    for edges in (simhash.exact_links(sets, 0.8), near):
        nodes, roots = forest(*np.array(edges).T)
        assert dict(zip(nodes, roots, strict=True)) == dict(zip(*forest(*np.array(near).T), strict=True))


def test_appended_and_truncated_copies_are_found(make):
    rng = np.random.default_rng(7)
    rows = []
    for group in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 200 + 10 * group)]
        n = len(words)
        rows += [(10 * group, " ".join(words)), (10 * group + 1, " ".join(words[: n * 85 // 100]))]
        rows += [(10 * group + k, " ".join([*words, *(f"v{x}" for x in rng.integers(0, 10**6, n * share // 100))])) for k, share in ((2, 10), (3, 20))]
    found, expected = made_and_exact(make, rows)
    assert found == expected and len(set(expected.values())) == 40


def test_near_fingerprints_are_candidates(make):
    """SimHash and bands each find candidates; what is linked is decided by the exact similarity."""
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["other"])), (3, " ".join(f"v{i}" for i in range(400)))]
    found = {r.doc_id: r.class_id for r in simhash.similar_documents(make(rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    sets = [simhash.shingle_set(t.encode(), 5) for _, t in rows]
    assert bin(simhash.set_fingerprint(sets[0]) ^ simhash.set_fingerprint(sets[1])).count("1") <= 3
    assert simhash.set_fingerprint(np.array([2**63, 1], np.uint64)) == 0 and simhash.set_fingerprint(np.array([2**63 + 1], np.uint64)) == 2**63 + 1
