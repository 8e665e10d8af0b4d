import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from eventloom.llm import repeats, substring_dedup, suffix_dedup


def brute_words(rows, size):
    out = []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    first = {}
    for k in order:
        i, t = rows[k]
        w = (t or "").encode().split()
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            place = (i is None, i or 0, s)
            first[key] = min(first.get(key, place), place)
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (i is None, i or 0, s):
                gone[s : s + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows, size):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[s : s + size] for s in range(len(b) - size + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if count[b[s : s + size]] > 1:
                gone[s : s + size] = b"\x01" * size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def words_found(df, size, **options):
    cut = substring_dedup.drop_repeated_phrases(df, words=size, **options)
    return sorted([tuple(r) for r in cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256)).collect()], key=repr)


def bytes_found(df, size, **options):
    cut = suffix_dedup.drop_repeated_bytes(df, size=size, **options)
    return sorted([tuple(r) for r in cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256)).collect()], key=repr)


def corpus(seed):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("ab cd ef gh ij kl é".split()) for _ in range(rng.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(f"u{rng.randint(0, 9**6)}" for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
        text = " ".join(parts)
        if rng.random() < 0.5 and len(text) > 9:
            k = rng.randrange(len(text))
            text = text[:k] + "X" + text[k + 1 :]
        rows.append((i, text))
    return rows + [(99, "z" * 700), (98, "z" * 650)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_corpora(make, seed):
    rows = corpus(seed)
    df = make(rows)
    assert words_found(df, 8, gram=3, block_bytes=900) == brute_words(rows, 8)
    for most in (1, 1000):
        assert bytes_found(df, 40, gram=8, block_bytes=900, most_contents=most) == brute_bytes(rows, 40)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 9, 403])
def test_other_sizes(make, size):
    rows = corpus(4)[:12] + [(99, "z" * 700), (98, "z" * 650)]
    assert bytes_found(make(rows), size, block_bytes=900) == brute_bytes(rows, size)
    if size < 10:
        assert words_found(make(rows), size, gram=3, block_bytes=900) == brute_words(rows, size)


def test_words_that_collide_modulo_a_power_of_two_are_different(make):
    """Two words of 1,024 letters after the Thue-Morse sequence: polynomial hashes modulo 2 ** 64 are equal."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    shared = " ".join(f"w{i}" for i in range(19))
    rows = [(1, shared + " " + "".join("ab"[b] for b in bits)), (2, shared + " " + "".join("ba"[b] for b in bits))]
    found = words_found(make(rows), 20)
    assert found == brute_words(rows, 20) and all(r[2] == 0 for r in found)
    rows = [(1, shared), (2, "x " + shared + " y"), (3, shared + " z")]
    assert words_found(make(rows), 19, gram=5) == brute_words(rows, 19)


def test_equal_names_do_not_make_words_equal(make, monkeypatch):
    """Even if every name collides, only equal words are removed."""
    import numpy as np

    from eventloom.llm import textkit as tk

    rows = [(i, " ".join(f"d{i}w{k}" for k in range(30))) for i in range(4)]
    segments = [(i, 0, t.encode()) for i, t in rows] + [(0, 5, b" ".join(rows[3][1].encode().split()[5:20]))]
    monkeypatch.setattr(tk, "all_word_names", lambda texts: [np.ones(len(t.split()), np.uint64) for t in texts])
    reference = substring_dedup.Reference(segments, 8)
    found = reference.candidates(4)
    assert [substring_dedup.factors(reference, d, *found[d]) if d in found else [] for d in range(4)] == [[], [], [], [(5, 20)]]


def test_factors_are_maximal_and_boundaries_are_checked():
    """Document 9 is put together from two earlier ones; a phrase that lies across its two factors stands in a third."""
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    texts = [(1, a + ["x"]), (2, ["y", *b]), (3, a[-3:] + b[:3]), (9, a + b)]
    reference = substring_dedup.Reference([(i, 0, " ".join(t).encode()) for i, t in texts], 6)
    assert substring_dedup.factors(reference, 3, *reference.candidates(4)[3]) == [(0, 12), (9, 15), (12, 24)]


def test_hard_cases(hard, none):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    clash = hard.withColumn("block", F.lit(1)).withColumn("kind", F.lit("k"))
    assert words_found(clash, 20, block_bytes=50_000) == brute_words(rows, 20)
    assert bytes_found(clash, 400, block_bytes=50_000) == brute_bytes(rows, 400)
    assert words_found(none, 20) == [] and bytes_found(none, 400) == []


def test_long_texts_are_searched_in_slices(make, monkeypatch):
    import numpy as np

    rows = corpus(3)
    monkeypatch.setattr(repeats, "SLICE", 16)
    ids, texts = np.arange(len(rows)), [t.encode() for _, t in rows]
    runs = repeats.find_runs(lambda d: suffix_dedup._names(texts[d]), 40, 8, ids)
    windows = sum(max(0, len(t) - 39) for t in texts)
    assert runs.count.sum() == windows and runs.count.max() <= 16


def test_very_long_texts(make):
    """Texts longer than a block, of which one repeats a stretch of the other."""
    rng = random.Random(8)
    long = [f"v{rng.randint(0, 10**7)}" for _ in range(120_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["other"] + long[50_000:90_000] + ["end"])), (3, " ".join(long[:10]))]
    assert words_found(make(rows), 20, block_bytes=100_000) == brute_words(rows, 20)
    cut = {r[0]: r[1:4] for r in bytes_found(make(rows), 400, block_bytes=100_000)}
    shared = len(" " + " ".join(long[50_000:90_000]) + " ")
    assert cut[2][1] in range(shared - 1, shared + 2) and cut[1][1] == cut[2][1] and cut[3][1] == 0


@pytest.mark.parametrize("size", [3, 8, 10, 19])
def test_doubling_finds_shared_suffixes(size):
    import numpy as np

    rng = random.Random(size)
    data = b"abcdefgh" * 3 + b"xyz" + bytes(rng.choice(b"ab") for _ in range(80))
    at = np.arange(0, len(data) - size + 1, 1 if size % 2 else 3)
    expected = [k for k, i in enumerate(at) if sum(data[j : j + size] == data[i : i + size] for j in at) > 1]
    assert sorted(suffix_dedup.doubled(np.frombuffer(data, np.uint8), at, size).tolist()) == expected


def test_names_of_words():
    from eventloom.llm import textkit as tk

    rng = random.Random(5)
    texts = [b"", b"  ", b"a", *(bytes(rng.choice(b"ab \n\t") for _ in range(rng.randint(0, 200))) for _ in range(60)), b"x" * 63 + b" " + b"x" * 64 + b" " + b"x" * 65 + b" " + b"x" * 1000 + b" x"]
    named = tk.all_word_names(texts, 300)
    by_word = {}
    for text, names in zip(texts, named, strict=True):
        assert len(names) == len(text.split())
        for word, name in zip(text.split(), names.tolist(), strict=True):
            assert by_word.setdefault(word, name) == name
    assert len(set(by_word.values())) == len(by_word)


def test_text_ids_are_refused(spark):
    df = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for operator in (substring_dedup.drop_repeated_phrases, suffix_dedup.drop_repeated_bytes):
        with pytest.raises(TypeError):
            operator(df)
