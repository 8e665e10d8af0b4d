import random
from functools import lru_cache

import regex
from pyspark.sql import functions as F

from eventloom.llm import decontaminate, queries

ITEMS = [
    (1, "A train travels 120 km from Berlin to Munich in 3 hours before Anna leaves Berlin again."),
    (2, "What is the largest planet of the solar system by mass and by volume today"),
    (3, "too short here"),
    (4, "Anna Bob Carl Dora Emil Fritz Gustav Hans Ida"),
    (5, "seven little words stand in this item"),
    (6, None),
]


def flagged(make, texts, spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    df = make(list(enumerate(texts))).withColumn("contaminated", F.lit("x")).withColumn("hits", F.lit(1))
    return {r.doc_id: list(r.item_ids) for r in decontaminate.contamination(df, items).collect() if r.contaminated}


def test_templates(make, spark):
    texts = [
        "Some prose first. A train travels 120 km from Berlin to Munich in 3 hours before Anna leaves Berlin again. And more.",
        "Intro here. A train travels 88 miles from Paris to Lyon in 2 hours before Marie leaves Paris again.",
        "a text about trains that travel from one town to another and come back again before noon",
        "what is the LARGEST planet of the solar system, by mass and by volume today",
        "Otto Paul Quax Rolf Sven Toni Ulf Vera Walt",
        "then Anna Bob Carl Dora Emil Fritz Gustav Hans Ida came",
        "so: seven little words stand in this item, they do",
        "too short here",
        None,
        "",
    ]
    assert flagged(make, texts, spark) == {0: [1], 1: [1], 3: [2], 5: [4], 6: [5]}


def test_inconsistent_slots_do_not_match(make, spark):
    # the item names one town twice; here two towns stand in its places
    text = "A train travels 1 km from Paris to Lyon in 2 hours before"
    items = spark.createDataFrame([(1, "words came from Rome until seen from Rome by night")], "item_id int, text string")
    same = make([(0, "words came from Oslo until seen from Oslo by night"), (1, "words came from Oslo until seen from Bern by night"), (2, text)])
    assert [r.doc_id for r in decontaminate.contamination(same, items, window=9).where("contaminated").collect()] == [0]


def test_hard_cases(hard, none, spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    out = decontaminate.contamination(hard, items)
    assert out.count() == hard.count() and out.where("contaminated").count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(hard, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminated(hard, items).columns == hard.columns


def test_large_benchmarks_are_joined_by_shuffle(make, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert flagged(make, ["what is the largest planet of the solar system by mass"], spark) == {0: [2]}


def test_no_python_in_the_plan(spark, data):
    for query in (queries.op6_decontaminate, queries.op4_line_dedup, queries.op9_sharding):
        plan = query(spark, data)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_finds_whole_passages(spark, data):
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    flat = [" ".join(t.split()) for t in items]
    whole = {i for i, t in docs.items() if any(x in " ".join(t.split()) for x in flat)}
    found = {r.doc_id for r in queries.op6_decontaminate(spark, data).where("contaminated").collect()}
    assert whole <= found and len(found - whole) <= 0.02 * len(docs)


def test_case_does_not_hide_a_passage(make, spark):
    shouted = ITEMS[1][1].upper()
    texts = [shouted, "Before it. " + ITEMS[0][1].title() + " After it.", "so: SEVEN LITTLE WORDS STAND IN THIS ITEM", " ".join(shouted.split()[2:10]), "x " + " ".join(shouted.split()[3:10]), "a a a " + ITEMS[0][1].lower()]
    assert flagged(make, texts, spark) == {0: [2], 1: [1], 2: [5], 3: [2], 5: [1]}
    for before in range(9):
        text = " ".join(["fill"] * before + shouted.split()[4:12] + ["end"])
        assert flagged(make, [text], spark) == {0: [2]}


@lru_cache
def plain_words(text):
    return tuple(w for w in regex.split(r"[\x20\x09-\x0D]+", text or "") if regex.search(r"[\p{L}\p{N}]", w))


@lru_cache
def plain_core(word):
    return regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", word).lower()


@lru_cache
def plain_forms(words):
    return [plain_form(words, k) for k in range(len(words))]


def plain_form(words, k):
    word, before, core = words[k], words[k - 1] if k else "", plain_core(words[k])
    if regex.search(r"\p{N}", word):
        return "<num>"
    if k and regex.match(r"[^\p{L}]*\p{Lu}", word) and not regex.search(r"[.!?:;][^\p{L}\p{N}]*$", before):
        return "<name>"
    return "<unit>" if k and regex.search(r"\p{N}", before) and core in decontaminate.UNITS else core


def plain_match(a, i, b, j, n, min_literal):
    """Whether the n words of a from i and of b from j match: by the same words, or as templates whose slots map one to one."""
    left, right = [plain_core(w) for w in a[i : i + n]], [plain_core(w) for w in b[j : j + n]]
    if left == right:
        return True
    forms = plain_forms(a)[i : i + n]
    if forms != plain_forms(b)[j : j + n]:
        return False
    slots = [(x, y) for x, y, f in zip(left, right, forms, strict=True) if f in ("<num>", "<unit>", "<name>")]
    one_to_one = len({x for x, _ in slots}) == len({y for _, y in slots}) == len(set(slots))
    return one_to_one and (n - len(slots) >= min_literal or [w.lower() for w in a[i : i + n]] == [w.lower() for w in b[j : j + n]])


def plain_matches(text, items, window=8, min_forms=5, min_literal=4):
    """The items of which a text holds a window, comparing each place of the one with each of the other."""
    have, found = plain_words(text), []
    for item, body in items:
        wanted = plain_words(body)
        n = min(window, len(wanted))
        if len(wanted) >= min_forms and any(plain_match(wanted, i, have, j, n, min_literal) for i in range(len(wanted) - n + 1) for j in range(len(have) - n + 1)):
            found.append(item)
    return found


def test_equals_a_plain_matcher(make, spark):
    rng = random.Random(11)
    names, units, verbs = ["Anna", "Bob", "Carl", "Oslo", "Rome"], ["km", "kg", "hours", "miles"], ["walks", "buys", "sees", "and", "from", "to", "by", "the"]

    def sentence(n):
        out = []
        for _ in range(n):
            kind = rng.random()
            out.append(rng.choice(names) if kind < 0.2 else str(rng.randint(1, 4)) if kind < 0.3 else rng.choice(units) if kind < 0.4 else rng.choice(verbs) + rng.choice(["", "", "", ",", "."]))
        return out

    items = [(k, " ".join(sentence(rng.randint(3, 14)))) for k in range(25)]
    texts = []
    for k in range(120):
        words = sentence(rng.randint(0, 12)) + list(plain_words(items[k % 25][1])) + sentence(rng.randint(0, 6))
        for _ in range(rng.randint(0, 3)):  # other values in some places
            at = rng.randrange(len(words))
            words[at] = rng.choice(names) if words[at][0].isupper() else str(rng.randint(1, 9)) if words[at].isdigit() else words[at].upper() if rng.random() < 0.3 else words[at]
        texts.append(" ".join(words))
    frame = spark.createDataFrame(items, "item_id int, text string")
    for options in ({}, {"window": 5, "min_forms": 3, "min_literal": 2}):
        found = {r.doc_id: list(r.item_ids) for r in decontaminate.contamination(make(list(enumerate(texts))), frame, **options).collect()}
        expected = {k: plain_matches(t, items, **options) for k, t in enumerate(texts)}
        assert found == expected and 20 < sum(map(bool, expected.values()))


def test_query_equals_a_plain_matcher(spark, data):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()][:12]
    frame = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.read.parquet(f"{data}/documents.parquet").where(F.length("text") < 1500)
    found = {r.doc_id: list(r.item_ids) for r in decontaminate.contamination(docs.select("doc_id", "text"), frame).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    # templates are compared word by word only where three of an item's words stand in the text in a row
    grams = {i: {tuple(plain_forms(w)[k : k + 3]) for w in [plain_words(t)] for k in range(len(w) - 2)} for i, t in items}
    plain = {i: {tuple(map(plain_core, w[k : k + 3])) for w in [plain_words(t)] for k in range(len(w) - 2)} for i, t in items}
    for doc, text in texts.items():
        words = plain_words(text)
        have = {tuple(plain_forms(words)[k : k + 3]) for k in range(len(words) - 2)}
        cores = {tuple(map(plain_core, words[k : k + 3])) for k in range(len(words) - 2)}
        likely = [(i, t) for i, t in items if have & grams[i] or cores & plain[i]]
        assert found[doc] == plain_matches(text, likely)


def test_forms_in_passes_over_a_text_equal_those_of_single_words(make):
    rng = random.Random(5)
    parts = ["a", "Bo", "km", "Kg", "5", "x7", "Σ", "ΟΔΟΣ", "İ", "é", "É", "ǅ", "𠀀", "𝐀", "😀", "\u0301", "-", "--", ".", "!", "...", ":", "'", "<", "<num>", "<name>", "\u00a0", "\x1f", "\x85", "\u2028", " ", " ", " ", " ", "  ", "\n", "\t", " \r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600)] + [None, "", " ", "-- --", "a", "A. ", " (B"]
    for row in decontaminate.canonical(make(list(enumerate(texts))), "text").collect():
        found = plain_words(row.text)
        assert (row.cores, row.forms) == ([plain_core(w) for w in found], plain_forms(found))


def test_letters_beyond_the_basic_plane_are_told_apart(make, spark):
    items = spark.createDataFrame([(1, "one two three four five six seven 𠀀")], "item_id int, text string")
    df = make([(0, "one two three four five six seven 𠀀"), (1, "one two three four five six seven 𠀁")])
    assert [r.doc_id for r in decontaminate.contamination(df, items).where("contaminated").collect()] == [0]


def test_no_pattern_is_run_word_by_word_over_all_documents(make, spark, monkeypatch):
    plans, real = [], decontaminate.materialised
    monkeypatch.setattr(decontaminate, "materialised", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    assert flagged(make, [ITEMS[1][1], "nothing here"], spark) == {0: [2]}
    assert plans and not any(regex.search(r"regexp_replace\(\S*lambda", plan) for plan in plans)
