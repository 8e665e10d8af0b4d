import zlib

import numpy as np
from pyspark.sql import functions as F

from eventloom.llm import language

WORDS = {"en": "the of and with that was for thing house walk", "de": "der und nicht über straße ich schön zwei größe haus", "fr": "le une des où été très voilà français garçon près"}


def corpus(n=90):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), rng.integers(3, 120))), lang if i % 11 else None))
    return rows


def test_learns_and_predicts(make):
    rows = [*corpus(), (1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "de"), (None, "the house and the walk with that thing", "en")]
    df = make(rows).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit("y"))
    found = {r.doc_id: r for r in language.identify(df).collect()}
    assert len(found) == len(rows)
    truth = {i: list(WORDS)[i % 3] for i in range(90)}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].held_out == (i in held) for i in truth)
    assert np.mean([found[i].lang_pred == truth[i] for i in held]) >= 0.9
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1000, 1001, 1002))
    assert found[None].lang_pred == "en" and not found[None].held_out
    assert all(0 <= r.score <= 1 for r in found.values())


def test_nothing_to_learn_from(make, none):
    assert [r.lang_pred for r in language.identify(make([(1, "some text", None)])).collect()] == ["und"]
    assert language.identify(none).count() == 0


def test_hard_cases(hard):
    assert language.identify(hard).count() == hard.count()


def test_lookup_tables_give_the_trained_responses():
    rng = np.random.default_rng(0)
    model = language.ByteCnn.fresh(["a", "b"], rng)
    x = rng.integers(0, 256, (5, language.WINDOW), dtype=np.uint8)
    pooled = np.concatenate([model._responses(x, w).max(axis=1) + model.biases[w] for w in range(len(language.WIDTHS))], axis=1)
    slow = language._log_softmax(np.maximum(pooled, 0) @ model.weights + model.offset)
    assert np.allclose(model.predictor().log_probabilities(x), slow, atol=1e-4)


def test_gradients():
    rng = np.random.default_rng(4)
    model = language.ByteCnn.fresh(["a", "b"], rng)
    model.tables = [t.astype(np.float64) for t in model.tables]
    model.weights = model.weights.astype(np.float64)
    x, y = rng.integers(0, 256, (3, 32), dtype=np.uint8), np.array([0, 1, 0])
    loss, grads = model.train_step(x, y)
    for p, g in zip(model.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-5
        assert abs((model.train_step(x, y)[0] - loss) / 1e-5 - g[at]) < 2e-2 * max(1, abs(g[at]))
        p[at] -= 1e-5


def test_windows_cover_the_whole_text():
    data = bytes(range(1, 256)) * 7
    assert language.windows(data).tobytes().rstrip(b"\0") == data
    assert language.windows(b"").shape == (1, language.WINDOW)


def test_repeated_rows_do_not_widen_the_sample(make, monkeypatch):
    """Rows of one id, equal or not, count against the bound like others."""
    seen = []
    monkeypatch.setattr(language, "SAMPLE_DOCUMENTS", 40)
    monkeypatch.setattr(language, "fit", lambda x, labels, **_: seen.append((len(x), labels)))
    long = "the house and the walk of that thing " * 60
    rows = [(1, long, "en")] * 300 + [(2, f"{i} {long}", "en") for i in range(300)] + [(None, f"der und nicht {i}", "de") for i in range(100)]
    language.train(make(rows))
    (n, labels), = seen
    assert labels.count("de") == 40 and labels.count("en") <= 40 * language.SAMPLE_WINDOWS and n == len(labels)


def plain_prediction(model, text):
    """Language and score with loops over windows, places, filters and languages."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    data = text.encode()
    mean = np.zeros(len(model.languages))
    cut = [data[i : i + language.WINDOW].ljust(language.WINDOW, b"\0") for i in range(0, len(data), language.WINDOW)]
    for part in cut:
        pooled = []
        for table, bias in zip(model.tables, model.biases, strict=True):
            for f in range(language.FILTERS):
                best = max(sum(float(table[j][part[i + j]][f]) for j in range(len(table))) for i in range(len(part) - len(table) + 1))
                pooled.append(max(0.0, best + float(bias[f])))
        scores = np.array(pooled) @ model.weights.astype(float) + model.offset
        mean += (scores - np.log(np.exp(scores - scores.max()).sum()) - scores.max()) / len(cut)
    share = np.exp(mean - mean.max())
    share /= share.sum()
    return model.languages[int(share.argmax())], float(share.max())


def test_predictions_equal_plain_loops(make):
    rows = [*corpus(60), (100, "the " * 400, None), (101, "1 2 3", None), (102, None, None)]
    df = make(rows)
    model = language.train(df)
    found = {r.doc_id: r for r in language.predict(df, model).collect()}
    for i, text, *_ in rows[::7] + rows[-3:]:
        lang, score = plain_prediction(model, text)
        assert found[i].lang_pred == lang and abs(found[i].score - score) < 1e-3
