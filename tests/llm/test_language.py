"""Language identification of many texts at a time."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from lodestrata.llm import language

LETTERS = "abcdefghijklmnopqrstuvwxyzäé"


def made(n, rng, size=9):
    return ["".join(rng.choice(LETTERS) for _ in range(size)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    own = {k: made(300, rng) for k in ("de", "en", "fr")}
    return language.LanguageModel.of_rows([(k, " ".join(rng.choices(w, k=200))) for k, w in own.items() for _ in range(20)])


def test_many_texts_at_a_time_give_what_each_gives_alone(model, monkeypatch):
    """Texts of known and unseen words, in slices and with a memo that are much smaller than the texts."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(model.words.names + made(400, rng), k=rng.choice((1, 3, 300)))) for _ in range(60)]
    texts[7:7] = [None, "", "12 _ 3", "²½", "a", "日本", " ".join(made(500, rng))]

    def alone(text):
        words = language.words_of(text)
        if not any(w.isalpha() for w in words):
            return "und", 0.0
        total = np.zeros(3)
        for w in words:
            one = model.words.row.get(w)
            total += model.unseen(w) if one is None else model.words.floor + model.words.summed(np.array([one]), np.ones(1), np.zeros(1, np.int64), 1)[0]
        p = np.exp((total - total.max()) / len(words) ** 0.5)
        return model.langs[int(total.argmax())], float(p.max() / p.sum())

    want = [alone(t) for t in texts]
    for memo, together in ((language.MEMO, language.TOGETHER), (150, 90), (30, 9), (1, 1)):
        monkeypatch.setattr(language, "MEMO", memo)
        monkeypatch.setattr(language, "TOGETHER", together)
        got = language.Predictor(model).predict_all(texts)
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)


def test_unseen_words_are_looked_up_together(model):
    """op3_language: unseen words were summed one by one, which took most of the time."""
    words = made(20_000, random.Random(6))
    predictor, text = language.Predictor(model), " ".join(words)
    began = time.process_time()
    predictor.predict(text)
    many = time.process_time() - began
    began = time.process_time()
    for w in words:
        model.unseen(w)
    assert many < 0.5 * (time.process_time() - began)


def test_a_task_holds_little_beside_the_model(model):
    """pipeline: the words known and half a million unseen ones stood in one table of each task, beside a memo of 16 MB."""
    rng = random.Random(7)
    texts = [" ".join(made(500, rng)) for _ in range(500)]
    tracemalloc.start()
    predictor = language.Predictor(model)
    for t in texts:
        predictor.predict(t)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert predictor.memo.nbytes <= 8 * language.MEMO and held < 35_000_000
