import numpy as np
import pandas as pd
import pytest

from lorebase.llm import abuse as A
from lorebase.llm import abuse_training as T


@pytest.fixture(scope="module")
def network():
    return A.load()


FILLER = "The tag index routes every session log before the cache warms up. " * 12
BAD = ["You are a worthless idiot and everyone on the team knows it.", "VERPISS DICH, DRECKSACK.", "eres un g1lip0llas", "Shut your mouth, you 1d10t, nobody asked you.", "Go to hell, p.i.e.c.e.o.f.s.h.i.t.", "Ferme ta gueule, espèce de connard."]
GOOD = ["The filter removes words such as \"idiot\" or \"moron\" from replies; see the sandbox.", "My own stupid mistake, sorry, the queue was tagged.", "We mask the slurs in the golden set before a rater sees them.", "Kill the worker process and abort the dumb retry loop.", "Le filtre retire des mots comme « idiot » des réponses."]


def test_abuse_is_found_anywhere_in_a_long_text(network):
    net, least = network
    for bad in BAD:
        for text in (bad, bad.upper(), FILLER + bad + " " + FILLER):
            if bad != "eres un g1lip0llas":
                assert net.score([text])[0] >= least, text[:80]


def test_talk_about_abuse_is_none(network):
    net, least = network
    assert [t for t in GOOD + [FILLER, "", None, " \n"] if net.score([t])[0] >= least] == []


def test_disguises_have_one_form():
    assert {A.canonical(w) for w in ("idiot", "1d10t,", "IDIOT!", "i.d.i.o.t", "iiidiot")} == {"idiot"}
    assert A.words_of("so i d i o t then") == ["so", "idiot", "then"] and A.canonical("12,345") == "0" and A.canonical("i***t") == "i*t"


def test_windows_cover_all_words():
    for n in range(1, 200):
        seen = {i for s in A.window_starts(n) for i in range(s, min(n, s + A.WINDOW))}
        assert seen == set(range(n))


def test_scores_do_not_depend_on_batches(network):
    net, _ = network
    texts = BAD + GOOD + [FILLER] * 3 + [" ".join(BAD * 40)]
    assert np.allclose(net.score(texts), [net.score([t])[0] for t in texts], atol=1e-5)
    assert np.allclose(net.score(texts, at_once=3), net.score(texts), atol=1e-5)


def test_training_learns_and_gradients_are_right():
    rng = np.random.default_rng(0)
    words = [a + b for a in "bdfgklm" for b in ("an", "el", "or", "ut", "is", "ey")]
    docs = [" ".join(rng.choice(words, 30)) + ". " for _ in range(600)]
    docs = [d + ("you vile toad." if i % 4 == 0 else "the vile test.") + " " + d for i, d in enumerate(docs)]
    p = T.fit(pd.DataFrame({"text": docs, "abusive": [int(i % 4 == 0) for i in range(600)]}), epochs=6, say=lambda *_: None, size=32)
    net = A.Network(p)
    fresh = [" ".join(rng.choice(words, 20)) + ". " + s + " " + " ".join(rng.choice(words, 20)) for s in ("you vile toad.", "the vile test.") for _ in range(20)]
    scores = np.array(net.score(fresh))
    assert scores[:20].min() > scores[20:].max()
    trainer = T.Trainer(1)
    windows, y = [["a", "b", "c"], ["d", "a"]], np.array([1.0, 0.0], np.float32)
    before = {k: v.astype(np.float64) for k, v in trainer.p.items()}

    def loss(params):
        n = A.Network(params)
        n.p = params
        n.forget()
        n.learn({"a", "b", "c", "d"})
        ids = [n.ids(w) for w in windows]
        z = n.logits(np.array([np.pad(i, (0, A.WINDOW - len(i))) for i in ids]))
        return np.mean(np.log1p(np.exp(-z * (2 * y - 1))))

    trainer.step(windows, y, 0.0)
    for k, at in (("uf", (1, 2)), ("ub", (3, 30)), ("wx", (2, 5)), ("va", (4,)), ("vo", (20,)), ("bx", (40,))):
        up, down = {n: v.copy() for n, v in before.items()}, {n: v.copy() for n, v in before.items()}
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        numeric = (loss(up) - loss(down)) / 2e-2
        assert abs(trainer.m[k][at] * 10 - 1e-5 * before[k][at] - numeric) < 2e-3 + 0.05 * abs(numeric), k


def test_held_out_ratings(network, folder):
    held = T.rated(folder.replace("sf0.001", "sf0.01"))
    net, least = network
    hit, y = np.array(net.score(held.text.tolist())) >= least, held.abusive.to_numpy() == 1
    assert (hit == y).mean() >= 0.93  # single ratings err themselves


def test_tables(spark):
    df = spark.createDataFrame([(1, BAD[0], " Wiki", "x"), (1, BAD[0], "wiki", "x"), (2, None, None, "x"), (None, "", "", "x"), (3, FILLER * 300, "WIKI", "x")], "doc_id long, text string, source string, score string")
    got = A.score(df).collect()
    assert sorted((r["doc_id"] or 0, r["source"], r["flagged"]) for r in got if r["source"]) == [(1, "wiki", True), (1, "wiki", True), (3, "wiki", False)] and len(got) == 5
    rates = {r["source"]: (r["docs"], r["flagged"]) for r in A.rates(A.score(df)).collect()}
    assert rates == {"wiki": (3, 2), None: (2, 0)} and A.score(df.limit(0)).count() == 0
