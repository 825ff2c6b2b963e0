"""The tagger on names it never met: none of their words was in the training, in the lists of given names or (by the file
of excluded words) in the vocabulary that the training drew from."""

from pathlib import Path

import numpy as np
import pytest

from lorebase.llm import names as N
from lorebase.llm import personal as P

UNSEEN = "Wei Zhang|Anjali Menon|Katja Vogel|Ngozi Okafor|Sakura Tanaka|Kwame Mensah|Иван Петров|Αλέξης Παπαδόπουλος|Ольга Смирнова|Zofia Kowalczyk|Priyanka Chatterjee|Bjarne Lindqvist|Fatoumata Diallo|Jürgen Habermann|Екатерина Волкова|Δημήτρης Νικολάου|Oluwaseun Adeyemi|Milica Jovanović|Lwazi Dlamini|Ewa Nowakowska".split("|")
FRAMES = ["{} called about the invoice.", "Please contact {} before Friday.", "I met with {} in the office.", "The report was written by {}.", "Dear {},\nthanks for the update.", "Yesterday {} said that it was done.", "Caller: {}\nStatus: open", "Regards,\n{}", "The patient {} was seen at noon.", "According to {}, the data are wrong.", "We hired {} as an analyst.", '{{"name": "{}", "age": 4}}']
CLEAN = """The Golden Gate Bridge is in San Francisco.|Machine Learning models need data.|We use Apache Spark on Amazon Web Services.|The New York Times reported on Monday.|Visit the Eiffel Tower in Paris, France.|The United Nations met in Geneva.
Java Virtual Machine settings|Click File, then Save As.|Press Control Alt Delete.|Happy New Year to all!|World War Two ended in 1945.|The Supreme Court ruled on Tuesday.|Los Angeles is larger than San Diego.|Read the Quick Start Guide.|Install Visual Studio Code first.|Star Wars is a film.
The European Union agreed.|South Korea won.|Table Of Contents|Getting Started With Docker|Natural Language Processing|Error: File Not Found|Northern Ireland and Wales|Deutsche Bank meldet Verluste.|Die Vereinigten Staaten haben gewählt.|La Tour Eiffel est haute.|Harvard Business School teaches it.
See Appendix B.|Red Hat Linux|Open Source Software|The Black Sea is deep.|Hong Kong is warm.|Terms and Conditions|Privacy Policy|Data Engineering Team|Quarterly Business Review|Product Manager|Chief Executive Officer|Lake Michigan froze.|Mount Everest is high.|Pull Request merged|Hello World|Wall Street
THE PLAN TOOK 837 MS THE FIRST TIME|REPLAY FILE RESTORES 715 MS PER SNAPSHOT""".replace("\n", "|").split("|")


@pytest.fixture(scope="module")
def detect():
    return P.Detector()


def found(detect, text):
    return [text[a:b] for a, b, kind in detect(text) if kind == "name"]


def test_names_never_met(detect):
    assert not {w for n in UNSEEN for w in n.lower().split()} & detect.given
    hits = [n in found(detect, f.format(n)) for n in UNSEEN for f in FRAMES]
    assert sum(hits) / len(hits) >= 0.9


def test_clean_text(detect):
    wrong = [t for t in CLEAN if found(detect, t)]
    assert len(wrong) <= 0.05 * len(CLEAN), wrong


@pytest.mark.parametrize("text,name", [("Dr. Иванов called", "Dr. Иванов"), ("It was Anna Golden who", "Anna Golden"), ("张伟先生来了", "张伟"), ("caller | wei zhang | open", "wei zhang"), ("Ask Mrs. Fitzgerald", "Mrs. Fitzgerald")])
def test_forms(detect, text, name):
    assert found(detect, text) == [name]


def test_best_of_overlapping_spans(detect):
    assert found(detect, "approved by Imani Brevowitz We moved it") == ["Imani Brevowitz"]
    assert N.apart([(5, 9), (0, 6), (9, 12), (0, 5), (8, 10)]) == [(0, 5), (5, 9), (9, 12)]


def test_odd_texts(detect):
    for text in ("", " ", "A", "A.", ", ,", "X" * 5000, "Ab " * 3000, "\ud800 A B", "J. " * 500, "Ä" * 70 + " " + "Ö" * 70):
        assert all(0 <= a < b <= len(text) for a, b, _ in detect(text))


def test_weights_are_finite():
    weights, threshold = N.load()
    assert weights.shape == (2 * N.BUCKETS,) and np.isfinite(weights).all() and threshold < 0


def test_gradient_of_the_training():
    from lorebase.llm.names_training import fit

    rows = [[("=", f"a{i % 2}"), ("=", f"noise {i}")] for i in range(200)]
    y = np.array([i % 2 for i in range(200)], float)
    tagger = N.Tagger(frozenset(), fit(rows, y, np.ones(200), rounds=5), 0.0)
    assert tagger.score([("=", "a1")]) > 0.3 and tagger.score([("=", "a0")]) < -0.3


def test_excluded_words_are_the_test_names():
    words = set(Path(__file__).with_name("unseen_names.txt").read_text().split())
    assert {w for n in UNSEEN for w in n.lower().split()} <= words
