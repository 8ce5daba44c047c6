"""Personal data that the field's gate and bounds must let through."""

import random

import numpy as np
import pytest

from scrivel.llm import pii_semicrf


def found(text):
    return [text[s:e] for _, s, e in pii_semicrf.find(text, pii_semicrf.weights())[1]]


@pytest.mark.parametrize("span", ["john [at] example [dot] com", "anna (at) mailer (dot) org", "password=correcthorsebattery", "api_key: abcdefghijklmnopqrst", "ghp_abcdefghijabcdefghijabcdefghij"])
def test_spans_of_letters_only(span):
    assert found(f"please write {span} today") == [span]


def test_words_after_cues_stay():
    assert found("the secret garden, a token of thanks, and forgot the password again") == []


@pytest.mark.parametrize("span", ["DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "FR14 2004 1010 0505 0001 3026 606", "anna [at] mail [dot] b2 [dot] com", "password=" + "a1b2" * 150, "sk-" + "Ab3" * 200, "secret: " + "0123456789abcdef" * 40, "MT84 1234 1234 1234 1234 1234 1234 1234 123"])
def test_long_spans_are_whole(span):
    assert found(f"please write {span} today") == [span]


def test_islands_give_the_best_labelling_of_whole_texts():
    w, rng = pii_semicrf.weights(), random.Random(2)
    bits = ["the", "old", "password", "is", "a1b2c3d4e5f6a7b8", "call", "+49", "151", "1234567", "jane", "[at]", "mail", "[dot]", "org", "12", "DE89", "3704", "0044", "0532", "0130", "00", "sk-" + "Ab3" * 8, "quite"]
    for _ in range(150):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))
        tokens = [m.span() for m in pii_semicrf._TOKEN.finditer(text)]
        segs = pii_semicrf.candidates(text, tokens)
        x = np.zeros((len(segs), pii_semicrf.FEATURES))
        for i, s in enumerate(segs):
            x[i, s[4]] = 1
        assert pii_semicrf.crf_spans(text, w) == (pii_semicrf.viterbi(len(tokens), segs, x @ w.T) if segs else [])
