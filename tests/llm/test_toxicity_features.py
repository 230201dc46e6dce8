"""The features of toxicity against a plain version, word by word."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lacuna.llm import textvec, toxicity
from lacuna.llm.toxicity import BEGINNINGS, INSULTS, NAMES, SECOND_PERSON, ToxicModel

WORDS = {"bloed": 2.0, "kuh": 1.5, "élan": 0.5, "sot": 3.0}
HEADS = {"schm": 1.0, "merd": 2.5, "schmu": 0.25, "kuhhand": 0.75}


def fold(word):
    out = bytearray(word)
    for k, b in enumerate(word):
        if 65 <= b <= 90 or (k and word[k - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97):
            out[k] += 0x20
    return bytes(out)


def lexicon():
    keys = [int(toxicity._word_hashes([w])[0]) for w in WORDS]
    for h in HEADS:
        raw = np.frombuffer(h.encode(), np.uint8)
        keys.append(int((textvec.span_hashes(raw, np.array([0]), np.array([len(raw)])) ^ np.uint64(0x5851F42D4C957F2D))[0]))
    values = [*WORDS.values(), *HEADS.values()]
    order = np.argsort(np.array(keys, np.uint64))
    return np.array(keys, np.uint64)[order], np.array(values)[order]


def plain(text):
    raw = (text or "").encode()
    words = re.findall(rb"[A-Za-z\x80-\xff]+", raw)
    own = [fold(w) for w in words]
    insults, you = ({fold(w.encode()) for w in ws} for ws in (INSULTS, SECOND_PERSON))
    learned = {fold(w.encode()): v for w, v in WORDS.items()}
    heads = {h.encode(): v for h, v in HEADS.items()}
    hit = [w for w in own if w in learned]
    begins = [w[:k] for w in own for k in BEGINNINGS if len(w) > k and w[:k] in heads]
    at_you = [k for k, w in enumerate(own) if w in you]
    bad = [k for k, w in enumerate(own) if w in insults or w in learned]
    n, size = max(len(words), 1), max(len(raw), 1)
    letter = lambda b: b >= 0x80 or chr(b).isalpha()
    leet_words = re.findall(rb"[A-Za-z0-9@$!*\x80-\xff]+", raw)
    hidden = 0
    for w in leet_words:
        odd = sum(not letter(b) for b in w)
        if odd and 3 < len(w) < 40 and 10 * odd <= 7 * len(w):
            clear = w.lower().translate(bytes.maketrans(b"01345789@$!", b"oieastbgasi"))
            hidden += clear in insults or clear in learned
    pairs = list(zip(words[1:], words[:-1], strict=True))
    return {
        "length": len(words),
        "insults": sum(w in insults for w in own) / n,
        "insult_kinds": len({w for w in own if w in insults}),
        "learned": len(hit) / n,
        "learned_kinds": len(set(hit)),
        "learned_most": max([0.0, *(learned[w] for w in hit)]),
        "learned_mass": sum(learned[w] for w in hit),
        "beginnings": len(begins) / n,
        "begin_kinds": len(set(begins)),
        "begin_mass": sum(heads[h] for h in begins) / n,
        "near_you": sum(any(abs(k - y) <= 3 for y in at_you) for k in bad) / n,
        "you": len(at_you) / n,
        "capitals": sum(65 <= b <= 90 for b in raw) / size,
        "shouted": sum(len(w) > 2 and all(65 <= b <= 90 for b in w) for w in words) / n,
        "marks": raw.count(b"!") / size,
        "questions": raw.count(b"?") / size,
        "symbols": sum(b in b"*#$%&@^~|" for b in raw) / size,
        "digits": sum(48 <= b <= 57 for b in raw) / size,
        "leet": hidden / max(len(leet_words), 1),
        "spaced": sum(len(a) == len(b) == 1 for a, b in pairs) / n,
        "stretched": sum(raw[k] == raw[k - 1] == raw[k - 2] and letter(raw[k]) for k in range(2, len(raw))) / size,
        "repeats": sum(fold(a) == fold(b) for a, b in pairs) / n,
        "hits_all": len(hit) + len(begins),
        "kinds_all": len(set(hit)) + len(set(begins)),
    }


def texts(rng, n):
    words = [*INSULTS[:6], *SECOND_PERSON[:5], *WORDS, "SCHMUCK", "merde", "kuhhandel", "Kuh", "ÉLAN", "river", "stone", "the", "A", "b", "x", "1d10t", "m0r0n", "$tupid", "sc*m", "!!!", "??", "aaaargh", "NO", "YOU", "42", "é", "日本", "@#%", "tu", "tú"]
    return [None, "", " ", "aa", "aa", "i d i o t", *("".join(rng.choice(words) + rng.choice([" ", " ", ", ", "\n", ". ", ""]) for _ in range(rng.randrange(40))) for _ in range(n))]


@pytest.mark.parametrize("limit", [textvec.LIMIT, 64])
def test_features_equal_a_plain_version(monkeypatch, limit):
    monkeypatch.setattr(textvec, "LIMIT", limit)
    rng = random.Random(limit)
    own = texts(rng, 300)
    got = ToxicModel(lexicon()).features(pa.array(own, pa.string()))
    for text, row in zip(own, got, strict=True):
        want = plain(text)
        for name, value in zip(NAMES, row, strict=True):
            assert value == pytest.approx(want[name], abs=1e-12), (name, text)
