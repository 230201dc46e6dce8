"""Personal data: high-recall generators, boosted trees over candidates, calibrated thresholds.

Base spans of four kinds follow fixed patterns and always stay. Generators
propose more spans, which may overlap: obfuscated addresses, phone numbers
without a plus sign, IPv6, cards with other separators. Trees score each by its
format and context; spans over the kind's calibrated threshold are added, the
surest first, where they overlap no base span and no surer one.

The trees are trained here, on texts that a seeded generator writes: formats of
personal data and look-alikes (dates, versions, orders, digests) in neutral and
in telling contexts. Nothing is learned from the corpus. Every pattern works in
time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import textvec
from lacuna.llm.boosting import Isotonic, Trees
from lacuna.llm.session import lean, read

KINDS = ("email", "ip", "card", "phone")
#: A threshold is the least at which this share of the calibration texts' added spans is right.
PRECISION = 0.97

Span = tuple[int, int, int]  # kind, start, end

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0")[:3] or 0) <= 255


def matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, holds) of all leftmost non-overlapping base matches, kind by kind."""
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            lo = max(last, text.rfind("@", last, m.start()) + 1)
            start = lo + len(text[lo : m.start()].rstrip(_LOCAL))
            if start < m.start():
                yield 0, start, m.end(), True
                last = m.end()
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _CHAIN.finditer(text):
            if m[0].count(".") < 3:
                continue
            parts, at = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                yield 1, at, at + size, all(map(_octet, four))
                at += size + 1
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if len(m[0]) < 60 else m[0].replace(" ", "").replace("-", "")
        yield 2, m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield 3, m.start(), m.end(), 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15


_GAP = r"[\x20]{0,2}"
_AT = rf"{_GAP}(?:[\[({{<]{_GAP}(?:@|at|AT){_GAP}[\])}}>]|[\x20](?:at|AT)[\x20]|@){_GAP}"
_DOT = rf"{_GAP}(?:[\[({{<]{_GAP}(?:\.|dot|DOT){_GAP}[\])}}>]|[\x20](?:dot|DOT)[\x20]|\.){_GAP}"
_HIDDEN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}")
_ANCHOR = re.compile(r"[\[({<\x20](?:at|AT|dot|DOT)[\])}>\x20]|\x20@|@\x20")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,8}\)?){1,5}(?![0-9A-Za-z])")
_SIX = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_ODD_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{3,6}){2,4}(?![0-9])")


def proposals(text: str) -> set[Span]:
    """Spans that might be personal data, of any overlap."""
    found = set()
    last = 0
    for anchor in _ANCHOR.finditer(text):
        if anchor.start() >= last:
            lo = max(0, anchor.start() - 80)
            last = anchor.end() + 80
            found |= {(0, lo + m.start(), lo + m.end()) for m in _HIDDEN.finditer(text[lo : last + 200])}
    if _DIGIT.search(text):
        found |= {(3, m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text) if m.end() - m.start() <= 40}
        found |= {(2, m.start(), m.end()) for m in _ODD_CARD.finditer(text)}
    if ":" in text:
        found |= {(1, m.start(), m.end()) for m in _SIX.finditer(text) if m.end() - m.start() > 6}
    return found


# Words that tell what a number nearby is.
CONTEXT = (
    "email mail e-mail contact write reach".split(),
    "ip host server address addr ping node dns".split(),
    "card visa mastercard amex credit debit payment pay charge".split(),
    "phone tel call mobile cell fax telephone dial whatsapp ring".split(),
    "order invoice version release date isbn id no ref ticket serial build page room table total price sum score from between time".split(),
)
_WORD = re.compile(r"[A-Za-z-]+")


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a candidate."""
    kind, start, end = span
    own = text[start:end]
    digits = "".join(c for c in own if c.isascii() and c.isdigit())
    groups = [len(g) for g in re.findall("[0-9]+", own)]
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    words = [w.lower() for w in _WORD.findall(before)][-6:]
    later = [w.lower() for w in _WORD.findall(after)][:4]
    seps = [c for c in own if not c.isalnum()]
    tail = re.findall(r"[A-Za-z]+", own)
    return [
        *(kind == k for k in range(4)),
        len(own),
        len(digits),
        sum(c.isalpha() for c in own),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        float(np.std(groups)) if groups else 0,
        len(set(seps)),
        own.count(" "),
        own.count("."),
        own.count("-"),
        own.count("/"),
        own.count(":"),
        own.startswith("("),
        own.startswith("00"),
        luhn(digits) if 12 < len(digits) < 20 else 0,
        bool(re.fullmatch(r"(?:19|20)\d\d\W\d\d?\W\d\d?|\d\d?\W\d\d?\W(?:19|20)\d\d", own)),
        len(set(digits)),
        "::" in own,
        bool(re.search(r"\b(?:at|AT)\b", own)),
        bool(re.search(r"\b(?:dot|DOT)\b", own)),
        any(c in own for c in "[({<"),
        "@" in own,
        len(tail[-1]) if tail else 0,
        bool(tail and tail[-1].lower() in ("com", "org", "net", "edu", "io", "de", "fr", "es", "uk", "info")),
        *(sum(w in names for w in words) for names in CONTEXT),
        *(sum(w in names for w in later) for names in CONTEXT[:4]),
        bool(before) and (before[-1].isalnum() or before[-1] in "._/#$€-"),
        bool(after) and (after[0].isalnum() or after[0] in "_/%€$"),
        sum(c.isdigit() for c in before + after) / max(1, len(before + after)),
    ]


def written(rng: np.random.Generator, count: int) -> tuple[list[str], list[set[Span]]]:
    """Texts with one piece of personal data or one look-alike each, and the true spans."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n).tolist()))
    name = lambda: "".join(pick(*"ba ke lo mi nu ra se to vi wo an er in".split()) for _ in range(int(rng.integers(2, 4))))

    def card() -> str:
        body = pick("4", "5", "37", "6011") + num(14)
        body = body[:15]
        return body + next(c for c in "0123456789" if luhn(body + c))

    def hidden_mail() -> str:
        at, dot = pick((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" at ", "."), (" AT ", "."), (" AT ", " DOT "), (" @ ", " . "), (" @ ", "."))
        return name() + pick("", "." + name(), num(2)) + at + name() + dot + pick("com", "org", "net", "de", "fr", "io")

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b} {c}", f"00{pick('1', '44', '49', '33')} {a} {b} {c}", f"({a}) {b} {c}", f"0{num(2)}/{num(3)} {num(4)}", f"0{num(3)} {num(7)}", f"0{num(2)} {num(8)}", f"00{pick('49', '33', '34')} {num(3)} {num(7)}")

    def six() -> str:
        part = lambda: f"{int(rng.integers(0, 65536)):x}"
        return pick(":".join(part() for _ in range(8)), f"2001:db8::{part()}", f"fe80::{part()}:{part()}:{part()}")

    def odd_card() -> str:
        c = card()
        return pick(".", "/", "_", "  ", " - ").join(c[k : k + 4] for k in range(0, 16, 4))

    make = [(0, hidden_mail), (3, phone), (1, six), (2, odd_card)]
    fakes = [
        lambda: f"{pick('19', '20')}{num(2)}-0{int(rng.integers(1, 10))}-{int(rng.integers(10, 29))}",
        lambda: f"{int(rng.integers(10, 29))}.{int(rng.integers(10, 13))}.20{num(2)}",
        lambda: f"{num(1)}.{num(2)}.{num(1)}.{num(1)}.{num(2)}",
        lambda: f"{num(4)}-{num(4)}-{num(4)}-{num(4)}-{num(4)}",
        lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
        lambda: f"{int(rng.integers(10, 24))}:{num(2)}:{num(2)}",
        lambda: f"{num(2)} - {num(2)}",
        lambda: f"{num(3)} {num(3)} {num(3)}",
        lambda: f"{num(2)}/{num(2)} {num(2)}/{num(2)}",
        lambda: f"{num(2)}.{num(2)} {num(2)}.{num(2)} {num(2)}.{num(2)}",
        lambda: " ".join(num(int(rng.integers(2, 5))) for _ in range(4)),
        lambda: f"{name()} at {name()}. {name()} dot",
        lambda: f"{pick('look', 'point', name())} at {pick('the', 'this', 'a', name())} dot {pick('on', 'in', 'of', name())} {name()}",
        lambda: f"{num(4)} {num(7)}",
        lambda: f"{name()} @ {name()} today",
        lambda: f"{name()} at {name()}. {name().capitalize()} {name()}",
        lambda: f"{name()}::{name()}",
        lambda: hashlib.sha1(num(6).encode()).hexdigest(),
        lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}",
        lambda: f"20{num(2)}/20{num(2)}",
        lambda: f"{num(3)}-{num(4)}",
    ]
    # Of the very forms of personal data: only the context or a check digit tells.
    twins = [
        (3, phone, True),
        (2, lambda: pick(".", "/", "  ", " - ").join(num(4) for _ in range(4)), False),
        (1, lambda: ":".join(num(2) for _ in range(int(rng.integers(3, 7)))), False),
        (1, lambda: ":".join(f"{int(rng.integers(256)):02x}" for _ in range(6)), False),
        (0, lambda: f"{pick('look', 'meet', 'arrive', 'stay', 'us', name())} at {name()}.{name()}", True),
        (0, lambda: f"{pick('look', 'meet', 'arrive', 'stay', 'us')} at {name()}.{pick('com', 'org', name(), name())}", True),
        (0, lambda: f"{name()} at {pick('noon', 'home', 'night', name())}. {name()}.{name()}", True),
    ]
    texts, truth = [], []
    for _ in range(count):
        real = rng.random() < 0.5
        kind, maker = pick(*make) if real else (int(rng.integers(4)), pick(*fakes))
        odd = False
        if not real and rng.random() < 0.4:
            kind, maker, odd = twins[int(rng.integers(len(twins)))]
        body = maker()
        lead = " ".join(name() for _ in range(int(rng.integers(0, 5))))
        hint = pick(*CONTEXT[kind]) + pick(" ", ": ", " is ") if real and rng.random() < 0.5 else pick(*CONTEXT[4]) + " " if rng.random() < (0.1 if real else 0.95 if odd and kind == 3 else 0.5) else ""
        head = (lead + pick(" ", ". ", ", ", "\n") if lead else "") + hint
        tail = pick("", ".", ",", " ") + " " + " ".join(name() for _ in range(int(rng.integers(0, 5))))
        texts.append(head + body + tail)
        truth.append({(kind, len(head), len(head) + len(body))} if real else set())
    return texts, truth


class Model:
    def __init__(self, trees: Trees, steps: Isotonic, threshold: np.ndarray):
        self.trees, self.steps, self.threshold = trees, steps, threshold

    def probability(self, text: str, spans: list[Span]) -> np.ndarray:
        return self.steps(self.trees.margin(np.array([describe(text, s) for s in spans], float))) if spans else np.empty(0)


@lru_cache(maxsize=1)
def trained(seed: int = 11, count: int = 8000) -> Model:
    """Three fifths of the written texts train the trees, one calibrates them, and one sets each kind's threshold."""
    texts, truth = written(np.random.default_rng(seed), count)
    rows = [(k % 5, t, s, s in real) for k, (t, real) in enumerate(zip(texts, truth, strict=True)) for s in sorted(proposals(t))]
    x, y, part = np.array([describe(t, s) for _, t, s, _ in rows], float), np.array([r[3] for r in rows], float), np.array([r[0] for r in rows])
    trees = Trees.fit(x[part < 3], y[part < 3], rounds=60, depth=4)
    steps = Isotonic.fit(trees.margin(x[part == 3]), y[part == 3])
    last = part == 4
    kind, right, p = x[last, :4].argmax(1), y[last], steps(trees.margin(x[last]))
    threshold = np.full(4, 0.99)
    for k in range(4):
        for t in np.unique(p[kind == k]).tolist():
            chosen = (kind == k) & (p >= t)
            if t >= 0.5 and right[chosen].mean() >= PRECISION:
                threshold[k] = t
                break
    return Model(trees, steps, threshold)


def spans_of(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans, in order of kind and start."""
    base = [(k, a, b) for k, a, b, holds in matches(text) if holds]
    maybe = sorted(proposals(text) - set(base))
    if maybe:
        # A candidate that touches a base span can't be added; few spans are compared, in order of start.
        taken = sorted((a, b) for _, a, b in base)
        starts = np.array([a for a, _ in taken])
        furthest = np.maximum.accumulate([b for _, b in taken]) if taken else np.empty(0)
        clear = []
        for s in maybe:
            k = int(np.searchsorted(starts, s[2]))
            if k == 0 or furthest[k - 1] <= s[1]:
                clear.append(s)
        p = model.probability(text, clear)
        added: list[tuple[int, int, int]] = []  # start, end, kind; in order, without overlap
        for i in np.argsort(-p, kind="stable").tolist():
            kind, a, b = clear[i]
            at = bisect_left(added, (a, b, kind))
            if p[i] >= model.threshold[kind] and (at == 0 or added[at - 1][1] <= a) and (at == len(added) or b <= added[at][0]):
                added.insert(at, (a, b, kind))
        return base, sorted(base + [(k, a, b) for a, b, k in added])
    return base, base


def _line(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_MARK = textvec.table(lambda b: chr(b) in "0123456789@:" if b < 128 else False)
#: The anchors of proposals() without those that have a mark; the end is looked at only, so that neighbours share a space.
_SAID = re.compile(rb"[\[({<\x20](?=(?:at|AT|dot|DOT)[\])}>\x20])")


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, counts of base spans by kind, SHA-256 of the base spans' list, all spans.

    Null and empty texts have no spans; repeated rows give repeated results.
    Offsets are code points, ends exclusive. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def find(batches):
        for batch in batches:
            texts = batch.column(1)
            data, off = textvec.utf8(texts)
            marked = np.zeros(len(texts), bool)
            raw = data[off[0] : off[-1]]
            hits = [np.flatnonzero(_MARK[raw[k : k + (1 << 22)]]) + k for k in range(0, len(raw), 1 << 22)]
            hits.append(np.array([m.start() for m in _SAID.finditer(memoryview(raw))], np.int64))
            for at in hits:
                marked[np.searchsorted(off[1:] - off[0], at, "right")] = True
            base = [[] for _ in range(len(texts))]
            full = [[] for _ in range(len(texts))]
            for d in np.flatnonzero(marked).tolist():
                base[d], full[d] = spans_of(texts[d].as_py(), shared.value)
            counts = np.array([[sum(s[0] == k for s in own) for own in base] for k in range(4)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array([hashlib.sha256(_line(b).encode()).hexdigest() for b in base], pa.string()), pa.array([_line(s) for s in full], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(find), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op1_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find_pii(read(spark, sf_dir, "documents"))
