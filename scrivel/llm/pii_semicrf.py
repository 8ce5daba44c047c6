"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments of up to MAX_SEGMENT tokens by features of the span as a unit (its shape, digit
count, checksum, the word before it), and one dynamic programme over segments chooses boundaries and types together.
The model's candidates are the segments that hold a trigger token (one with a digit, an @, a +, 16 capitals in a row, a
bracketed at or dot, a word such as password, or the head of a key or of a letters-only address) or follow such a word;
other segments have no weight by definition. The best labelling of a text therefore falls apart into islands of tokens
around triggers, and solving each island gives the best labelling of the whole text. Segments have no bound in characters.
The weights maximise the conditional likelihood of generated sentences.

Edge cases: null and empty texts have no spans; texts of any length are read whole; repeated rows are judged one by one;
empty tables give no rows; other columns are neither read nor changed. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scrivel.llm.common import batch_of, bounded, map_rows, short

BASE_KINDS = ("email", "ip", "card", "phone")
#: types of the field; the first four also name base patterns
KINDS = (*BASE_KINDS, "secret", "ident")
#: tokens of the longest printed account number
MAX_SEGMENT = 9

# Runs are taken whole, with the rest of the pattern optional, so that long runs cost linear time; a run that the rest
# doesn't follow holds no match at any of its starts.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, ordered by kind and start."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _EMAIL.finditer(text) if m[1]]
    if _DIGITS.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


# --- the field -----------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@+]|[A-Z]{16}|[\[(](?:[aA][tT]|[dD][oO][tT])[\])]|gh[pousr]_|sk-|(?:[a-fA-F]{1,4}:){4}|(?i:passw|pwd|secret|token|api[_-]?key|access[_-]?key)")
_AT_MARK = re.compile(r"(?i)[\[(]at[\])]")
_SPLIT = re.compile(r"[\s=:]+")
_SPACE = re.compile(r"\s")
_EDGE = ".,;:!?\"'()[]<>"
_SECRET_CUE = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[=:]?\s*[\"']?$")
_IDENT_CUE = re.compile(r"(?i)(?:ssn|passport|iban|tax|license no|id no|account)\S*$")
_MAIL_LIKE = re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]{2,}")
_AT_LIKE = re.compile(r"(?i)\S+ ?[\[(]at[\])] ?\S+(?: ?[\[(]dot[\])] ?\S+)+")
_IP_LIKE = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}|(?:[0-9a-fA-F]{1,4}:){4,7}[0-9a-fA-F]{1,4}")
_NUMERIC = re.compile(r"\+?[\d ().-]+")
_KEY_LIKE = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{16,}")
_HEXRUN = re.compile(r"[0-9a-fA-F]{16,}")
_IDENT_LIKE = re.compile(r"\d{3}-\d{2}-\d{4}|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?")
_ASSIGN = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?[^\s\"']{6,}[\"']?")
FEATURES = 37


def segment_features(span: str, before: str, n_tokens: int) -> list[int]:
    """Indexes of the active features of a whole candidate span; before is the text just ahead of it."""
    digits = sum(c.isdigit() for c in span)
    out = [0, min(n_tokens, 5)]
    on = lambda i, yes: out.append(i) if yes else None
    on(6, _MAIL_LIKE.fullmatch(span))
    spelled = _AT_MARK.search(span) and _AT_LIKE.fullmatch(span)
    on(7, spelled)
    on(8, _IP_LIKE.fullmatch(span))
    numeric = bool(_NUMERIC.fullmatch(span)) and digits > 0
    on(9, numeric and span[0] == "+" and 9 <= digits <= 15)
    on(10, numeric and span[0] != "+" and 7 <= digits <= 12)
    plain = re.sub(r"[ -]", "", span)
    card = numeric and plain.isdigit() and 13 <= digits <= 19
    on(11, card and luhn(plain) if plain.isascii() else False)
    on(12, card and not (plain.isascii() and luhn(plain)))
    on(13, _KEY_LIKE.fullmatch(span))
    on(14, _HEXRUN.fullmatch(span) and digits >= 4 and not numeric)
    ident = _IDENT_LIKE.fullmatch(span)
    on(15, ident)
    if ident or spelled:  # else the first groups alone would score as much
        out += range(33, 33 + min(n_tokens, 9) - 5)
    assign, cue = _ASSIGN.fullmatch(span), _SECRET_CUE.search(before)
    on(16, assign)
    on(17, cue)
    on(18, _IDENT_CUE.search(before))
    on(19, digits == 0)
    on(20, 1 <= digits <= 4)
    on(21, digits >= 5)
    on(22, "(" in span and ")" in span and numeric)
    on(23, span[:1].isalpha() and span.isalpha())
    on(24, span.count("@") == 1 and n_tokens == 1)
    on(25, "://" in span or "/" in span)
    on(26, span[-1:] in ".,;:")
    on(27, bool(re.search(r"[^0-9a-fA-F]", span)) and len(span) >= 16 and digits >= 3 and n_tokens == 1 and span.isalnum())
    on(28, numeric and digits < 7)
    on(29, n_tokens > 1 and not numeric)
    if digits == 0 and (assign or cue):
        on(30, assign and "=" in span)
        on(31, n_tokens <= 3 and len(_SPLIT.split(span.strip("\"'"))[-1]) >= 10)
        on(32, assign)
    return out


def islands(text: str) -> list[list[tuple[int, int]]]:
    """Runs of token spans around trigger tokens; an entity never reaches beyond its island."""
    marks, done = [], 0
    for m in _TRIGGER.finditer(text):
        if m.start() >= done:
            start = m.start()
            while start > done and not text[start - 1].isspace():
                start -= 1
            stop = _SPACE.search(text, m.end())
            done = stop.start() if stop else len(text)
            marks.append((start, done))
    groups: list[list[tuple[int, int]]] = []
    for start, end in marks:
        # tokens to the left and right that a segment holding this trigger can reach
        left, at = [], start
        while len(left) < MAX_SEGMENT - 1:
            stop = at
            while stop and text[stop - 1] != "\n" and text[stop - 1].isspace():
                stop -= 1
            if not stop or text[stop - 1] == "\n":  # no entity has a line feed
                break
            at = stop
            while at and not text[at - 1].isspace():
                at -= 1
            left.append((at, stop))
        left.reverse()
        line = text.find("\n", end)
        right = [m.span() for m in islice(_TOKEN.finditer(text, end, line if line >= 0 else len(text)), MAX_SEGMENT - 1)]
        tokens = [*left, (start, end), *right]
        if groups and tokens[0][0] <= groups[-1][-1][1]:
            last = groups[-1][-1][0]
            groups[-1] += [t for t in tokens if t[0] > last]
        else:
            groups.append(tokens)
    return groups


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(first token, end token, start, end, features) of every segment of an island that may be an entity."""
    out = []
    hot = [bool(_TRIGGER.search(text[s:e])) for s, e in tokens]
    cued = [bool(_SECRET_CUE.search(text[max(0, s - 24) : s])) for s, _ in tokens]
    for i in range(len(tokens)):
        for j in range(i + 1, min(len(tokens), i + MAX_SEGMENT) + 1):
            if not (any(hot[i:j]) or cued[i]) or "\n" in text[tokens[i][0] : tokens[j - 1][1]]:
                continue
            start, end = tokens[i][0], tokens[j - 1][1]
            while end > start and text[end - 1] in _EDGE and not (text[end - 1] == '"' and "=" in text[start:end]):
                end -= 1
            while start < end and text[start] in _EDGE and not (text[start] == "(" and ")" in text[start:end]):
                start += 1
            if end > start:
                out.append((i, j, start, end, segment_features(text[start:end], text[max(0, start - 24) : start], j - i)))
    return out


def viterbi(n: int, segments: list, scores: np.ndarray) -> list[tuple[int, int, int]]:
    """The best labelling of n tokens: (kind, start, end) of its entities. scores: segments by kinds."""
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    ends: dict[int, list[int]] = {}
    for k, s in enumerate(segments):
        ends.setdefault(s[1], []).append(k)
    for j in range(1, n + 1):
        best[j] = best[j - 1]  # an unlabelled token scores 0
        for k in ends.get(j, ()):
            kind = int(scores[k].argmax())
            total = best[segments[k][0]] + float(scores[k, kind])
            if total > best[j]:
                best[j], back[j] = total, (k, kind)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            k, kind = back[j]
            out.append((kind, segments[k][2], segments[k][3]))
            j = segments[k][0]
    return out[::-1]


def _example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated sentence with its entities."""
    word = lambda: "".join(rng.choice("abdeghinorstu") for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    def card() -> str:
        head = "4" + num(14)
        return next(head + d for d in "0123456789" if luhn(head + d))

    def entity() -> tuple[int, str]:
        kind = rng.randrange(6)
        if kind == 0:
            return 0, rng.choice([f"{word()}.{num(2)}@{word()}{rng.randint(0, 9)}.com", f"{word()}@{word()}.org", f"{word()} [at] {word()}{num(1)} [dot] com", f"{word()} {rng.choice(('[at]', '(at)'))} {word()} {rng.choice(('[dot]', '(dot)'))} com", f"{word()} [at] {word()} [dot] {word()}{num(1)} [dot] com", f"{word()}ü{num(1)}@{word()}.de"])
        if kind == 1:
            return 1, rng.choice([".".join(str(rng.randint(0, 255)) for _ in range(4)), ":".join(f"{rng.randrange(16, 65536):x}" for _ in range(8))])
        if kind == 2:
            c = card()
            return 2, rng.choice([c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4))])
        if kind == 3:
            return 3, rng.choice([f"+1 ({num(3)}) 555-{num(4)}", f"+{num(2)} {num(3)} {num(7)}", f"({num(3)}) {num(3)}-{num(4)}"])
        if kind == 4:
            h = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(18, 40)))
            key = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
            return 4, rng.choice([f"password={h}", f'token = "{h}"', key, f"api_key: {h}", f"ghp_{h}{h}", f"password={word()}{word()}{word()}", f"api_key: {letters(20)}", f"token = {letters(16)}", f"ghp_{letters(30)}"])
        return 5, rng.choice([f"{num(3)}-{num(2)}-{num(4)}", f"GB{num(2)} ABCD {num(4)} {num(4)} {num(4)}", f"GB{num(2)} ABCD {num(4)} {num(4)} {num(4)} {num(2)}", f"DE{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", f"FR{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(4)} {num(3)}", " ".join([f"MT{num(2)}", *(num(4) for _ in range(rng.randint(6, 7))), num(rng.randint(1, 3))])])

    def plain() -> str:
        return rng.choice([word(), word(), word() + ",", word().title(), f"{rng.choice(('secret', 'token', 'password', 'Secret:', 'tokens'))} {word()}", num(rng.randint(1, 4)), f"{word()}.{num(1)}", f"v{num(1)}.{num(1)}", f"https://{word()}.com/{num(3)}", f"{num(1)}.{num(1)}.", num(rng.randint(13, 16)) if rng.random() < 0.2 else word(), f"CC-{num(1)}.0", f"{num(4)}-{num(2)}-{num(2)}"])

    text, found = "", []
    for _ in range(rng.randint(6, 14)):
        if text:
            text += " "
        if rng.random() < 0.2:
            kind, span = entity()
            found.append((kind, len(text), len(text) + len(span)))
            text += span + rng.choice(["", "", ",", "."])
        else:
            text += plain()
    return text, found


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    """Weights, kinds by features: gradient ascent on the conditional log-likelihood of 160 generated sentences."""
    rng = random.Random(11)
    w = np.zeros((len(KINDS), FEATURES))
    cases, rows = [], []
    for _ in range(160):
        text, gold = _example(rng)
        for tokens in islands(text):
            segs = candidates(text, tokens)
            if segs:
                right = {(g[1], g[2]): g[0] for g in gold}
                cases.append((len(tokens), segs, len(rows), [right.get((s[2], s[3]), -1) for s in segs]))
                rows += [s[4] for s in segs]
    x = np.zeros((len(rows), FEATURES))
    for i, row in enumerate(rows):
        x[i, row] = 1
    moment = np.zeros_like(w)
    for _ in range(80):
        scores = x @ w.T
        total = np.logaddexp.reduce(scores, 1)
        want = np.zeros_like(scores)
        for n, segs, at, gold in cases:
            alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            alpha[0] = beta[n] = 0.0
            ends: dict[int, list[int]] = {}
            heads: dict[int, list[int]] = {}
            for k, s in enumerate(segs):
                ends.setdefault(s[1], []).append(k)
                heads.setdefault(s[0], []).append(k)
            for j in range(1, n + 1):
                alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[segs[k][0]] + total[at + k] for k in ends.get(j, ()))])
            for j in range(n - 1, -1, -1):
                beta[j] = np.logaddexp.reduce([beta[j + 1], *(beta[segs[k][1]] + total[at + k] for k in heads.get(j, ()))])
            for k, s in enumerate(segs):
                p = np.exp(alpha[s[0]] + total[at + k] + beta[s[1]] - alpha[n])
                want[at + k] -= p * np.exp(scores[at + k] - total[at + k])
                if gold[k] >= 0:
                    want[at + k, gold[k]] += 1
        grad = want.T @ x / len(cases) - 1e-3 * w
        moment = 0.8 * moment + grad
        w = w + 1.5 * moment
    return w


def crf_spans(text: str, w: np.ndarray) -> list[tuple[int, int, int]]:
    out = []
    for tokens in islands(text):
        segs = candidates(text, tokens)
        if segs:
            x = np.zeros((len(segs), FEATURES))
            for i, s in enumerate(segs):
                x[i, s[4]] = 1
            out += viterbi(len(tokens), segs, x @ w.T)
    return out


def find(text: str | None, w: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: the base ones and those of the field that touch none of them."""
    if not text:
        return [], []
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    extra = []
    if _TRIGGER.search(text):
        tops, high = [], -1  # running maximum of ends, as spans of different kinds may overlap
        for _, e in taken:
            high = max(high, e)
            tops.append(high)
        starts = [s for s, _ in taken]
        for kind, s, e in crf_spans(text, w):
            at = bisect_left(starts, e)
            if at == 0 or tops[at - 1] <= s:
                extra.append((kind, s, e))
    return base, sorted(base + extra)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or chain of overlapping spans, replaced by the kind of its first in brackets."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame) -> DataFrame:
    """Per row: counts and digest of the base spans, and all spans as kind:start:end, ordered by kind and start."""
    w = weights()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for text in batch.column("text").to_pylist():
            base, every = find(text, w)
            for k in range(4):
                cols[k].append(sum(b[0] == k for b in base))
            cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols[5].append(joined(every))
        return batch_of(SCHEMA, [batch.column("doc_id"), *cols])

    return map_rows(docs.select("doc_id", "text"), run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, with personal data in text replaced by <KIND> and n_chars counted anew. Null stays null."""
    w, names, small = weights(), docs.columns, docs.schema

    def run(batches):
        for batch in short(batches):
            texts = [t if not t else masked(t, find(t, w)[1]) for t in batch.column("text").to_pylist()]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return bounded(docs).mapInArrow(run, small)
