"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments (shape, digit count, check sum, punctuation, neighbours) and
sums over all segmentations of a window; an entity has at most MOST_ATOMS atoms, so training and
decoding take time in proportion to the window.  A window is a run of chunks with a digit or an @; outside
windows no segment can be an entity, so decoding them alone is exact.  The model is trained here on the base spans of
a bounded sample and on variants of them that the patterns don't match (no country code, other separators, bracketed signs).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import texts, written

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training sample: documents read, and windows of each kind taken from them.
TRAIN_DOCUMENTS, TRAIN_WINDOWS = 2_000, 20
#: Atoms and characters of an added span at most; base spans have no such bound.
MOST_ATOMS, MOST_CHARS = 16, 320
EPOCHS, RATE, DECAY = 6, 0.3, 1e-3
#: A decoded span counts if its log odds against leaving it out are at least this.
MARGIN = 1.0

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit inside a run of digits can't begin a match that the run's first digit didn't.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WINDOW = re.compile(r"(?<!\S)(?:[^\s0-9@]*[0-9@]\S*)(?:[ \t]{1,2}[^\s0-9@]*[0-9@]\S*)*")
_WANTED = re.compile("[0-9]{2}|@")
_BRACKETED = re.compile(r"[\[({]([@.])[\])}]")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|\s|[^\s]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, each kind leftmost and without overlaps; in time linear in the text."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def windows(text: str) -> Iterator[tuple[int, str]]:
    for m in _WINDOW.finditer(text):
        yield m.start(), m[0]


def atoms(window: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ATOM.finditer(window)]


def _shape(segment: str) -> str:
    runs = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", re.sub(r"[^\W\d_]+", "a", segment))
    return runs if len(runs) <= 40 else runs[:40] + "~"


def features(window: str, start: int, end: int) -> list[str]:
    """Features of the whole segment; each has a weight for each kind."""
    segment = window[start:end]
    digits = [c for c in segment if "0" <= c <= "9"]
    before, after = window[start - 1 : start] or "^", window[end : end + 1] or "$"
    side = lambda c: "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c
    n = len(digits)
    own = [
        "bias",
        f"digits{min(n, 20)}",
        f"at{min(segment.count('@'), 2)}dots{min(segment.count('.'), 4)}",
        f"shape{_shape(segment)}",
        f"loose{re.sub('9[0-9]+', '9', _shape(segment))}",
        f"edge{side(before)}{side(segment[0])}|{side(segment[-1])}{side(after)}",
        f"begin{side(before)}",
        f"end{side(after)}",
        f"plus{segment[0] == '+'}",
    ]
    opened = _BRACKETED.sub(r"\1", segment)
    if "@" in opened:
        own.append(f"mail{bool(_MAIL.fullmatch(opened))}")
    elif n >= 4 and not any(c.isalpha() for c in segment):
        own.append(f"groups{'-'.join(str(len(g)) for g in re.findall('[0-9]+', segment)[:8])}")
    if 12 <= n <= 19 and not any(c.isalpha() for c in segment):
        own.append(f"luhn{luhn(''.join(digits))}")
    if segment.count(".") == 3 and n >= 4 and not any(c.isalpha() for c in segment):
        parts = [re.sub("[^0-9]", "", p) for p in segment.split(".")]
        own.append(f"bytes{all(p and len(p) <= 3 and int(p) <= 255 for p in parts)}")
    return own


def candidates(window: str, marks: list[tuple[int, int]]) -> Iterator[tuple[int, list[tuple[int, list[str]]]]]:
    """From left to right each end with the starts and features of the segments that end there; only
    segments with two digits or an @ that begin and end outside white space can be entities.  No more than the features of
    one end, MOST_ATOMS segments, are alive at once."""
    for j in range(1, len(marks) + 1):
        b = marks[j - 1][1]
        if window[b - 1].isspace():
            continue
        found = []
        for i in range(j - 1, max(-1, j - 1 - MOST_ATOMS), -1):
            a = marks[i][0]
            if b - a > MOST_CHARS:
                break
            if b - a >= 5 and not window[a].isspace() and _WANTED.search(window, a, b):
                found.append((i, features(window, a, b)))
        if found:
            yield j, found[::-1]


def _sums(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def fit(examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS) -> dict[str, float]:
    """Weights that maximise the likelihood of the labelled segmentations (AdaGrad on the exact gradient).

    An atom outside entities scores 0, so an entity's score is its log odds against being left out."""
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-6)
    ready = []
    for window, spans in examples:
        marks = atoms(window)
        starts, ends = {a: i for i, (a, _) in enumerate(marks)}, {b: i + 1 for i, (_, b) in enumerate(marks)}
        gold = {(starts[a], ends[b], KINDS.index(k)) for k, a, b in spans if a in starts and b in ends and ends[b] - starts[a] <= MOST_ATOMS}
        table = {j: [(i, [[f"{kind}:{f}" for f in fs] for kind in KINDS]) for i, fs in segs] for j, segs in candidates(window, marks)}
        ready.append((len(marks), table, gold))
    for _ in range(epochs):
        for n, table, gold in ready:
            score = {(i, j, y): sum(weights.get(f, 0.0) for f in fs) for j, segs in table.items() for i, kinds in segs for y, fs in enumerate(kinds)}
            alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
            into, out = defaultdict(list), defaultdict(list)
            for (i, j, _), s in score.items():
                into[j].append((i, s))
                out[i].append((j, s))
            for j in range(1, n + 1):
                alpha[j] = _sums([alpha[j - 1], *(alpha[i] + s for i, s in into[j])])
            for i in range(n - 1, -1, -1):
                beta[i] = _sums([beta[i + 1], *(beta[j] + s for j, s in out[i])])
            gradient: dict[str, float] = defaultdict(float)
            for j, segs in table.items():
                for i, kinds in segs:
                    for y, fs in enumerate(kinds):
                        g = ((i, j, y) in gold) - math.exp(alpha[i] + score[i, j, y] + beta[j] - alpha[n])
                        if abs(g) > 1e-4:
                            for f in fs:
                                gradient[f] += g
            for f, g in gradient.items():
                g -= DECAY * weights[f]
                squares[f] += g * g
                weights[f] += RATE * g / math.sqrt(squares[f])
    return {f: round(w, 6) for f, w in weights.items() if abs(w) > 1e-3}


Weights = dict[str, tuple[float, ...]]


def by_feature(weights: dict[str, float]) -> Weights:
    """The weights of a feature for all kinds."""
    names = {f.partition(":")[2] for f in weights}
    return {f: tuple(weights.get(f"{kind}:{f}", 0.0) for kind in KINDS) for f in names}


def decode(window: str, weights: Weights, margin: float = MARGIN) -> list[tuple[str, int, int]]:
    """The best joint choice of boundaries and kinds.  Memory besides the window: three words for each of its atoms."""
    marks = atoms(window)
    best, back = [0.0] * (len(marks) + 1), [None] * (len(marks) + 1)
    done = 0
    for j, segments in candidates(window, marks):
        for k in range(done + 1, j + 1):
            best[k] = best[k - 1]
        done = j
        for i, fs in segments:
            sums = [0.0] * len(KINDS)
            for f in fs:
                if (w := weights.get(f)) is not None:
                    sums = [a + b for a, b in zip(sums, w, strict=True)]
            top = max(sums)
            if top >= margin and best[i] + top > best[j]:
                best[j], back[j] = best[i] + top, (i, KINDS[sums.index(top)])
    out, j = [], len(marks)
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((kind, marks[i][0], marks[j - 1][1]))
            j = i
    return out[::-1]


def other_forms(kind: str, span: str) -> list[str]:
    """A base span as people also write it, so that the patterns don't match it."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        return [span.replace("@", at) for at in ("[@]", "(@)", "{@}")]
    if kind == "ip":
        return [span.replace(".", dot) for dot in ("[.]", "(.)")]
    if kind == "card":
        return [sign.join(digits[k : k + 4] for k in range(0, len(digits), 4)) for sign in (".", "_", " - ", "/")]
    if len(digits) < 10:
        return []
    area, office, line = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({area}) {office}-{line}", *(sign.join((area, office, line)) for sign in ("-", ".", " ", "/"))]


def near_miss(kind: str, span: str) -> list[str]:
    """Texts like those of other_forms() that are no such entity: with a broken check sum, a part too large, a digit short."""
    if kind == "card":
        return [form[:-1] + str((int(form[-1]) + 1) % 10) for form in other_forms(kind, span) if form[-1].isdigit()]
    if kind == "ip":
        return [form.replace(span.split(".")[1], "777", 1) for form in other_forms(kind, span)]
    if kind == "phone":
        return [form[:-2] for form in other_forms(kind, span)]
    return [form.replace("@", "", 1) for form in other_forms(kind, span)]


#: Numbers that are no personal data, each form with digits of its own.
PLAIN = ("9999-99-99", "99/99/9999", "99:99:99", "9.9.9", "9,999.99", "999-9-99-999999-9", "9999-9999", "99999", "9999999", "99 999 999", "#9999", "v9.99", "9e-9", "99.9%", "@9", "9@99")


def variants(window: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """The window; and for each of its spans other forms and near misses of it, in its place, alone, and beside a sign."""
    yield window, spans
    for kind, a, b in spans:
        apart = [(k, x, y) for k, x, y in spans if (x, y) != (a, b)]
        for texts_, found in ((other_forms(kind, window[a:b]), True), (near_miss(kind, window[a:b]), False)):
            for n, form in enumerate(texts_):
                moved = [(k, x + len(form) - (b - a), y + len(form) - (b - a)) if x >= b else (k, x, y) for k, x, y in apart]
                yield window[:a] + form + window[b:], [*moved, *([(kind, a, a + len(form))] if found else [])]
                before, after = (("", ""), ("", ","), ("", "."), ('"', '"'), ("(", ")"), (":", ";"))[n % 6]
                yield before + form + after, [(kind, len(before), len(before) + len(form))] if found else []


def sample(docs: DataFrame, documents: int = TRAIN_DOCUMENTS, most: int = TRAIN_WINDOWS) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Training windows with their base spans, and variants of them: `most` windows of each kind of span, of several kinds and of none,
    from about `documents` documents chosen by the hash of doc_id (a filter: no task gathers candidates).  Each window has a shape of
    its own, so that rare forms are among them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {w: "+".join(sorted({k for k, *_ in base_spans(w)})) for t in batch["text"] for _, w in windows(t) if len(w) <= 200}
            yield pd.DataFrame(found.items(), columns=["w", "kind"])

    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(max(docs.count(), 1))) < documents
    wordy = docs.filter(F.col("text").rlike("[0-9@]") & chosen)
    shape = F.regexp_replace(F.regexp_replace("w", "[0-9]", "9"), r"\p{L}+", "a")
    shaped = wordy.select("text").mapInPandas(run, "w string, kind string").groupBy("kind", shape.alias("shape")).agg(F.min("w").alias("w"))
    shaped = written(shaped, "pii-windows")
    found = set()
    for stratum in (*(F.col("kind") == k for k in KINDS), F.col("kind") == "", F.col("kind").contains("+")):
        found.update(r.w for r in shaped.filter(stratum).orderBy(F.md5("shape")).limit(most).collect())
    out = []
    for w in sorted(found):
        spans: list[tuple[str, int, int]] = []
        for s in base_spans(w):
            if all(s[2] <= a or s[1] >= b for _, a, b in spans):
                spans.append(s)
        out += variants(w, spans)
    digits = "".join(c for w in sorted(found) for c in w if c.isdigit()) or "0"
    fill = iter(digits[k % len(digits)] for k in range(10_000))
    return out + [(re.sub("9", lambda _: next(fill), form), []) for form in PLAIN for _ in range(4) if found]


def find_pii(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base (joined) and spans (joined, base and added).

    Positions are code points, ends exclusive.  Null and empty texts have no spans; repeated rows are
    searched each; other columns are not read; an empty table gives an empty result.  Added spans never
    touch a base span.  Without `weights` the field is trained on a bounded sample of docs; without a window
    in the sample it adds nothing."""
    docs = texts(docs)
    if weights is None:
        weights = fit(sample(docs))
    shared = docs.sparkSession.sparkContext.broadcast(by_feature(weights))
    wanted = re.compile("[0-9@]")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        known: dict[str, list[tuple[str, int, int]]] = {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if not wanted.search(text):
                    rows.append((doc_id, 0, 0, 0, 0, "", ""))
                    continue
                base = base_spans(text)
                spans, taken = list(base), sorted((a, b) for _, a, b in base)
                reach = list(accumulate((b for _, b in taken), max))  # the furthest end up to each base span
                for at, window in windows(text):
                    if len(window) > 400 or window not in known:
                        got = decode(window, weights)
                        if len(window) <= 400 and len(known) < 50_000:
                            known[window] = got
                    else:
                        got = known[window]
                    for kind, a, b in got:
                        a, b = a + at, b + at
                        before = bisect_left(taken, (b,))
                        if not before or reach[before - 1] <= a:
                            spans.append((kind, a, b))
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                count = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((doc_id, *count, joined(base), joined(spans)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return docs.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
