"""Operator 13: personal data by patterns and a semi-Markov conditional random field.

Four patterns give base spans (addresses of mail and machines, cards, telephones), which always stay.  The method
adds spans that the patterns miss: "name [at] host [dot] com", numbers without a plus, other separators.  Texts are
cut into tokens (runs of letters and digits, single other characters); a region is a run of words that hold a digit
or an at sign, or spell one ("at", "dot").  Everywhere else no segment can stand, so that decoding regions one by
one is decoding the text.  Within a region every segment of up to LONGEST tokens is a candidate of each type, scored by
features of the whole span (digit groups, separators, check digit, what stands before and after); dynamic programming
over the tokens finds the best sequence of segments and single outside tokens, so that boundaries and types are
chosen together.  Tokens of base spans are settled and take no part in it.

The weights are trained here by conditional likelihood (forward and backward sums over all segmentations) from at
most REGIONS regions with base spans and as many without, of at most SAMPLE_DOCS documents, those of the least
hashes.  Base spans are the labels; each region is also shown with its spans respelled, and with numbers that are no
personal data (dates, times, versions, amounts, identifiers) in their place.  Without labelled regions nothing is added.

Nulls count as empty texts and have no spans; a repeated row or text has the spans of each.  Positions are code
points, ends exclusive.  Work grows linearly with a text, whatever repeats in it.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.llm.common import own_name, table

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment at most; a segment beyond that is no candidate (base spans have no such bound).
LONGEST = 28
#: Bounds of the training sample: documents looked at, regions with and without base spans.
SAMPLE_DOCS, REGIONS = 2000, 200
VARIANTS, EPOCHS, RATE, RIDGE = 6, 10, 0.5, 1e-4
#: Of an added segment the probability must be at least this.
LEAST = 0.9

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
SPELLED = re.compile(rf"{OPEN}?(?:at|dot){CLOSE}?", re.IGNORECASE)
#: Where a region can be: digits and at signs with the rest of the word, "at" and "dot" in brackets, "at" before a domain.
SEEDS = re.compile(rf"[0-9@]\S*+|{OPEN}(?:at|dot){CLOSE}|(?<!\S)at\s++[a-z0-9-]++(?:\.[a-z0-9]|\s++{OPEN}?dot{CLOSE}?(?!\S))", re.IGNORECASE)
#: The same for Spark's filter: texts without it have no spans.
SEED = rf"[0-9@]|(?i:{OPEN}(at|dot){CLOSE}|\bat\s+[a-z0-9-]+(\.[a-z0-9]|\s+{OPEN}?dot\b))"
NEXT = re.compile(r"\s*\S*")
FOLLOWING = re.compile(rf"(?:\s+{OPEN}?(?:at|dot){CLOSE}?\s+\S+)*", re.IGNORECASE)
TOKEN = re.compile(r"[^\W_]+|\s+|[\W_]")
CUES = {
    "email": {"mail", "email", "e-mail", "contact", "courriel", "correo"},
    "ip": {"ip", "host", "server", "address", "adresse"},
    "card": {"card", "visa", "mastercard", "karte", "carte", "tarjeta", "credit"},
    "phone": {"tel", "phone", "call", "mobile", "cell", "fax", "telefon", "telephone", "telefono"},
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of all matches of the patterns, in order."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        # the local part is the whole run before the sign, as far as an earlier address left it
        first = at
        while first > free and LOCAL.match(text, first - 1):
            first -= 1
        m = DOMAIN.match(text, at + 1) if first < at else None
        if m:
            free = m.end()
            out.append((first, 0, free))
        else:
            free = at + 1  # no address holds or crosses this sign
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[ -]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of words around seeds; words beside a spelled sign belong to them, and so do lone signs between two such words."""
    held = (-9, -9)
    for m in SEEDS.finditer(text):
        lo, hi = m.span()
        if hi <= held[1]:
            continue
        lo = max(lo, held[1])
        while lo > held[1] and lo and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        words = text[lo : lo + 9].split(None, 1), text[max(lo, hi - 9) : hi].rsplit(None, 1)
        if SPELLED.fullmatch(words[0][0]):
            while lo > held[1] and lo and text[lo - 1].isspace():
                lo -= 1
            while lo > held[1] and lo and not text[lo - 1].isspace():
                lo -= 1
        if SPELLED.fullmatch(words[1][-1]):
            hi = NEXT.match(text, hi).end()
        hi = FOLLOWING.match(text, hi).end()
        gap = text[held[1] : lo] if lo - held[1] <= 5 else "gap"
        if held[1] >= 0 and not any(c.isalnum() or c == "\n" for c in gap):
            held = held[0], hi
        else:
            if held[1] >= 0:
                yield held
            held = lo, hi
    if held[1] >= 0:
        yield held


NAMES = [
    "bias", "length", "digits 0", "digits 1-6", "digits 7-8", "digits 9-11", "digits 12-15", "digits 16-19", "digits 20+", "plus first", "at sign", "spelled at", "spelled dot", "bracketed word",
    "letters", "no letters", "letters joined to digits", "last token like a top domain", "four groups up to 255", "other groups", "one group", "two or three groups", "check digit holds", "check digit fails",
    "dots", "hyphens", "blanks", "odd signs", "slash or colon", "brackets balance", "brackets do not", "groups of four", "three digits then four", "leading zero group", "left sign", "right sign", "ends in a bracket",
    "year first", "cue email", "cue ip", "cue card", "cue phone", "wide blank", "plain words",
]
PLACE = {n: i for i, n in enumerate(NAMES)}
SIGNS = {".": "dots", "-": "hyphens", "@": "at sign", "/": "slash or colon", ":": "slash or colon", " ": "blanks", "\u00a0": "blanks"}


def tokens_of(text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text, lo, hi)]


def _digit_features(f: list[float], groups: list[str], digits: str, letters: int) -> None:
    """What the groups of digits of a span look like."""
    d = len(digits)
    sizes = ((0, "digits 0"), (6, "digits 1-6"), (8, "digits 7-8"), (11, "digits 9-11"), (15, "digits 12-15"), (19, "digits 16-19"), (d, "digits 20+"))
    f[PLACE[next(name for most, name in sizes if d <= most)]] = 1.0
    if letters:
        return
    four = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    f[PLACE["four groups up to 255" if four else "one group" if len(groups) == 1 else "two or three groups" if len(groups) < 4 else "other groups"]] = 1.0
    f[PLACE["groups of four"]] = float(len(groups) > 1 and all(len(g) == 4 for g in groups))
    f[PLACE["three digits then four"]] = float(len(groups) > 1 and len(groups[-1]) == 4 and len(groups[-2]) == 3)
    f[PLACE["leading zero group"]] = float(any(len(g) > 1 and g[0] == "0" for g in groups))
    f[PLACE["year first"]] = float(d == 8 and groups[0][:2] in ("19", "20"))
    if 12 <= d <= 19:
        f[PLACE["check digit holds" if luhn(digits) else "check digit fails"]] = 1.0


def candidates(text: str, toks: list[tuple[int, int, str]], taken: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """All segments (first token, token after the last) that may be an entity, and a row of features for each.

    A segment begins at a word, "+" or "(", ends at a word or ")", holds a digit or a written or spelled at sign, no
    white space but one or two blanks at a time, and touches no span of `taken`.
    """
    free, at = [], 0
    for lo, hi, _ in toks:  # both in order of their starts
        while at < len(taken) and taken[at][1] <= lo:
            at += 1
        free.append(not any(a < hi and lo < b for a, b in taken[at : at + 4]))
    out, rows = [], []
    for i, (lo, _, first) in enumerate(toks):
        if not free[i] or not (first[0].isalnum() or first in "+("):
            continue
        cue = re.findall(r"[^\W\d_]+", text[max(0, lo - 24) : lo].lower())[-2:]
        start = [0.0] * len(NAMES)
        start[0] = 1.0
        start[PLACE["plus first"]] = float(first == "+")
        start[PLACE["left sign"]] = float(lo > 0 and not text[lo - 1].isalnum() and not text[lo - 1].isspace())
        for kind in KINDS:
            start[PLACE[f"cue {kind}"]] = float(any(w in CUES[kind] for w in cue))
        digits, groups, letters, joined, depth, ok, wide, plain = "", [], 0, 0, 0, True, 0, 0
        seen = dict.fromkeys((*SIGNS.values(), "odd signs", "spelled at", "spelled dot", "bracketed word"), 0)
        for j in range(i, min(len(toks), i + LONGEST)):
            a, b, t = toks[j]
            c, blank = t[0], t.isspace()
            if not free[j] or blank and (len(t) > 2 or t.strip(" \u00a0")):
                break
            if blank:
                seen["blanks"] += 1
                wide += len(t) > 1
            elif c.isalnum():
                own = re.sub("[^0-9]", "", t)
                digits += own
                if own and len(own) == len(t):
                    groups.append(t)
                else:
                    letters += 1
                    joined += bool(own)
                    word = t.lower()
                    if j > i and word in ("at", "dot"):
                        seen[f"spelled {word}"] += 1
                        seen["bracketed word"] += text[a - 1] in "[({<"
                    elif j > i and toks[j - 1][2].isspace() and toks[j - 2][2].lower() not in ("at", "dot", "]", ")", "}", ">", "@", "."):
                        plain += 1
            else:
                depth += (c in "([{<") - (c in ")]}>")
                ok = ok and depth >= 0
                if c in SIGNS:
                    seen[SIGNS[c]] += 1
                elif c not in "+_%()[]{}<>":
                    seen["odd signs"] += 1
            if not (c.isalnum() or c == ")" and i < j) or not (digits or seen["at sign"] or seen["spelled at"]):
                continue
            f = start.copy()
            f[1] = (j - i + 1) / LONGEST
            for name, n in seen.items():
                f[PLACE[name]] = min(n, 3) / 3
            f[PLACE["letters" if letters else "no letters"]] = 1.0
            f[PLACE["letters joined to digits"]] = float(joined > 0)
            f[PLACE["last token like a top domain"]] = float(t.isalpha() and t.isascii() and 2 <= len(t) <= 6 and letters > 1)
            f[PLACE["brackets balance" if ok and not depth else "brackets do not"]] = 1.0
            f[PLACE["right sign"]] = float(b < len(text) and not text[b].isalnum() and not text[b].isspace() and text[b] not in ".,;!?)")
            f[PLACE["ends in a bracket"]] = float(c == ")")
            f[PLACE["wide blank"]] = float(wide > 0)
            f[PLACE["plain words"]] = min(plain, 3) / 3
            _digit_features(f, groups, digits, letters)
            out.append((i, j + 1))
            rows.append(f)
    return out, np.array(rows).reshape(-1, len(NAMES))


def by_stop(segments: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """For each boundary between tokens the (first token, number) of the segments that end there."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(segments):
        out[j].append((i, k))
    return out


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def marginals(segments: list[tuple[int, int]], score: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """log Z over all segmentations (a token outside scores 0), and each segment's probability of each type."""
    if not segments:
        return 0.0, np.zeros_like(score)
    ends = by_stop(segments, n)
    starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(segments):
        starts[i].append((j, k))
    together = np.logaddexp.reduce(score, axis=1).tolist()
    forward, back = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = _log_sum([forward[j - 1], *[forward[i] + together[k] for i, k in ends[j]]]) if ends[j] else forward[j - 1]
    for i in range(n - 1, -1, -1):
        back[i] = _log_sum([back[i + 1], *[back[j] + together[k] for j, k in starts[i]]]) if starts[i] else back[i + 1]
    outside = np.array([forward[i] + back[j] for i, j in segments])
    return forward[n], np.exp(outside[:, None] + score - forward[n])


def decode(segments: list[tuple[int, int]], score: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(number of the segment, type) of the best sequence of segments and outside tokens."""
    ends = by_stop(segments, n)
    best, came = [0.0] * (n + 1), [-1] * (n + 1)
    top = score.max(axis=1) if len(score) else score
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k in ends[j]:
            if best[i] + top[k] > best[j]:
                best[j], came[j] = best[i] + top[k], k
    out, j = [], n
    while j:
        if came[j] < 0:
            j -= 1
        else:
            out.append((came[j], int(score[came[j]].argmax())))
            j = segments[came[j]][0]
    return out[::-1]


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray, least: float = LEAST) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the decoded segments whose probability is at least `least`."""
    out, settled = [], [(a, b) for a, _, b in base]
    known = 0
    for lo, hi in regions(text):
        while known < len(settled) and settled[known][1] <= lo:
            known += 1
        inside = []
        for s in settled[known:]:
            if s[0] >= hi:
                break
            inside.append(s)
        toks = tokens_of(text, lo, hi)
        segments, f = candidates(text, toks, inside)
        if not segments:
            continue
        score = f @ weights
        chosen = decode(segments, score, len(toks))
        if chosen:
            sure = marginals(segments, score, len(toks))[1]
            out += [(toks[segments[k][0]][0], kind, toks[segments[k][1] - 1][1]) for k, kind in chosen if sure[k, kind] >= least]
    return out


# training


def respelled(kind: int, span: str, rng: random.Random) -> str:
    """A base span as people write it when no pattern is to find it."""
    pick = rng.choice
    if kind == 0:
        local, _, domain = span.partition("@")
        at, dot = pick([(" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."), (" AT ", " DOT "), ("(at)", "."), (" at ", ".")])
        return local + at + domain.replace(".", dot)
    digits = re.sub("[^0-9]", "", span)
    if kind == 1:
        return pick(["[.]", " . ", "(.)", " [.] "]).join(span.split("."))
    if kind == 2:
        return pick([".", "/", "  ", " - ", "_"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own = digits[-10:]
    return pick(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "({}){}-{}", "1-{}-{}-{}", "001 {} {} {}"]).format(own[:-7], own[-7:-4], own[-4:])


def unchecked(n: int) -> str:
    """A long number whose check digit is wrong."""
    return str(n) + next(c for c in "0123456789" if not luhn(str(n) + c))


def harmless(rng: random.Random) -> str:
    """A number that is no personal data."""
    r = rng.randrange
    kinds = [
        lambda: f"{r(1950, 2035)}-{r(1, 13):02}-{r(1, 29):02}", lambda: f"{r(1, 29):02}.{r(1, 13):02}.{r(1950, 2035)}", lambda: f"{r(24):02}:{r(60):02}:{r(60):02}", lambda: f"{r(20)}.{r(30)}.{r(99)}", lambda: f"{r(1, 999)},{r(1000):03}.{r(100):02}",
        lambda: f"{r(10**6)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 32, 40]))), lambda: f"{r(300, 10**3)}.{r(300, 999)}.{r(99)}.{r(9)}", lambda: f"{r(10**3)}-{r(10**2)}", lambda: f"{r(1900, 2030)}", lambda: f"v{r(9)}.{r(20)}",
        lambda: f"{r(1, 99)} at {r(1, 99)}", lambda: f"ISBN 978-{r(10)}-{r(100, 999)}-{r(10000, 99999)}-{r(10)}", lambda: f"{r(1900, 2030)}-{r(1900, 2030)}", lambda: " ".join(str(r(100)) for _ in range(6)), lambda: unchecked(r(10**15)), lambda: f"{r(1, 99)}%", lambda: f"#{r(10**8)}",
    ]
    return rng.choice(kinds)()


def examples(rows: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 13) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Each text as it is, and VARIANTS times with its spans respelled and with harmless numbers in their place."""
    rng, out = random.Random(seed), []
    for text, spans in rows:
        clear = [s for s in spans if not any(o != s and o[0] < s[2] and s[0] < o[2] for o in spans)]
        out.append((text, clear))
        for how in [respelled, lambda kind, span, r: None] * VARIANTS:
            new, labels, at = [], [], 0
            for a, kind, b in clear:
                new.append(text[at:a])
                word = how(kind, text[a:b], rng)
                if word:
                    start = sum(map(len, new))
                    labels.append((start, kind, start + len(word)))
                new.append(word or harmless(rng))
                at = b
            if clear:
                out.append(("".join(new) + text[at:], labels))
        out.append((f"{text[:30]} {harmless(rng)} {text[-30:]}" if not clear else f"the {harmless(rng)} and", []))
    return out


def fit(rows: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, rate: float = RATE, ridge: float = RIDGE) -> np.ndarray:
    """Weights (a row per feature, a column per type) of greatest conditional likelihood of the labelled texts, by AdaGrad steps."""
    cases = []
    for text, spans in examples(rows):
        for lo, hi in regions(text):
            toks = tokens_of(text, lo, hi)
            segments, f = candidates(text, toks, [])
            if not segments:
                continue
            seen = {(toks[i][0], toks[j - 1][1]): k for k, (i, j) in enumerate(segments)}
            gold = [(seen.get((a, b)), kind) for a, kind, b in spans if lo <= a and b <= hi]
            if all(k is not None for k, _ in gold):
                cases.append((segments, f, len(toks), gold))
    weights = np.zeros((len(NAMES), len(KINDS)))
    weights[PLACE["bias"]] = -3.0
    past, rng = np.full_like(weights, 1e-6), random.Random(1)
    for _ in range(epochs if any(gold for *_, gold in cases) else 0):
        rng.shuffle(cases)
        for at in range(0, len(cases), 8):
            step = -ridge * weights
            for segments, f, n, gold in cases[at : at + 8]:
                expected = marginals(segments, f @ weights, n)[1]
                observed = np.zeros_like(expected)
                for k, kind in gold:
                    observed[k, kind] += 1
                step += f.T @ (observed - expected)
            past += step**2
            weights += rate * step / np.sqrt(past)
    if not any(gold for *_, gold in cases):
        weights[PLACE["bias"]] = -1e9
    return weights


def training_regions(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, most: int = REGIONS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most `most` regions with base spans and as many without, with the words around, of documents of the least hashes."""
    h = F.xxhash64(F.substring(text_col, 1, 4096))
    seeded = docs.where(F.col(text_col).rlike(SEED)).select(h.alias("h"))
    last = seeded.distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    if last is None:
        return []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, bool]] = []
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                at = 0
                for lo, hi in regions(text):
                    if hi - lo > 400:
                        continue
                    while at < len(base) and base[at][2] <= lo:
                        at += 1
                    around = text[max(0, lo - 40) : lo], text[hi : hi + 40]
                    # whole words only
                    left, right = re.sub(r"^\S*\s?", "", around[0]), re.sub(r"\s?\S*$", "", around[1])
                    found.append((left + text[lo:hi] + right, at < len(base) and base[at][0] < hi))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.bool_()))], ["region", "has"])

    cuts = docs.where(F.col(text_col).rlike(SEED) & (h <= last)).select(text_col).mapInArrow(cut, "region string, has boolean").distinct()
    rows = [r["region"] for has in (True, False) for r in cuts.where(F.col("has") == has).orderBy(F.xxhash64("region"), "region").limit(most).collect()]
    return [(t, base_spans(t)) for t in rows]


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    return fit(training_regions(docs, text_col))


SPANS = "array<struct<start:int,kind:int,stop:int>>"


def find_pii(docs: DataFrame, weights: np.ndarray, least: float = LEAST, text_col: str = "text", names: tuple[str, str] = ("base_spans", "added_spans")) -> DataFrame:
    """docs with base_spans and added_spans (or other names): arrays of (start, kind, stop) in order; kind is a place in KINDS.

    Texts without a digit, an at sign or a spelled "dot" have none and don't go to Python.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))

    @F.arrow_udf(f"struct<base:{SPANS},added:{SPANS}>")
    def found(texts: pa.Array) -> pa.Array:
        both: list[list] = [[], []]
        for t in texts:
            text = t.as_py() or ""
            base = base_spans(text)
            more = added_spans(text, base, weights, least)
            for out, spans in zip(both, (base, more)):
                out.append([{"start": a, "kind": k, "stop": b} for a, k, b in spans])
        return pa.StructArray.from_arrays([pa.array(x, kind) for x in both], ["base", "added"])

    own = own_name(docs, "_found")
    seeded = docs.withColumn(own, found(F.when(F.col(text_col).rlike(SEED), F.col(text_col))))
    return seeded.withColumns({names[0]: F.col(f"{own}.base"), names[1]: F.col(f"{own}.added")}).drop(own)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op13_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_pii(docs, train(docs))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base_spans", "added_spans"))).alias("spans"),
        F.size("added_spans").cast("long").alias("n_added"),
    )
