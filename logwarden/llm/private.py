"""Personal data by a skip-chain conditional random field over the words of a document.

Patterns find what is written plainly (the base spans).  The field finds the same kinds in other notations: a phone number
without its plus sign, a defanged address, a mail address that is spelled out.  Its variables are labels of words:

* a word's own potentials come from its shape, its counts, checks (Luhn, octets) and its neighbours,
* chain potentials join neighbouring words,
* skip potentials join distant words that are repeated or similar (equal without marks, or in their last seven digits), so
  that a label found in one place counts in the others.

Words that touch a base span are observed.  Loopy message passing goes over all words of a document at once until messages
stand still; a word belongs to a kind if its marginal probability reaches ``SURE``.

Only words with a digit or an at sign, and those near them, can be part of any kind; all others are observed as outside.
Observed words pass no messages on, so the field falls into small parts without any approximation.  Of m like words each
is linked to the one before it and to the first, which makes 2m links and not m * m, at most two links apart.

The field is fitted by pseudo-likelihood on a bounded sample, whose base spans are the labels: some of them are rewritten
in other notations, and numbers that are none of the kinds are put between the words.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import pieces, tidy_arrow
from logwarden.llm.words import split_words, sums

KINDS = ["email", "ip", "card", "phone"]
OUTSIDE = 0  # label k is KINDS[k - 1]
LABELS = len(KINDS) + 1
#: Words on either side of one with a digit or an at sign that can belong to a span.
REACH = 4
SURE = 0.9
ROUNDS, STILL, DAMPING = 60, 1e-3, 0.3
#: Bound of the sample: rows, and the characters of each.
MOST_ROWS, MOST_CHARS = 2000, 10_000
FEATURES = 1 << 14
#: A small sample is used up to eight times, differently rewritten.
LEAST_LESSONS = 1000
LEAST_KEY = 5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# No match starts inside a run of digits: where the run's start fails, so does every later digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_EDGE = ".,;:!?\"'<>[]{}"

Span = tuple[int, int, int]  # label, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign has one candidate: all that can stand before it, so time grows with the text and not its square."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """What the patterns find, kind by kind: leftmost matches that do not overlap, without those that fail their check."""
    out = [(1, *span) for span in emails(text)]
    out += [(2, *m.span()) for m in _IP.finditer(text) if octets(m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((3, *m.span()))
    out += [(4, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return out


# Features of words


class _Shapes(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        return self[code]


_SHAPES = _Shapes()
_REPEATED = re.compile(r"(.)\1+", re.S)


def _id(slot: str, value: object) -> int:
    return zlib.crc32(f"{slot}|{value}".encode("utf-8", "surrogatepass")) & (FEATURES - 1)


class Seen(NamedTuple):
    """What is known of a word by itself."""

    own: tuple[int, ...]
    digits: int
    exact: str
    similar: str


_OWN = ("shape", "coarse", "counts", "word", "checks", "always")


def look(word: str) -> Seen:
    shape = word.translate(_SHAPES)
    coarse = _REPEATED.sub(r"\1", shape)
    fine = _REPEATED.sub(lambda m: f"{m[1]}{min(len(m[0]), 5)}", shape)
    groups = _DIGITS.findall(word)
    digits = "".join(groups)
    letters = shape.count("a")
    lower = word.lower().strip(_EDGE + "()")
    bare = word.strip(_EDGE)
    checks = (13 <= len(digits) <= 19 and luhn(digits), len(groups) == 4 and octets(groups), len(digits) in (7, 10, 11), "@" in bare)
    own = (fine, coarse, (min(len(digits), 20), min(letters, 6), "@" in word), lower if not digits else "#", checks, "")
    alone = "".join(c for c in lower.partition("@")[0] if c.isalnum())
    similar = digits[-7:] if len(digits) >= 7 and letters < len(digits) else alone
    capable = bool(digits) or "@" in word
    return Seen(tuple(map(_id, _OWN, own)), len(digits), lower, similar if capable and len(similar) >= LEAST_KEY else "")


class Nodes(NamedTuple):
    features: np.ndarray  #: feature numbers of each word
    chained: np.ndarray  #: whether the word follows the one before it directly
    edges: np.ndarray  #: pairs of like words
    family: np.ndarray  #: 0 for repeated words, 1 for similar ones


_known: dict[str, Seen] = {}


def _look(word: str) -> Seen:
    seen = _known.get(word)
    if seen is None:
        seen = look(word)
        if len(word) <= 40:
            if len(_known) > 100_000:
                _known.clear()
            _known[word] = seen
    return seen


def nodes(words: list[str], place: np.ndarray, doc: np.ndarray) -> Nodes:
    """Features and links of words, which stand at ``place`` (counted in words) of their documents."""
    n = len(words)
    seen = [_look(w) for w in words]
    own = np.array([s.own for s in seen], dtype=np.int64).reshape(n, len(_OWN))
    digits = np.array([min(s.digits, 20) for s in seen], dtype=np.int64)
    chained = np.zeros(n, dtype=bool)
    chained[1:] = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + 1)
    follows = np.append(chained[1:], False)[:n]
    columns = [own]
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[1:], after[:-1] = digits[:-1], digits[1:]
    before[~chained], after[~follows] = 0, 0
    for slot in ("coarse", "word"):
        of = own[:, _OWN.index(slot)]
        previous, following = np.roll(of, 1), np.roll(of, -1)
        previous[~chained], following[~follows] = 0, 0
        columns += [((x * 31 + _id(side, slot)) & (FEATURES - 1))[:, None] for side, x in (("before", previous), ("after", following))]
    for i, x in enumerate((before + digits, digits + after, before + digits + after)):
        columns.append(((x * 7919 + _id("around", i)) & (FEATURES - 1))[:, None])
    last: dict[tuple, int] = {}
    first: dict[tuple, int] = {}
    edges = []
    for i, s in enumerate(seen):
        if s.similar:
            key = (int(doc[i]), s.similar)
            if key in last:
                edges.append((last[key], i))
                if first[key] != last[key]:
                    edges.append((first[key], i))
            else:
                first[key] = i
            last[key] = i
    pairs = np.array(edges, dtype=np.int64).reshape(-1, 2)
    family = np.array([seen[i].exact != seen[j].exact for i, j in edges], dtype=np.int64)
    return Nodes(np.concatenate(columns, axis=1), chained, pairs, family)


class Model(NamedTuple):
    weights: np.ndarray  #: features x labels
    chain: np.ndarray  #: label of a word x label of the next
    skip: np.ndarray  #: family x label x label, symmetric


def unary(x: Nodes, model: Model) -> np.ndarray:
    """Potentials of the words by themselves; the unobserved neighbours at the ends of a run are outside."""
    out = model.weights[x.features].sum(axis=1)
    out[~x.chained] += model.chain[OUTSIDE]
    out[~np.append(x.chained[1:], False)[: len(out)]] += model.chain[:, OUTSIDE]
    return out


def marginals(own: np.ndarray, edges: np.ndarray, pair: np.ndarray, potentials: np.ndarray, damping: float = DAMPING,
              rounds: int = ROUNDS) -> np.ndarray:
    """Marginal probabilities of all variables by loopy message passing: all messages at once, until they stand still.

    ``own`` are log potentials (variables x labels), ``edges`` pairs of variables, ``pair`` the number of the potential
    matrix of each edge.  On a tree the result is exact once messages have crossed it.
    """
    n, labels = own.shape
    source = np.concatenate((edges[:, 0], edges[:, 1]))
    target = np.concatenate((edges[:, 1], edges[:, 0]))
    back = np.roll(np.arange(2 * len(edges)), len(edges))
    factor = np.exp(potentials)
    table = np.concatenate((factor, factor.transpose(0, 2, 1)))
    which = np.concatenate((pair, pair + len(factor)))
    groups = [(k, np.flatnonzero(which == k)) for k in np.unique(which)]
    message = np.zeros((2 * len(edges), labels))

    def belief() -> np.ndarray:
        return own + np.stack([np.bincount(target, weights=message[:, y], minlength=n) for y in range(labels)], axis=1)

    for _ in range(rounds if len(edges) else 0):
        sent = belief()[source] - message[back]
        sent = np.exp(sent - sent.max(axis=1, keepdims=True))
        new = np.empty_like(message)
        for k, at in groups:
            new[at] = np.log(sent[at] @ table[k])
        new -= new.max(axis=1, keepdims=True)
        new = damping * message + (1 - damping) * new
        moved = np.abs(new - message).max()
        message = new
        if moved < STILL:
            break
    out = belief()
    out = np.exp(out - out.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def probabilities(x: Nodes, model: Model, observed: np.ndarray) -> np.ndarray:
    """Marginals of all words; ``observed`` holds the known label of a word, or -1."""
    own = unary(x, model)
    known = np.flatnonzero(observed >= 0)
    own[known] = -50.0
    own[known, observed[known]] = 0.0
    follow = np.flatnonzero(x.chained)
    edges = np.concatenate((np.stack((follow - 1, follow), axis=1), x.edges))
    pair = np.concatenate((np.zeros(len(follow), np.int64), x.family + 1))
    return marginals(own, edges, pair, np.concatenate((model.chain[None], model.skip)))


# Words that can matter


class Near(NamedTuple):
    """Words near a digit or an at sign of the documents of a batch."""

    words: list[str]
    place: np.ndarray
    doc: np.ndarray
    start: np.ndarray  #: in code points
    end: np.ndarray


_ABLE = np.zeros(256, dtype=bool)
_ABLE[[*range(0x30, 0x3A), 0x40]] = True


def near(column: pa.Array) -> Near:
    w = split_words(column)
    able = np.diff(sums(_ABLE[w.data].astype(np.int32))[np.stack((w.start, w.end))], axis=0)[0] > 0
    doc = w.doc
    hit = np.flatnonzero(able)
    chosen = np.zeros(len(w.start), dtype=bool)
    for shift in range(-REACH, REACH + 1):
        at = hit + shift
        inside = (at >= 0) & (at < len(doc))
        at, of = at[inside], hit[inside]
        chosen[at[doc[at] == doc[of]]] = True
    at = np.flatnonzero(chosen)
    lead = sums(((w.data & 0xC0) != 0x80).astype(np.int64))
    base = lead[w.at[:-1]][doc[at]]
    data = w.data.tobytes()
    words = [data[s:e].decode() for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
    return Near(words, at - w.first[:-1][doc[at]], doc[at], lead[w.start[at]] - base, lead[w.end[at]] - base)


def labelled(x: Near, spans: list[list[Span]]) -> np.ndarray:
    """The label of each word that touches a span of its document, else -1."""
    out = np.full(len(x.words), -1, dtype=np.int64)
    ends = np.searchsorted(x.doc, np.arange(len(spans) + 1))
    for d, own in enumerate(spans):
        start, end = x.start[ends[d] : ends[d + 1]], x.end[ends[d] : ends[d + 1]]
        for label, s, e in reversed(own):  # a word that two kinds touch is of the first
            out[ends[d] + np.searchsorted(end, s, side="right") : ends[d] + np.searchsorted(start, e, side="left")] = label
    return out


def trimmed(words: list[str], start: int, end: int, label: int) -> tuple[int, int]:
    """A span without the marks at its edges."""
    first = len(words[0]) - len(words[0].lstrip(_EDGE + ("" if label == 4 else "()")))
    last = len(words[-1]) - len(words[-1].rstrip(_EDGE + "()"))
    return start + first, end - last


def added_spans(x: Near, model: Model, base: list[list[Span]]) -> list[list[Span]]:
    """Spans of unobserved words with a sure label, document by document; neighbours of one label are one span."""
    out: list[list[Span]] = [[] for _ in base]
    if not x.words:
        return out
    net = nodes(x.words, x.place, x.doc)
    observed = labelled(x, base)
    found = probabilities(net, model, observed)
    label = found.argmax(axis=1)
    sure = (observed < 0) & (label != OUTSIDE) & (found.max(axis=1) >= SURE)
    label = np.where(sure, label, OUTSIDE)
    joined = net.chained & (label == np.append(OUTSIDE, label[:-1]))
    heads = np.flatnonzero(sure & ~joined)
    for i in heads.tolist():
        j = i
        while j + 1 < len(label) and joined[j + 1] and sure[j + 1]:
            j += 1
        s, e = trimmed(x.words[i : j + 1], int(x.start[i]), int(x.end[j]), int(label[i]))
        # the words between can only carry a span that holds a number or an at sign itself
        if s < e and any(c.isdigit() or c == "@" for word in x.words[i : j + 1] for c in word):
            out[x.doc[i]].append((int(label[i]), s, e))
    return out


# Fitting


def notation(label: int, shown: str, rng: random.Random) -> str:
    """A mention of a kind in another notation."""
    if label == 1:
        name, _, host = shown.partition("@")
        spelled, boxed = host.replace(".", " dot "), host.replace(".", "[dot]")
        return rng.choice([f"{name} @ {host}", f"{name} at {spelled}", f"{name}(at){host}", f"{name}[at]{boxed}", f"{name} (at) {host}",
                           f"{name} [at] {host}", f"{name}[at]{host}", f"{name} (at) {spelled}"])
    if label == 2:
        return rng.choice(["[.]", "(.)", " dot ", "[dot]"]).join(shown.split("."))
    digits = "".join(_DIGITS.findall(shown))
    if label == 3:
        return rng.choice([".", "/", "_"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}", f"{a} {b} {c}", f"({a}){b}-{c}"])


def mention(label: int, rng: random.Random) -> str:
    """A mention in plain notation, made by rule."""
    if label == 1:
        name = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
        name += rng.choice(["", f".{rng.randint(1, 99):02}", f"{rng.randint(1, 999)}", "_x", ".a"])
        host = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) + rng.choice(["", str(rng.randint(1, 9))])
        return f"{name}@{host}.{rng.choice(['example.com', 'org', 'net', 'co.uk', 'io', 'com'])}"
    if label == 2:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if label == 3:
        head = "".join(rng.choices("0123456789", k=rng.choice([14, 15, 15, 15])))
        return next(head + d for d in "0123456789" if luhn(head + d))
    return f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(0, 9999):04}"


def other_number(rng: random.Random) -> str:
    """Something with digits or an at sign that is none of the kinds."""
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    failing = next(x for x in iter(lambda: d(16), "") if not luhn(x))
    return rng.choice([
        f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}/0{d(1)}/20{d(2)}", f"1{d(1)}:{d(2)}", f"1{d(1)}:{d(2)}:{d(2)}", f"{d(1)}.{d(1)}", f"{d(2)}.{d(2)}.{d(1)}",
        f"v{d(1)}.{d(1)}.{d(2)}", f"${d(1)},{d(3)}.{d(2)}", d(rng.randint(1, 12)), failing, f"3{d(2)}.4{d(2)}.{d(2)}.{d(1)}", f"{d(1)}/{d(1)}", f"{d(2)}%",
        f"@{rng.choice(['home', 'noon', 'all'])}", f"{d(2)}th", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(4)}-{d(4)}", f"id={d(8)}", f"x{d(6)}",
        f"{d(2)} - {d(2)}", f"({d(1)})", f"[{d(2)}]", f"{d(3)} dot {d(1)}", f"at {d(1)}", "".join(rng.choices("0123456789abcdef", k=20)), f"#{d(5)}",
        f"{d(2)}.{d(2)}.20{d(2)}", f"{failing[:4]} {failing[4:8]} {failing[8:12]} {failing[12:]}", f"+{d(2)}", f"{d(3)}-{d(2)}", f"{d(3)}.{d(3)}",
    ])


def lesson(text: str, rng: random.Random) -> tuple[str, list[Span]]:
    """A text for fitting with its true spans: base spans partly rewritten or repeated, other mentions and numbers put in."""
    spans, parts, at = sorted(base_spans(text), key=lambda s: s[1]), [], 0
    for label, s, e in spans:
        if s >= at:
            parts += [(w, OUTSIDE) for w in re.split(r"(?<=\s)(?=\S)", text[at:s])]
            parts.append((text[s:e] if rng.random() < 0.5 else notation(label, text[s:e], rng), label))
            at = e
    parts += [(w, OUTSIDE) for w in re.split(r"(?<=\s)(?=\S)", text[at:])]
    said = [(text[s:e], label) for label, s, e in spans] + [(mention(k, rng), k) for k in range(1, LABELS) if rng.random() < 0.6]
    extra = [(other_number(rng), OUTSIDE) for _ in range(rng.randint(1, 6))]
    for shown, label in said:
        extra += [(shown if rng.random() < 0.3 else notation(label, shown, rng), label) for _ in range(rng.choice([0, 1, 1, 2]))]
    for shown, label in extra:
        parts.insert(rng.randint(0, len(parts)), (f" {shown}{rng.choice(['', '', ',', '.', ')', ';'])} ", label))
    out, true = [], []
    length = 0
    for shown, label in parts:
        if label != OUTSIDE:
            core = shown.strip(" ,.);")
            true.append((label, length + shown.index(core), length + shown.index(core) + len(core)))
        out.append(shown)
        length += len(shown)
    return "".join(out), true


def learn(texts: list[str], seed: int = 7, epochs: int = 12) -> Model:
    """Weights by stochastic gradient on the pseudo-likelihood: each label given its word and the labels it is linked to.

    In every step a third of the words are seen without their own features, so that chain and skip potentials are
    learned for words that do not speak for themselves.
    """
    rng = random.Random(seed)
    model = Model(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((2, LABELS, LABELS)))
    lessons = [lesson(t, rng) for _ in range(max(1, min(8, LEAST_LESSONS // max(1, len(texts))))) for t in texts]
    x = near(pa.array([t for t, _ in lessons], pa.string()))
    if not x.words:
        return model
    label = np.maximum(labelled(x, [s for _, s in lessons]), OUTSIDE)
    net = nodes(x.words, x.place, x.doc)
    n = len(label)
    hot = np.eye(LABELS)
    before, after = np.full(n, OUTSIDE), np.full(n, OUTSIDE)
    follow = np.flatnonzero(net.chained)
    before[follow], after[follow - 1] = label[follow - 1], label[follow]
    linked = np.zeros((2, n, LABELS))
    for a, b in ((0, 1), (1, 0)):
        np.add.at(linked, (net.family, net.edges[:, a]), hot[label[net.edges[:, b]]])
    sizes = [np.full(m.shape, 1e-8) for m in model]
    steps = np.random.default_rng(seed)
    for _ in range(epochs):
        order = steps.permutation(n)
        for batch in np.array_split(order, max(1, n // 1024)):
            seen = (steps.random(len(batch)) > 1 / 3)[:, None]
            features = net.features[batch]
            score = model.weights[features].sum(axis=1) * seen + model.chain[before[batch]] + model.chain.T[after[batch]]
            score += sum(linked[f, batch] @ model.skip[f] for f in range(2))
            p = np.exp(score - score.max(axis=1, keepdims=True))
            miss = p / p.sum(axis=1, keepdims=True) - hot[label[batch]]
            own = np.zeros_like(model.weights)
            np.add.at(own, features.ravel(), np.repeat(miss * seen, features.shape[1], axis=0))
            chain = hot[before[batch]].T @ miss + miss.T @ hot[after[batch]]
            skip = np.stack([linked[f, batch].T @ miss for f in range(2)])
            for m, gradient, size in zip(model, (own, chain, skip + skip.transpose(0, 2, 1)), sizes, strict=True):
                gradient = gradient + 1e-3 * m
                size += gradient**2
                m -= 0.3 * gradient / np.sqrt(size)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS) -> Model:
    """A field from at most ``most_rows`` texts with a digit or an at sign and at most ``most_chars`` characters: those with
    the smallest hash of id and text.  Null texts are left out, null ids are not; without any such text nothing is added.

    The rows are counted first, and only hashes below the share that holds the sample, and half as many more, are sorted:
    what reaches the driver does not grow with the number of tasks.
    """
    some = docs.where(F.col(text_col).rlike("[0-9@]") & (F.length(text_col) <= most_chars)).select(
        F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), text_col), 32).alias("h"), F.col(text_col).alias("t")
    )
    share = min(1.0, 1.5 * most_rows / max(1, some.count()))
    few = some.where(F.col("h") < int(share * (1 << 32))).orderBy("h", "t").limit(most_rows)
    return learn([r["t"] for r in few.collect()])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SPANS = "array<struct<kind: string, start: long, end: long>>"


def _find(model, passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                texts = piece.column("_text").to_pylist()
                x = near(piece.column("_text"))
                # no pattern matches a text without a digit and an at sign
                base = [[] for _ in texts]
                for d in np.unique(x.doc).tolist():
                    base[d] = base_spans(texts[d])
                added = added_spans(x, model.value, base)

                def listed(rows: list[list[Span]]) -> pa.Array:
                    shown = [[{"kind": KINDS[k - 1], "start": s, "end": e} for k, s, e in sorted(own)] for own in rows]
                    return pa.array(shown, pa.list_(_SPAN))

                columns = [piece.column(c) for c in passed] + [listed(base), listed(added)]
                yield pa.RecordBatch.from_arrays(columns, names=[*passed, "base", "added"])

    return run


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, base, added`` of each row: lists of (kind, start, end) in the order of :data:`KINDS` and then of places.

    Places count code points, ends are exclusive.  ``base`` spans are those of the patterns, ``added`` ones those of the
    field (``model``, or one that is fitted on ``docs``) and touch no word of a base span.  A null or empty text has no
    spans, a null id is carried through, repeated rows have equal results, and other columns are not read.
    """
    spark = tidy_arrow(docs.sparkSession)
    model = fit(docs, id_col, text_col) if model is None else model
    kept = spark.sparkContext.broadcast(Model(*(m.astype(np.float32) for m in model)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(_find(kept, ["_id"]), f"_id {docs.schema[id_col].dataType.simpleString()}, base {_SPANS}, added {_SPANS}")
    return out.withColumnRenamed("_id", id_col)


def shown(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def merged(base: Column, added: Column) -> Column:
    """Both lists as one, in the order of :data:`KINDS` and then of places."""
    both = F.concat(base, added)
    return F.flatten(F.array(*(F.array_sort(of_kind(both, k)) for k in KINDS)))
