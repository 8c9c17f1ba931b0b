"""Personal data by rules and a skip-chain conditional random field.

Base spans (email, ip, card, phone) come from fixed rules. Around them, a looser pattern
proposes mentions: runs of digits and separators, and words with an at-sign or an obfuscated
one. Each mention is a node with the labels none, email, ip, card, phone; neighbours in the
text are linked, and so is each mention with the one before it that repeats it (same normal
form) and with the one before it that is similar (same last digits, or same user or domain),
however far apart, with potentials of their own for the two kinds of skip link. Loopy belief
propagation over these links makes labels of one entity agree across the document: a number
first given in full as a phone number is also found where it is repeated without its prefix; a
number in groups that only looks like one, and that nothing else speaks for, is left alone.
Base spans are clamped, so they stay.

Weights are learned by pseudo-likelihood on a bounded sample of documents, with the base spans'
labels, which mentions of the same normal form share, and none for what looks unlike any, and on made-up
documents in which entities are repeated in other forms, with their true labels. Every mention
of every document, with base spans or without, is labelled by its belief.

Defined cases: a null or empty text has no spans and the digest of the empty string; links per
mention to those before it are at most four, so a text with many mentions costs time in
proportion; a null doc_id is carried through; rows that repeat are judged apart; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, tune

KINDS = ("email", "ip", "card", "phone")
NONE = 0  # labels: NONE, then 1 + the kind's place
LABELS = 1 + len(KINDS)
SAMPLE = 400  # documents the weights are learned from, at most
TOLERANCE = 1e-4  # of a message, in logarithms
SLOW_AFTER = 50  # sweeps, from which on steps shrink
EMIT = 0.7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can't begin inside a run of digits: from the run's start it would begin earlier.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9](?:[ ().-]{0,3}[0-9])+")
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]++)+", re.I)


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches in time linear in the text: each holds exactly one at-sign, and begins
    where the run of local characters before it begins or the last match ended."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label or -1): base spans, and what the loose patterns find outside them."""
    out = [(s, e, 1 + k) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    loose = sorted((m.start(), m.end()) for p in (_NUMBER, _AT) for m in p.finditer(text))
    k = 0
    for s, e in loose:
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if (k == len(taken) or taken[k][0] >= e) and (len(_digits(text[s:e])) >= 7 or not text[s].isdigit()):
            out.append((s, e, -1))
    return sorted(out)


def normal(mention: str) -> str:
    """What mentions of one entity share: the last ten digits, or the address without marks."""
    d = _digits(mention)
    if "@" in mention or _AT.fullmatch(mention):
        low = re.sub(r" ?[\[(] ?(at|dot) ?[\])] ?", lambda m: "@" if m[1].lower() == "at" else ".", mention, flags=re.I)
        return low.lower()
    return d[-10:] if len(d) <= 15 else d


FEATURES = 15
LOOKS = [2, 3, 11, 12, 14]  # of these, each is a sign of an entity


def unary(text: str, s: int, e: int) -> np.ndarray:
    m, d = text[s:e], len(_digits(text[s:e]))
    groups = [len(g) for g in re.findall(r"[0-9]+", m)]
    # As one writes telephone numbers: groups of two to four digits, the last of four.
    phone_like = 7 <= d <= 12 and 2 <= len(groups) <= 5 and groups[-1] == 4 and max(groups) <= 4
    return np.array([1, "@" in m, m.count(".") == 3, m[0] == "+", "(" in m, "-" in m, " " in m, d < 7, 7 <= d <= 11, 12 <= d <= 15, 16 <= d, bool(re.search("[A-Za-z]", m)), phone_like, len(groups) == 1, 12 <= d <= 19 and _luhn(_digits(m))], np.float64)


def similar(mention: str) -> tuple[str, ...]:
    """Keys of which similar mentions share one: the last seven digits of a longer number, the
    user or the domain of an address."""
    n = normal(mention)
    if "@" in n:
        user, _, domain = n.rpartition("@")
        return ("u" + user, "d" + domain)
    d = _digits(mention)
    return ("n" + d[-7:],) if len(d) >= 9 else ()


def skips(text: str, found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Each mention with the one before it of the same normal form, and with the ones before it
    that are similar and no repeats."""
    last: dict[str, int] = {}
    same, near = [], []
    for i, (s, e, _) in enumerate(found):
        key = normal(text[s:e])
        if key in last:
            same.append((last[key], i))
        for k in similar(text[s:e]):
            if k in last and (last[k], i) not in same[-1:]:
                near.append((last[k], i))
            last[k] = i
        last[key] = i
    return same, near


def links_of(text: str, found: list[tuple[int, int, int]]) -> tuple[list, list, list]:
    """Chain links, repeats and similar ones."""
    return [(i, i + 1) for i in range(len(found) - 1)], *skips(text, found)


class Crf:
    """Weights: unary (labels x features), and the label agreement of chain links, of repeats and
    of similar mentions."""

    def __init__(self) -> None:
        self.unary = np.zeros((LABELS, FEATURES))
        self.chain, self.skip, self.near = (np.zeros((LABELS, LABELS)) for _ in range(3))

    def fit(self, rows: np.ndarray, weight: np.ndarray, steps: int = 500, rate: float = 2.0) -> Crf:
        """Pseudo-likelihood gradient ascent over distinct mentions (see ``cases``) and how often
        each occurs."""
        if not len(rows):
            return self
        x, y, *counts = np.split(rows, [FEATURES, FEATURES + 1, FEATURES + 1 + LABELS, FEATURES + 1 + 2 * LABELS], axis=1)
        want, weight = np.eye(LABELS)[y[:, 0].astype(np.int64)], weight / weight.sum()
        pots = (self.chain, self.skip, self.near)
        for _ in range(steps):
            z = x @ self.unary.T + sum(n @ w for n, w in zip(counts, pots, strict=True))
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (want - p / p.sum(axis=1, keepdims=True)) * weight[:, None]
            self.unary += rate * (g.T @ x - 0.0001 * self.unary)
            for w, n in zip(pots, counts, strict=True):
                d = n.T @ g
                w += rate * ((d + d.T) / 2 - 0.0001 * w)
        return self

    def marginals(self, feats: np.ndarray, clamped: np.ndarray, chain: list, skip: list, near: list) -> np.ndarray:
        """Beliefs (nodes x labels) by sum-product messages, swept forward and backward over the
        text until none changes by more than ``TOLERANCE``. A forward sweep carries a message
        along all later repeats of a mention, however many."""
        node = feats @ self.unary.T
        known = clamped >= 0
        node[known] = -30.0
        node[known, clamped[known]] = 0.0
        pots = np.exp(self.chain), np.exp(self.skip), np.exp(self.near)
        links = [(a, b, pot) for pairs, pot in zip((chain, skip, near), pots, strict=True) for a, b in pairs]
        up, down = [[] for _ in node], [[] for _ in node]
        for k, (a, b, _) in enumerate(links):
            up[a].append((k, b, links[k][2])), down[b].append((k, a, links[k][2].T))
        # Into each link's later node, and into its earlier one; beliefs hold all messages.
        later, earlier = np.zeros((len(links), LABELS)), np.zeros((len(links), LABELS))
        belief, sweep, change = node.copy(), 0, 1.0
        while links and change > TOLERANCE:
            sweep += 1
            # Messages that circle without settling are taken in shrinking steps, which end.
            step = min(1.0, 0.98 ** (sweep - SLOW_AFTER))
            change = 0.0
            for order, out, into, back in ((range(len(node)), up, later, earlier), (range(len(node) - 1, -1, -1), down, earlier, later)):
                for i in order:
                    for k, other, pot in out[i]:
                        z = belief[i] - back[k]
                        new = np.log(np.exp(z - z.max()) @ pot + 1e-300)
                        new -= new.max()
                        move = step * (new - into[k])
                        into[k] += move
                        belief[other] += move
                        change = max(change, float(np.abs(move).max()))
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], crf: Crf) -> list[tuple[int, int, int]]:
    """Mentions outside the base spans whose belief in a kind is at least ``EMIT``."""
    found = mentions(text, base)
    clamped = np.array([label for *_, label in found], np.int64)
    if not (clamped < 0).any():
        return []
    feats = np.stack([unary(text, s, e) for s, e, _ in found])
    p = crf.marginals(feats, clamped, *links_of(text, found))
    best = p.argmax(axis=1)
    return [(found[i][0], int(best[i]) - 1, found[i][1]) for i in np.flatnonzero(clamped < 0) if best[i] != NONE and p[i, best[i]] >= EMIT]


def cases(text: str, truth: dict[tuple[int, int], int] | None = None) -> np.ndarray:
    """A row for each mention of a text: its features, its label, and by kind of link how many
    neighbours of each label it has. Labels are the given ones, or the base spans', which
    repeats carry over, and none for the rest; of the rest, mentions that look like an entity
    teach nothing, as rules alone can't tell them, and have no row."""
    found = mentions(text, base_spans(text))
    if not found:
        return np.zeros((0, FEATURES + 1 + 3 * LABELS))
    labels, kinds = np.array([max(label, NONE) for *_, label in found]), links_of(text, found)
    if truth is not None:
        labels = np.array([truth.get((s, e), NONE) for s, e, _ in found])
    else:
        for a, b in [*kinds[1], *kinds[1][::-1]]:
            labels[a], labels[b] = (labels[b], labels[b]) if labels[a] == NONE else (labels[a], labels[b] or labels[a])
    counts = np.zeros((3, len(found), LABELS))
    for n, links in zip(counts, kinds, strict=True):
        for a, b in links:
            n[a, labels[b]] += 1
            n[b, labels[a]] += 1
    feats = np.stack([unary(text, s, e) for s, e, _ in found])
    rows = np.column_stack([feats, labels, *counts])
    return rows if truth is not None else rows[(labels != NONE) | ~feats[:, LOOKS].any(axis=1)]


def _luhn_end(digits: str) -> str:
    return next(str(k) for k in range(10) if _luhn(digits + str(k)))


def made_up(n: int, seed: int = 4) -> list[tuple[str, dict[tuple[int, int], int]]]:
    """Documents of which each repeats an entity in other forms, among numbers that are none;
    and the true labels by place."""
    rng, out = random.Random(seed), []
    some = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    grouped = lambda: rng.choice([" ", "-", "."]).join([str(rng.randint(200, 989)), str(rng.randint(200, 989)), some(4)])
    for k in range(n):
        kind = k % len(KINDS)
        if kind == 0:
            user, host = f"{word()}.{word()}", f"{word()}.example.com"
            forms = [f"{user}@{host}", f"{user} [at] {host}", f"{user} (at) {host}", f"{user}[at]{host.replace('.', ' [dot] ')}"]
            again = [f"{word()} [at] {host}"]  # a colleague
        elif kind == 1:
            ip = ".".join(str(rng.randint(1, 254)) for _ in range(4))
            forms, again = [ip, ip], []
        elif kind == 2:
            d = "4" + some(14)
            d += _luhn_end(d)
            four = [d[i : i + 4] for i in range(0, 16, 4)]
            forms, again = [rng.choice([" ", "-", ""]).join(four), ".".join(four), ". ".join(four)], []
        else:
            a, b, c = str(rng.randint(200, 989)), str(rng.randint(200, 989)), some(4)
            forms = [f"+1 ({a}) {b}-{c}", f"{a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"]
            again = [f"{rng.randint(200, 989)} {b} {c}"]  # another area's
        rest = rng.sample(forms[1:], min(len(forms) - 1, rng.randint(1, 3))) + (again if rng.random() < 0.3 else [])
        parts = [(forms[0], 1 + kind)] * (rng.random() < 0.8) + [(f, 1 + kind) for f in rest]
        # Numbers of other kinds: orders, dates, amounts, parts numbered in groups like telephones'.
        parts += [(rng.choice([some(rng.randint(7, 10)), grouped(), f"20{some(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{some(1)}.{some(2)}.{some(3)}.{some(4)}", f"{rng.randint(1, 9)} 000 000"]), NONE) for _ in range(rng.randint(0, 3))]
        rng.shuffle(parts)
        text, truth = "", {}
        for p, label in parts:
            text += rng.choice(["call ", "see ", "ask for ", "ref: ", "with "])
            truth[len(text), len(text) + len(p)] = label
            text += p + rng.choice([" now; ", ", and ", " or\n", ". "]) + f"{word()} {word()} "
        out.append((text, {at: label for at, label in truth.items() if label}))
    return out


ROW = FEATURES + 1 + 3 * LABELS


def fit(docs: DataFrame, sample: int = SAMPLE) -> Crf:
    """Learn from at most ``sample`` documents that hold a digit group or an at-sign, and as many
    made-up ones. Ids are picked first; only distinct cases, counted, reach the driver."""
    likely = docs.where(F.rlike("text", F.lit(r"@|[0-9][0-9 ().-]{7}"))).withColumn("h", F.xxhash64("text"))
    picked = likely.select("h", "doc_id").distinct().orderBy("h", "doc_id").limit(sample).toDF("ph", "pid")
    texts = likely.join(F.broadcast(picked), (F.col("h") == F.col("ph")) & F.col("doc_id").eqNullSafe(F.col("pid"))).dropDuplicates(["h", "doc_id"]).select("text")

    def rows(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float32).tobytes() for r in cases(t)], pa.binary())], names=["case"])

    # Cases are few kinds: a handful of flags and small counts.
    seen = texts.mapInArrow(rows, "case binary").groupBy("case").agg(F.count("*").alias("n")).orderBy("case").collect()
    own = np.concatenate([cases(t, truth) for t, truth in made_up(sample)])
    kinds, often = np.unique(own, axis=0, return_counts=True)
    table = np.concatenate([np.stack([np.frombuffer(r["case"], np.float32) for r in seen]).astype(np.float64).reshape(-1, ROW) if seen else np.zeros((0, ROW)), kinds])
    return Crf().fit(table, np.array([r["n"] for r in seen] + often.tolist(), np.float64))


ROWS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, added long"


def _say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame) -> DataFrame:
    """The columns of ROWS for every row of docs (doc_id, text)."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    crf = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def scan(batches):
        schema = fields(ROWS)
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = base_spans(t)
                more = added_spans(t, base, crf.value)
                counts = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
                out.append((i, *counts, hashlib.sha256(_say(base).encode()).hexdigest(), _say(base + more), len(more)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    return rows.mapInArrow(scan, ROWS)
