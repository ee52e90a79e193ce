"""Personal data: four exact patterns, and a linear-chain conditional random field for what they miss.

Base spans are those of the patterns (email, ip, card, phone), leftmost and not overlapping within a kind,
kept if their numbers hold; they always stay. The field tags the tokens (runs of letters, runs of digits,
single signs) of each line that has a digit, an @, or an "at" before a name with a dot (a sign or the word): tags are O, and B and I of each kind. Its
unary weights are sums over the shapes of a token and its two neighbours on either side (letters by case and
class, digit runs by length, signs and a few words as they are), plus weights of tag pairs. It is trained here, from the small
labelled table below with digits drawn anew, by gradient steps on the exact likelihood (forward-backward over
all sentences at once), and decodes by Viterbi over batches of lines of like length. A tagged span is added if
its numbers fit its kind and it overlaps no base span: phone numbers without a plus, cards with other separators, addresses
with masked dots or "at" and "dot" written out. Empty table: empty result.

Offsets are code points, the end exclusive. A null text counts as empty. Rows that repeat stay rows. Lines
longer than LINE tokens are tagged in pieces of LINE that overlap by half; of a piece its middle counts.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, tidied

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N_TAGS, LINE = len(TAGS), 256

#: the labelled table: [kind|text] marks a span, all other tokens are O; digits are drawn anew in training
LABELLED = """
Call me at [phone|(415) 555-2671] after noon.
phone: [phone|415-555-2671]
tel [phone|415.555.2671] or fax [phone|415.555.2672]
My number is [phone|415 555 2671] thanks
reach us on [phone|020 7946 0958] in London
telefon [phone|030 901820] Berlin
Tel. [phone|089/636-48018] zu erreichen
mobile [phone|(0151) 2345-6789], office [phone|(030) 2345-6789].
appelez le [phone|01 42 68 53 00] le matin
teléfono [phone|91 555 26 71] por la tarde
write to [email|john dot smith at example dot com] soon
mail [email|jane at example dot org] for details
contact [email|bob.lee at mail dot example dot net] today
email [email|anna (at) example (dot) com] please
or [email|mark[at]example[dot]de] will do
send it to [email|s.miller (at) uni-example.edu] now
please ask [email|mary [at] example.net] about it
write [email|info AT example DOT com] to join
address [email|sales@example] or ask
the server [ip|192[.]168[.]10[.]21] was down
traffic from [ip|10(.)20(.)30(.)40] again
blocked [ip|203 . 0 . 113 . 77] today
host [ip|172[.]16[.]254[.]1] replied
card [card|4111.1111.1111.1111] expired
paid with [card|5500/0055/5555/5559] online
visa [card|4012_8888_8888_1881] was charged
number [card|3782.822463.10005] on file
Licensed under CC BY-NC 4.0.
under the Apache License, Version 2.0.
General Public License, version 3.
it happened in 2019 and 2020 again
on 2021-03-04 at 10:30 the meeting
from 12.05.2021 to 14.06.2021 open
the price is $3,499.00 for 2 items
about 1,200,000 people in 45 towns
chapter 3.2.1 of part 12 page 340
order 1234567890 was shipped in 3 days
invoice 2021/0045-12 total 99.95
ISBN 978-3-16-148410-0 printed
build 20210304.17 passed 1234 of 1240 tests
meet at noon at the dot on the map
we met at 5 and left at 7 for the show
look at the dot com boom of 1999
version 10.0.19042 of the system
at noon the people at home. They look at it. Then at last
ratio 16:9 and 4:3 or 21:9
scores 3-2, 4-1 and 0-0 so far
room 101, floor 7, house 12-14
temperature 21.5 to 23.7 degrees
id 550e8400-e29b-41d4-a716-446655440000 done
zip 94103 San Francisco, CA 94103-1234
ring her on [phone|(212) 555-0143] or by mail
the office has [phone|646-555-0177] as its line
hotline [phone|0800 555 0199] is free
mail [email|k.o (at) ab (dot) org] if you can
ask [email|a.b (at) c (dot) net] first
note [email|x_y at z dot io] for later
api_key: "9f8e7d6c5b4a39281706f5e4d3c2b1a0" in the file
secret=12ab34cd56ef7890aa was set
access id QWER7TYU8IOP9ASD0FGH was revoked
the number 5105105105105100 on a slip
the host 198.51.100.23 is up
write to help.desk@example.org for more
call +49 30 5550 1234 in the morning
they sat at a table. He looked at it, at them, and at the dot on it
at first at ease, then at 9 at work. At 17 they went
ssn 219-09-9999 on the form
social security number 457-55-5462 was given
tax id 12-3456789 of the firm
ratio 40-60-20 10 30 50 in the mix
parts 25-50-75 10 20 30 by weight
sizes 10-20-30 40 50 60 in stock
sold 12 34 56 78 90 of them
isbn 0-306-40615-2 and 99921-58-10-7
lot 2023-114-77-02 was shipped
seats 14 22 36 48 and 50 are free
""".strip().split("\n")
WORDS = frozenset("at dot tel phone call mobile fax telefon mail email card visa ip version license page".split())

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: an address with "at" written out; a part of a name has at most 63 characters, so a line is searched in linear time
WRITTEN = re.compile(r"\w\W{1,3}at\W{1,3}[\w-]{1,63}(?:\W{1,3}dot\W{1,3}\w|\.\w)", re.I)
RUN_ON = re.compile(r"(?!(?:at|dot)\b)\b\w+\s+(?!(?:at|dot)\b)\w", re.I)
LEFT_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern, found from each @: linear even where the left part is very long."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LEFT_CHARS:
            start -= 1
        m = EMAIL_RIGHT.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(emails(text))
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(d := p.lstrip("0") or "0") <= 3 and int(d) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


def shape(token: str) -> str:
    c = token[0]
    if c in "0123456789":
        return "9" * min(len(token), 12)
    if not c.isalpha():
        return token if token in "@.()[]-/+_:,=\"" else "?"
    low = token.lower()
    return low if low in WORDS else ("X" if token.isupper() else "Xx" if c.isupper() else "x") + str(min(len(token), 2))


class Field:
    """Shapes' ids (0: unknown), unary weights [5 offsets, shape, tag], pair weights, first tag's weights."""

    def __init__(self, sentences: list[tuple[list[str], list[int]]], steps: int = 150, ridge: float = 0.02) -> None:
        names = sorted({shape(t) for s, _ in sentences for t in s})
        self.ids = {n: i + 1 for i, n in enumerate(names)}
        self.edge = len(names) + 1
        self.unary = np.zeros((5, self.edge + 1, N_TAGS))
        self.pair, self.first = np.zeros((N_TAGS, N_TAGS)), np.zeros(N_TAGS)
        # an I follows only its own B or I
        self.allowed = np.array([[not b.startswith("I-") or a[2:] == b[2:] and a != "O" for b in TAGS] for a in TAGS])
        self.starts = np.array([not t.startswith("I-") for t in TAGS])
        self._train(sentences, steps, ridge)

    def windows(self, tokens: list[str]) -> np.ndarray:
        ids = np.array([self.ids.get(shape(t), 0) for t in tokens])
        padded = np.concatenate([[self.edge] * 2, ids, [self.edge] * 2])
        return np.stack([padded[k : k + len(ids)] for k in range(5)])

    def _masked(self) -> tuple[np.ndarray, np.ndarray]:
        return np.where(self.allowed, self.pair, -1e9), np.where(self.starts, self.first, -1e9)

    def scores(self, windows: np.ndarray) -> np.ndarray:
        return sum(self.unary[k][windows[k]] for k in range(5))

    def _train(self, sentences: list[tuple[list[str], list[int]]], steps: int, ridge: float) -> None:
        n, length = len(sentences), max(len(s) for s, _ in sentences)
        w, y, mask = np.full((5, n, length), self.edge), np.zeros((n, length), int), np.zeros((n, length), bool)
        for i, (s, tags) in enumerate(sentences):
            w[:, i, : len(s)], y[i, : len(s)], mask[i, : len(s)] = self.windows(s), tags, True
        gold = [np.zeros_like(self.unary), np.zeros_like(self.pair), np.zeros_like(self.first)]
        for k in range(5):
            np.add.at(gold[0][k], (w[k][mask], y[mask]), 1)
        both = mask[:, 1:]
        np.add.at(gold[1], (y[:, :-1][both], y[:, 1:][both]), 1)
        np.add.at(gold[2], y[:, 0], 1)
        weights = [self.unary, self.pair, self.first]
        squares = [np.full_like(x, 1e-6) for x in weights]
        lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        for _ in range(steps):
            pair, first = self._masked()
            u = self.scores(w)
            alpha, beta = np.zeros((length, n, N_TAGS)), np.zeros((length, n, N_TAGS))
            alpha[0] = first + u[:, 0]
            for t in range(1, length):
                new = lse(alpha[t - 1][:, :, None] + pair, 1) + u[:, t]
                alpha[t] = np.where(mask[:, t, None], new, alpha[t - 1])
            for t in range(length - 2, -1, -1):
                new = lse(pair + (u[:, t + 1] + beta[t + 1])[:, None, :], 2)
                beta[t] = np.where(mask[:, t + 1, None], new, 0)
            z = lse(alpha[-1], 1)
            node = np.exp(alpha + beta - z[:, None]).transpose(1, 0, 2)
            grad = [g.copy() for g in gold]
            for k in range(5):
                np.add.at(grad[0][k], w[k][mask], -node[mask])
            for t in range(1, length):
                on = mask[:, t]
                if on.any():
                    e = alpha[t - 1][on][:, :, None] + pair + (u[on, t] + beta[t][on])[:, None, :] - z[on][:, None, None]
                    grad[1] -= np.exp(e).sum(axis=0)
            grad[2] -= node[:, 0].sum(axis=0)
            for x, g, q in zip(weights, grad, squares):
                g -= ridge * x
                q += g * g
                x += 0.5 * g / np.sqrt(q)

    def viterbi(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """windows [5, lines, tokens] -> tags [lines, tokens]; O behind a line's end."""
        pair, first = self._masked()
        u = self.scores(windows)
        n, length, _ = u.shape
        back = np.zeros((length, n, N_TAGS), np.int8)
        best = first + u[:, 0]
        ends = best.copy()
        for t in range(1, length):
            way = best[:, :, None] + pair
            back[t] = way.argmax(axis=1)
            best = way.max(axis=1) + u[:, t]
            ends = np.where((lengths > t)[:, None], best, ends)
        tags, at = np.zeros((n, length), np.int8), ends.argmax(axis=1)
        for t in range(length - 1, -1, -1):
            on = lengths > t
            tags[on, t] = at[on]
            at = np.where(on, back[t][np.arange(n), at], at)
        return tags


def _rows(rng: np.random.Generator, times: int) -> list[tuple[list[str], list[int]]]:
    out = []
    for line in LABELLED:
        for k in range(times):
            text, spans = "", []
            for part in re.split(r"(\[(?:email|ip|card|phone)\|(?:[^\[\]]|\[[^\]]*\])*\])", line):
                m = re.fullmatch(r"\[(\w+)\|(.*)\]", part)
                if m:
                    spans.append((m[1], len(text), len(text) + len(m[2])))
                text += m[2] if m else part
            if k:
                text = re.sub("[0-9]", lambda _: str(rng.integers(10)), text)
            tokens = list(TOKEN.finditer(text))
            tags = [0] * len(tokens)
            for kind, a, b in spans:
                inside = [i for i, t in enumerate(tokens) if a <= t.start() and t.end() <= b]
                for j, i in enumerate(inside):
                    tags[i] = TAGS.index(("I-" if j else "B-") + kind)
            out.append(([t.group() for t in tokens], tags))
    return out


@lru_cache(1)
def field() -> Field:
    """The trained field: a few seconds, once per process, always the same."""
    return Field(_rows(np.random.default_rng(7), 3))


def fits(kind: str, text: str) -> bool:
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    # of a long one all words must be joined by signs, "at" or "dot": two side by side are running text
    return ("@" in text or bool(WRITTEN.search(text))) and (len(text) <= 64 or not RUN_ON.search(text))


def _lines(text: str) -> Iterator[tuple[int, str]]:
    """The lines in which a span can fit: fits() wants digits, an @ or WRITTEN, and a line has what its spans have."""
    at = 0
    for line in text.split("\n"):
        if DIGIT.search(line) or "@" in line or WRITTEN.search(line):
            yield at, line
        at += len(line) + 1


def tagged_spans(texts: list[str], model: Field) -> list[list[tuple[str, int, int]]]:
    """What the field tags in each text, if its numbers fit."""
    pieces = []
    for i, text in enumerate(texts):
        for at, line in _lines(text):
            tokens = list(TOKEN.finditer(line))
            for s in range(0, max(1, len(tokens) - LINE // 2), LINE // 2):
                if part := tokens[s : s + LINE]:
                    lo = s + LINE // 4 if s else 0
                    hi = s + 3 * LINE // 4 if s + LINE < len(tokens) else len(tokens)
                    pieces.append((i, at, part, lo - s, hi - s))
    groups: dict[int, list[int]] = defaultdict(list)
    for k, p in enumerate(pieces):
        groups[1 << (len(p[2]) - 1).bit_length()].append(k)
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for width, members in groups.items():
        for own in (members[j : j + 512] for j in range(0, len(members), 512)):
            w = np.full((5, len(own), width), model.edge)
            for r, k in enumerate(own):
                w[:, r, : len(pieces[k][2])] = model.windows([t.group() for t in pieces[k][2]])
            tags = model.viterbi(w, np.array([len(pieces[k][2]) for k in own]))
            for r in np.flatnonzero(tags.any(axis=1)):
                i, at, part, lo, hi = pieces[own[r]]
                row, t = tags[r], 0
                while t < len(part):
                    if row[t]:
                        kind, end = TAGS[row[t]][2:], t + 1
                        while end < len(part) and TAGS[row[end]] == f"I-{kind}":
                            end += 1
                        a, b = at + part[t].start(), at + part[end - 1].end()
                        if lo <= t < hi and fits(kind, texts[i][a:b]):
                            found[i].append((kind, a, b))
                        t = end
                    else:
                        t += 1
    return found


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(texts: list[str], model: Field | None = None) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """Of each text: its base spans by kind, and all spans."""
    out = []
    for text, more in zip(texts, tagged_spans(texts, model or field())):
        base = base_spans(text)
        every = [(k, a, b) for k in KINDS for a, b in base[k]]
        held = sorted((a, b) for _, a, b in every)
        every += [s for s in more if not any(a < s[2] and s[1] < b for a, b in held)]
        out.append((base, every))
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    model = field()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 512, 4_000_000):
                rows = []
                for base, every in find([t or "" for t in part.column(1).to_pylist()], model):
                    own = listed([(k, a, b) for k in KINDS for a, b in base[k]])
                    rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(own.encode()).hexdigest(), listed(every), len(every) - sum(map(len, base.values()))))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), "text").mapInArrow(tidied(run), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
