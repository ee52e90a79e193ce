"""Toxicity by a subsequence string kernel and a support vector machine with Nystrom landmarks.

Kernel of two strings: over all subsequences of P characters that both hold, gaps allowed, the sum of
LAMBDA ** (the spans they take in either); a character put between two others only lengthens a span. A word's
feature for a landmark is its kernel over the landmark's own and over that of a word of its length (the landmark's own
weighs three times as much, so that an insult inside a longer word still counts), cut at 1; a sentence has the greatest of its
words. Features are whitened by the landmarks' Gram matrix (Nystrom) before the machine.

Training, on the driver, from a bounded sample (`per_class` labelled documents of each class, least hashes
first, test fold left out): character n-grams that mark toxic documents beyond chance become landmarks (MOST_LANDMARKS
at most, those with the most evidence first); toxic documents' sentences that hold one, and copies of these with characters put in
or changed, are the positive sentences, clean documents' sentences the negative ones; a squared-hinge machine is fitted by Newton steps, and its
greatest value in a document is turned into a probability by a logistic fit on the same sample. P and LAMBDA were settled
by hand, from how many clean words of a test table reach the kernel of disguised insults, for P in 3 to 5 and LAMBDA in 0.5 to 0.9.

Scoring reads whole texts: each distinct word's features are made once a batch and worker; words over
WIDTH characters count as overlapping pieces; a word with other characters than letters is read without them too. A landmark
whose characters stand in some words with one other between two of them at most is found as a window and read as one word.
A null text counts as empty; empty texts get the score of no words. Without labels of both classes (or without
a landmark) every score is the share of toxic labels in the sample, or 0. Of a document with both labels 1 counts.
Rows that repeat stay rows. Empty tables: a model without landmarks, an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, small_batches, text_or_empty, tidied

P, LAMBDA, WIDTH = 5, 0.8, 24
#: bits of evidence that an n-gram must have to become a landmark
LEAST_BITS, MOST_LANDMARKS = 24.0, 48
LONGEST = 12  # characters of a landmark
SENTENCE_WORDS = 40
START, END, TRAIL = "^", "$", ".,!?;:"
MOST_WORDS = 300_000  # known to a worker; beyond, it starts anew (that costs time only)


def kernel(words: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of each row of words (code points, -1 after the end) with the string t."""
    n, length = words.shape
    k, total = np.zeros((P, n, len(t) + 1), np.float32), np.zeros(n, np.float32)
    k[0] = 1
    lag = np.arange(len(t))
    decay = np.where(lag[:, None] <= lag, LAMBDA ** np.maximum(0.0, lag - lag[:, None]), 0).astype(np.float32)
    for a in range(length):
        same = (words[:, a, None] == t) * np.float32(LAMBDA**2)
        total += (same * k[P - 1, :, :-1]).sum(axis=1)
        for i in range(P - 1, 0, -1):
            k[i] *= np.float32(LAMBDA)
            k[i, :, 1:] += (same * k[i - 1, :, :-1]) @ decay
    return total


def own_by_length() -> np.ndarray:
    """The kernel with itself of a string of 0 to WIDTH different characters."""
    n = np.arange(WIDTH + 1)
    return np.array([sum((m - span + 1) * math.comb(span - 2, P - 2) * LAMBDA ** (2 * span) for span in range(P, m + 1)) for m in n])


def _pieces(word: str) -> list[str]:
    """START, the word without signs at its end, END; cut into overlapping pieces where it is long."""
    v = START + word.rstrip(TRAIL) + END
    return [v[s : s + WIDTH] for s in range(0, max(1, len(v) - WIDTH // 2), WIDTH // 2)]


def _codes(words: list[str]) -> np.ndarray:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), max(1, int(lengths.max(initial=0)))), -1, np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def common_length(ids: np.ndarray, places: np.ndarray, m: int) -> np.ndarray:
    """Longest common subsequence of each row of ids with a string of m characters, whose places (bits) of
    each character id are given; bit-parallel."""
    v = np.full(len(ids), (1 << m) - 1, np.uint64)
    for a in range(ids.shape[1]):
        u = v & places[ids[:, a]]
        v = (v + u) | (v - u)
    return m - np.bitwise_count(v & np.uint64((1 << m) - 1)).astype(int)


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    slope: float = 0.0
    prior: float = 0.0
    own: list[float] = field(default_factory=list)

    def features(self, words: list[str]) -> np.ndarray:
        """A row per word, a column per landmark. The kernel is made only where P characters of a landmark stand in a piece in
        their order: elsewhere it is 0."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if not words:
            return out
        pieces, owner = [], []
        for i, w in enumerate(words):
            for v in (w,) if w.isalpha() else (w, "".join(filter(str.isalpha, w))):
                for piece in _pieces(v):
                    pieces.append(piece)
                    owner.append(i)
        codes, owner = _codes(pieces), np.array(owner)
        alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(self.landmarks))))}
        known = np.zeros(0x110001, np.uint16)
        for c, i in alphabet.items():
            known[ord(c)] = i
        ids, lengths = known[codes], (codes >= 0).sum(axis=1)
        usual = own_by_length().astype(np.float32)
        held = np.zeros((len(pieces), len(alphabet) + 1), np.int8)
        for a in range(codes.shape[1]):
            held[np.arange(len(pieces)), ids[:, a]] += 1
        wanted = np.array([[g.count(c) for c in alphabet] for g in self.landmarks])
        # characters that a piece has in common with a landmark, in any order: where too few are, the order needn't be looked at
        common = sum((held[:, 1:] >= k).astype(np.float32) @ (wanted >= k).astype(np.float32).T for k in range(1, int(wanted.max()) + 1))
        for j, landmark in enumerate(self.landmarks):
            places = np.zeros(len(alphabet) + 1, np.uint64)
            for at, c in enumerate(landmark):
                places[alphabet[c]] |= np.uint64(1 << at)
            rows = np.flatnonzero(common[:, j] >= P)
            rows = rows[common_length(ids[rows], places, len(landmark)) >= P]
            t, own = _codes([landmark])[0], np.float32(self.own[j])
            rows = rows[np.argsort(lengths[rows], kind="stable")]
            for part in np.array_split(rows, len(rows) // 2048 + 1) if len(rows) else []:
                width = int(lengths[part].max())
                both = np.maximum(own, usual[lengths[part]])
                np.maximum.at(out[:, j], owner[part], np.minimum(1, kernel(codes[part, :width], t) / (own**0.75 * both**0.25)))
        return out

    def bodies(self) -> list[str]:
        return list(dict.fromkeys(g.strip(START + END) for g in self.landmarks))

    def probability(self, value: np.ndarray) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(value), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * value, -30, 30)))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def units(texts: list[str], model: Model) -> list[list[str]]:
    """Of each text its lower-case words, then the windows over several words that spell a landmark."""
    low = [t.lower() for t in texts]
    out = [t.split() for t in low]
    spelled = "|".join(".?".join(map(re.escape, b)) for b in model.bodies())
    # the first pattern is a fast one that only says which texts are worth the other
    for i in np.flatnonzero(pc.match_substring_regex(pa.array(low, pa.large_string()), rf"(?:^|\s)(?:{spelled})(?:$|[\s{TRAIL}])").to_numpy(zero_copy_only=False)):
        found = (m.group() for m in re.finditer(rf"(?<!\S)(?:{spelled})(?=$|[\s{TRAIL}])", low[i]))
        out[i] += [w + "." for w in found if len(w.split()) > 1]
    return out


def _ends(words: list[str]) -> np.ndarray:
    return np.fromiter((w[-1] in ".!?" for w in words), np.bool_, len(words))


def _starts(ends: np.ndarray) -> np.ndarray:
    """Where sentences start: after an end, and each SENTENCE_WORDS words."""
    first = np.zeros(len(ends), np.bool_)
    first[1:] = ends[:-1]
    first[::SENTENCE_WORDS] = True
    return np.flatnonzero(first)


def _bits(a: int, c: int, share: float) -> float:
    """Log-likelihood ratio (base 2) of a toxic and c clean documents against the toxic share."""
    n = a + c
    return sum(x * math.log2(x / (n * p)) for x, p in ((a, share), (c, 1 - share)) if x)


def _grams(word: str, known: set[str] | None = None) -> set[str]:
    """The n-grams of all its pieces, of P to LONGEST characters; given those that are known, only they. As a known
    gram's own grams are known, a longer one is looked for only behind a shorter one."""
    out = set()
    for piece in _pieces(word):
        for i in range(len(piece) - P + 1):
            for m in range(P, min(LONGEST, len(piece) - i) + 1):
                g = piece[i : i + m]
                if known is not None and g not in known:
                    break
                out.add(g)
    return out


def _landmarks(toxic: list[list[str]], clean: list[list[str]]) -> list[str]:
    """The n-gram with the most evidence, then the next in the words without it, and so on."""
    df = [Counter(), Counter()]
    for k, docs in enumerate((toxic, clean)):
        for words in docs:
            df[k].update({w.rstrip(TRAIL) for w in words})
    share = len(toxic) / (len(toxic) + len(clean))
    known: set[str] = set()
    counts: Counter = Counter()
    for m in range(P, LONGEST + 1):  # a gram is frequent only if the two in it are
        longer: Counter = Counter()
        for w, n in df[0].items():
            longer.update(dict.fromkeys({piece[i : i + m] for piece in _pieces(w) for i in range(len(piece) - m + 1) if m == P or piece[i : i + m - 1] in known and piece[i + 1 : i + m] in known}, n))
        longer = Counter({g: a for g, a in longer.items() if _bits(a, 0, share) >= LEAST_BITS})
        known |= longer.keys()
        counts.update(longer)
    against: Counter = Counter()
    for w, n in df[1].items():
        for g in _grams(w, known):
            against[g] += n
    left = {g: a for g, a in counts.items() if against[g] * len(toxic) * 20 <= a * len(clean)}
    inside = {w: own for w in df[0] if (own := _grams(w, known) & left.keys())}
    holders: dict[str, list[str]] = {g: [] for g in left}
    for w, own in inside.items():
        for g in own:
            holders[g].append(w)
    chosen: list[str] = []
    gone: set[str] = set()
    while left and len(chosen) < MOST_LANDMARKS:
        bits, g = max((_bits(a, against[g], share) * (1 + 0.02 * len(g)), g) for g, a in left.items())
        if bits < LEAST_BITS:
            break
        chosen.append(g)
        for w in holders[g]:
            if w not in gone:
                gone.add(w)
                for x in inside[w] & left.keys():
                    left[x] -= df[0][w]
        left = {x: a for x, a in left.items() if a > 0 and x != g}
    return chosen


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, loss: str, ridge: float) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine under squared hinge or logistic loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(40):
        m = y * (x @ w)
        if loss == "hinge":
            on = weight * (m < 1)
            g, h = -x.T @ (on * y * (1 - m)), (x * on[:, None]).T @ x
        else:
            p = 1 / (1 + np.exp(np.clip(m, -30, 30)))
            g, h = -x.T @ (weight * y * p), (x * (weight * p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(h + np.diag(keep) + 1e-9 * np.eye(len(w)), g + keep * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _changed(word: str) -> list[str]:
    """The word as it may be disguised: letters put in, doubled or changed. (Signs and digits put in are also read past, so
    they would add no evidence.)"""
    out = [put.join(word) for put in "xnueaz"] + [word + end for end in ("s", "en")]
    for cut in range(1, len(word)):
        head, tail = word[:cut], word[cut:]
        out += [head + "q" + tail, head + word[cut - 1] + tail, head + "zz" + tail, head + "1" + tail[1:], head + "xx" + tail[1:]]
    return out


def fit(texts: list[str], labels: list[int]) -> Model:
    """texts: a bounded sample. Deterministic."""
    toxic, clean = ([t for t, y in sorted(set(zip(texts, labels))) if y == k] for k in (1, 0))
    if not toxic or not clean:
        return Model(prior=1.0 if toxic and not clean else 0.0)
    landmarks = _landmarks([words_of(t) for t in toxic], [words_of(t) for t in clean])
    if not landmarks:
        return Model(prior=len(toxic) / (len(toxic) + len(clean)))
    gram_rows = _codes(landmarks)
    gram = np.stack([kernel(gram_rows, _codes([g])[0]) for g in landmarks], axis=1).astype(float)
    model = Model(landmarks, own=[float(x) for x in np.diag(gram)])
    toxic, clean = units(toxic, model), units(clean, model)
    scale = np.sqrt(np.diag(gram))
    value, vector = np.linalg.eigh(gram / scale / scale[:, None])
    whiten = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    marked = re.compile("|".join(map(re.escape, landmarks)))  # against START + word + END
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for d in toxic + clean for w in d))}
    table = model.features(list(vocabulary))
    rows: list[np.ndarray] = []
    signs: list[int] = []
    pooled = []
    for k, docs in ((1, toxic), (-1, clean)):
        for words in docs:
            if not words:
                pooled.append(np.zeros((1, len(landmarks)), np.float32))
                continue
            starts = _starts(_ends(words))
            sentences = np.maximum.reduceat(table[[vocabulary[w] for w in words]], starts, axis=0)
            pooled.append(sentences)
            if k < 0:
                rows.append(sentences)
                signs += [-1] * len(sentences)
            else:
                hit = np.add.reduceat(np.fromiter((bool(marked.search(START + w.rstrip(TRAIL) + END)) for w in words), np.int32, len(words)), starts) > 0
                rows.append(sentences[hit])
                signs += [1] * int(hit.sum())
    made = [w for g in model.bodies() for w in _changed(g)]
    rows.append(model.features(made))
    signs += [1] * len(made)
    x, y = np.vstack(rows).astype(float) @ whiten, np.array(signs)
    # of the weight, half is the clean sentences', three tenths the made ones'
    real = (y > 0) & (np.arange(len(y)) < len(y) - len(made))
    each = np.where(y < 0, 0.5 / max(1, (y < 0).sum()), np.where(real, 0.2 / max(1, real.sum()), 0.3 / max(1, len(made)))) * 1e4
    w = _newton(x, y, each, "hinge", 1.0)
    model.weights, model.bias = (whiten @ w[:-1]).astype(np.float32), float(w[-1])
    best = np.array([float((p @ model.weights).max()) + model.bias for p in pooled])
    label = np.array([1] * len(toxic) + [-1] * len(clean))
    ab = _newton(best[:, None], label, np.where(label > 0, 0.2 / len(toxic), 0.8 / len(clean)) * 1e3, "logistic", 1e-3)
    if ab[0] > 0:
        model.slope, model.bias = float(ab[0]), model.bias + float(ab[1] / ab[0])
    else:
        model.slope = 1.0
    return model


_memory: dict = {}


def forget() -> None:
    _memory.clear()


def score_texts(texts: list[str | None], model: Model, memory: dict | None = None) -> np.ndarray:
    """Whole texts. memory: word -> row of known features, kept between calls."""
    if not model.landmarks:
        return model.probability(np.zeros(len(texts)))
    memory = {} if memory is None else memory
    docs = units([t or "" for t in texts], model)
    words = {w for d in docs for w in d}
    new = list(words - memory.get("index", {}).keys())
    if "index" not in memory or len(memory["index"]) + len(new) > MOST_WORDS:
        # row 0: nothing in common with any landmark
        memory.update(index={}, rows=[np.zeros((1, len(model.landmarks)), np.float32)], n=1)
        new = list(words)
    index = memory["index"]
    for part in (new[i : i + 20_000] for i in range(0, len(new), 20_000)):
        rows = model.features(part)
        some = rows.any(axis=1)
        at = np.where(some, memory["n"] - 1 + np.cumsum(some), 0)
        index.update(zip(part, (2 * at + _ends(part)).tolist()))  # row, and whether a sentence ends
        memory["rows"].append(rows[some])
        memory["n"] += int(some.sum())
    memory["rows"] = [np.vstack(memory["rows"])]
    table, out = memory["rows"][0], np.full(len(texts), model.bias)
    for i, words in enumerate(docs):
        if words:
            at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            sentences = np.maximum.reduceat(table[at >> 1], _starts((at & 1).astype(bool)), axis=0)
            out[i] = float((sentences @ model.weights).max()) + model.bias
    return model.probability(out)


def sample(docs: DataFrame, labels: DataFrame, per_class: int, keep) -> tuple[list[str], list[int]]:
    """At most per_class documents of each class, of those with keep(id), least hashes of ids first. Of an id with both
    labels 1 counts, and of one with several texts the least of their hashes: so never more rows than ids."""
    ids = labels.select(F.col("doc_id").alias("id_"), F.col("toxic").cast("int").alias("y_")).filter(F.col("y_").isin(0, 1) & F.col("id_").isNotNull() & keep("id_"))
    ids = ids.groupBy("id_").agg(F.max("y_").alias("y_"))
    picked = None
    for y in (0, 1):
        own = ids.filter(F.col("y_") == y).orderBy(F.xxhash64("id_"), "id_").limit(per_class)
        picked = own if picked is None else picked.unionByName(own)
    rows = picked.collect()  # 2 * per_class ids at most
    if not rows:
        return [], []
    spark = docs.sparkSession
    wanted = spark.createDataFrame([tuple(r) for r in rows], picked.schema)
    got = docs.select(F.col("doc_id").alias("d_"), text_or_empty().alias("text")).join(F.broadcast(wanted), F.col("d_") == F.col("id_"))
    got = got.groupBy("id_", "y_").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    got = sorted((r["id_"], r["y_"], r["text"]) for r in got)
    return [t for _, _, t in got], [y for _, y, _ in got]


def _score_batch(texts: list[str | None], model: Model) -> np.ndarray:
    """In a worker: what it knows of words is kept as long as the model is the same."""
    key = (tuple(model.landmarks), model.bias, model.slope)
    if _memory.get("key") != key:
        _memory.clear()
        _memory["key"] = key
    return score_texts(texts, model, _memory)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_score_batch(part.column(1).to_pylist(), model), pa.float64())], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(run, forget), f"doc_id {kind}, score double")


def in_training(column: str):
    return F.pmod(crc_of_id(column), F.lit(5)) != 0


def trained(docs: DataFrame, labels: DataFrame, per_class: int = 800, keep=in_training) -> Model:
    return fit(*sample(docs, labels, per_class, keep))


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score is at least the threshold, row by row: no join, no shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                yield part.filter(pa.array(_score_batch(part.column(at).to_pylist(), model) < threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidied(run, forget), docs.schema)
