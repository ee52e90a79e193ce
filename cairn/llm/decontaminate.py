"""Benchmark decontamination by latent semantic retrieval.

The items are a stated query set: blocks of BLOCK items, each block being one pass over the documents.

1. Terms are the block's words; their document frequencies are counted over all documents (workers sum, then
   Spark). A term's weight is log(n / df), less log(1 / COMMON) where that leaves an item four terms.
2. A randomised singular value decomposition of the TF-IDF matrix of all passages, those of every document
   (which together count as DOCUMENTS of them where they are more) and of the items (these ITEM_WEIGHT times): the
   documents' terms of weight are written once, workers make their rows' A'(A Q), Spark sums
   these by blocks of terms, the driver orthonormalises terms x (RANK + 8) numbers; two power steps.
3. Index: every passage of every document. Windows of 8, 16, 32, ... words, a quarter apart; a window's
   latent vector is a difference of running sums of its terms' vectors. Items meet windows of the nearest size;
   pairs of cosine at least LEAST_COSINE are candidates, all of them.
4. A candidate's surroundings are compared with the item word by word: a longest common subsequence of PASSAGE
   of the item's words is a leak; so is one of PARAPHRASE of them if the answer is there too (the item's
   `answer` column, else its last fifth), as a common subsequence of ANSWER of its words within twice its length.
   Either needs TELLING of the item's terms of weight there, so that common words alone make no leak.

Words: A-Z lower-cased, split at white space. Null or empty texts and items: no leaks. Rows that repeat each give
their leaks. Empty tables: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

RANK, DOCUMENTS, BLOCK, ITEM_WEIGHT, COMMON = 96, 4_000, 4_096, 3.0, 0.02
LEAST_COSINE, PASSAGE, PARAPHRASE, ANSWER, TELLING = 0.6, 0.7, 0.5, 0.8, 0.5
PART = 512  # terms in a block that is summed at once
SEGMENT = 16_384  # words of a document that are looked at together
LENGTH = 40  # words of a passage of the matrix


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def terms_of(words: list[bytes], terms: dict[bytes, int]) -> np.ndarray:
    """Ids of the words, -1 for others than the terms."""
    return np.fromiter(map(terms.get, words, repeat(-1)), np.int64, len(words))


def document_frequencies(docs: DataFrame, terms: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Of each term over all documents, and how many documents there are."""
    size = len(terms)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, terms = np.zeros(size + 1, np.int64), shared.value
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                found = [[terms[w] for w in terms.keys() & set(words_of(t))] for t in part.column(0).to_pylist()]
                total[:size] += np.bincount(np.fromiter(chain.from_iterable(found), np.int64), minlength=size)
                total[size] += len(found)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row per term
    out = np.zeros(size + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:size], int(out[size])


def weights_of(df: np.ndarray, n: int, items: list[np.ndarray]) -> np.ndarray:
    plain = np.log((1.0 + n) / (1.0 + df))
    out = np.maximum(0.0, plain + np.log(COMMON))
    for own in items:
        if (out[own] > 0).sum() < 4:
            out[own] = np.maximum(out[own], np.maximum(plain[own], 0.1))
    return out


def _passages(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all LENGTH words, without other words, and how many each of these passages has (none has none)."""
    at = np.flatnonzero(terms >= 0)
    first = np.flatnonzero(np.diff(at // LENGTH, prepend=-1))
    return terms[at], np.diff(first, append=len(at))


def _rows(terms: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each entry, term, value: TF-IDF, each row of length 1."""
    size = len(weights)
    key, n = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + terms, return_counts=True)
    row, term = key // size, key % size
    w = n * weights[term]
    norm = np.sqrt(np.bincount(row, w * w, len(lengths)))
    return row, term, w / np.where(norm > 0, norm, 1)[row]


def _gram_times(terms: np.ndarray, lengths: np.ndarray, weights: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'(A q) of the passages' matrix A. q and the result are transposed: a column's numbers lie together."""
    out = np.zeros_like(q)
    if len(lengths):
        row, term, w = _rows(terms, lengths, weights)
        own, at = np.unique(term, return_inverse=True)
        for k, column in enumerate(q[:, own]):
            y = np.bincount(row, w * column[at], len(lengths))
            out[k, own] = np.bincount(at, w * y[row], len(own))
    return out


def passage_terms(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """Of every passage of all documents the terms, written: a row for some hundred documents, with all terms and each passage's number of them."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                found, lengths = [], []
                for text in part.column(0).to_pylist():
                    own, n = _passages(terms_of(words_of(text), terms))
                    found.append(own)
                    lengths.append(n)
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).astype("<u4").tobytes()], pa.binary()) for x in (found, lengths)], ["terms", "lengths"])

    return written(docs.select("text").mapInArrow(run, "terms binary, lengths binary"), "lsi-passages")


def latent_basis(docs: DataFrame, terms: dict[bytes, int], items: list[np.ndarray], weights: np.ndarray, n_docs: int, rank: int = RANK, steps: int = 2) -> np.ndarray:
    """terms x rank: the leading right singular vectors of the TF-IDF matrix."""
    size = len(terms)
    width, rank = min(size, rank + 8), min(size, rank)
    share = min(1.0, DOCUMENTS / max(1, n_docs))
    # terms without weight add nothing; few tasks, as each gives a sum for every term
    passages = passage_terms(docs, {w: t for w, t in terms.items() if weights[t] > 0}).coalesce(max(8, n_docs // 100_000))
    own = [np.concatenate(x) for x in zip(*map(_passages, items))]
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((size, width)))[0]
    for step in range(steps + 1):
        shared = docs.sparkSession.sparkContext.broadcast((weights, q.T.copy()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weights, q = shared.value
            total = np.zeros_like(q)
            for batch in batches:
                for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total += _gram_times(*(np.frombuffer(x, "<u4").astype(np.int64) for x in row), weights, q)
            total = np.ascontiguousarray(total.T)
            at = range(0, len(total), PART)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([total[i : i + PART].tobytes() for i in at], pa.binary())], ["part", "sum"])

        def add(key: tuple, group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b, np.float64) for b in group.column("sum").to_pylist())
            return pa.table({"part": [key[0].as_py()], "sum": [total.tobytes()]}, schema=pa.schema([("part", pa.int32()), ("sum", pa.binary())]))

        parts = passages.mapInArrow(run, "part int, sum binary").groupBy("part").applyInArrow(add, "part int, sum binary").collect()
        z = _gram_times(*own, weights, q.T).T * ITEM_WEIGHT**2
        for r in parts:
            z[r["part"] : r["part"] + PART] += share * np.frombuffer(r["sum"], np.float64).reshape(-1, width)
        shared.unpersist()
        if step < steps:
            q = np.linalg.qr(z)[0]
    _, vector = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    return q @ vector[:, ::-1][:, :rank]


def common_subsequence(places: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of n words, whose places (bits) are given, and words."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := places.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def places_of(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Index:
    """The items' side, sent to the workers."""

    def __init__(self, items: list[tuple[int, str, str | None]], terms: dict[bytes, int], vectors: np.ndarray) -> None:
        known = np.flatnonzero(vectors.any(axis=1))
        at = {int(t): i for i, t in enumerate(known)}
        # only terms of some weight are looked up
        self.terms = {w: at[t] for w, t in terms.items() if t in at}
        self.vectors = vectors[known]
        self.ids, self.items = [], []
        rows: dict[int, list[int]] = {}
        latent = []
        for item_id, text, answer in items:
            words = words_of(text)
            if not words:
                continue
            last = words_of(answer) or words[-max(3, len(words) // 5) :]
            rows.setdefault(max(8, 1 << round(float(np.log2(len(words))))), []).append(len(self.ids))
            self.ids.append(item_id)
            self.items.append((places_of(words), len(words), places_of(last), len(last)))
            own = terms_of(words, self.terms)
            x = self.vectors[own[own >= 0]].sum(axis=0)
            latent.append(x / (np.linalg.norm(x) or 1))
        self.sizes = {size: (np.array(own), np.array([latent[i] for i in own], np.float32).T.copy()) for size, own in rows.items()}
        self.reach = 2 * max([n for _, n, _, _ in self.items], default=0)

    def candidates(self, terms: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, size, cosine) of all pairs of cosine at least LEAST_COSINE."""
        hits = np.flatnonzero(terms >= 0)
        if not len(hits):
            return []
        sums = np.zeros((len(hits) + 1, self.vectors.shape[1]), np.float64)
        np.cumsum(self.vectors[terms[hits]], axis=0, out=sums[1:])
        out = []
        for size, (own, latent) in self.sizes.items():
            starts = np.append(np.arange(0, max(1, len(terms) - size), size // 4), max(0, len(terms) - size))
            first, last = np.searchsorted(hits, starts), np.searchsorted(hits, starts + size)
            some = last - first > 1  # an item has two terms of weight in half of it at least, or else all its words
            x = (sums[last[some]] - sums[first[some]]).astype(np.float32)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            cosine = (x @ latent) / np.where(norm > 0, norm, 1)[:, None]
            for s, i in zip(*np.nonzero(cosine >= LEAST_COSINE)):
                out.append((int(own[i]), int(starts[some][s]), size, float(cosine[s, i])))
        return out

    def leaks(self, text: str | None) -> dict[int, tuple[float, float, bool]]:
        """item -> (cosine, share of its words in common, whether the answer is there) of a whole text's leaks."""
        words = words_of(text)
        found: dict[int, tuple[float, float, bool]] = {}
        for at in range(0, len(words), SEGMENT):
            segment = words[at : at + SEGMENT + self.reach]
            for item, start, size, cosine in self.candidates(terms_of(segment, self.terms)):
                if item in found and found[item][1] == 1.0:
                    continue
                places, n, answer, m = self.items[item]
                around = segment[max(0, start - n // 2) : start + size + n // 2]
                words_here = set(around)
                if len(places.keys() & words_here) + n - len(places) < PARAPHRASE * n:
                    continue  # so the common subsequence is shorter too
                telling = [w for w in places if w in self.terms]
                if sum(w in words_here for w in telling) < TELLING * len(telling):
                    continue  # what they share are words of all texts
                share = common_subsequence(places, n, around) / n
                if share < PARAPHRASE:
                    continue
                answered = any(common_subsequence(answer, m, around[i : i + 2 * m]) >= ANSWER * m for i in range(0, max(1, len(around) - m), max(1, m // 2)))
                if share >= PASSAGE or answered:
                    found[item] = max(found.get(item, (0.0, 0.0, False)), (cosine, share, answered), key=lambda x: (x[1], x[0]))
            if at + SEGMENT + self.reach >= len(words):
                break
        return found


def build(docs: DataFrame, bench: DataFrame) -> list[Index]:
    """One index per block of items."""
    columns = [F.col("item_id").cast("long"), text_or_empty().alias("text"), F.col("answer") if "answer" in bench.columns else F.lit(None).cast("string").alias("answer")]
    rows = bench.select(*columns).distinct().orderBy("item_id", "text").toLocalIterator()
    return [_index(docs, [tuple(r) for r in block]) for block in iter(lambda: list(islice(rows, BLOCK)), [])]


def _index(docs: DataFrame, items: list[tuple[int, str, str | None]]) -> Index:
    terms: dict[bytes, int] = {}
    own = []
    for _, text, _ in items:
        words = words_of(text)
        for w in words:
            terms.setdefault(w, len(terms))
        own.append(terms_of(words, terms))
    if not terms:
        return Index([], {}, np.zeros((0, 1), np.float32))
    df, n = document_frequencies(docs, terms)
    weights = weights_of(df, n, own)
    return Index(items, terms, (weights[:, None] * latent_basis(docs, terms, own, weights, n)).astype(np.float32))


def leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_found: one row for each item that leaked into a document."""
    spark, names = docs.sparkSession, ["doc_id", "item_id", "cosine", "lcs_share", "answer_found"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, cosine double, lcs_share double, answer_found boolean"
    out = spark.createDataFrame([], schema)
    for k, index in enumerate(build(docs, bench)):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    rows += [(doc_id.as_py(), index.ids[i], *x) for i, x in sorted(index.leaks(text.as_py()).items())]
                if rows:
                    kinds = (batch.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = out.union(found) if k else found
    return out


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without the rows that hold a leak, row by row: no join, no shuffle."""
    for index in build(docs, bench):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not shared.value.leaks(t.as_py()) for t in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
