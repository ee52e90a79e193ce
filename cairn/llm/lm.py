"""Language-model scores: prediction by partial matching over bytes, and a word baseline.

The byte model is a trie of contexts of up to `order` symbols over 257 symbols (the bytes and an edge, which stands
`order` times before a text and once behind it), counted over all training texts. A symbol not seen in a context is
reached by an escape (as many escape counts as different symbols seen there), and in the shorter context the
symbols of the longer are excluded; behind the empty context stands a uniform choice of what was never seen.
As the trie is fixed when it scores, a symbol's code length depends on its `order` predecessors only, so it is made
once for each different gram (these and the symbol), and a text's score is a sum of look-ups.

With two symbols all codes are tabled in each worker (257**3 at most). Longer contexts grow with the corpus and
are tables of Spark: texts are written in parts, a pass makes each part's different grams, and their training counts
are summed. Grams of one context of three symbols stand together, so that all longer contexts are coded there; of
the shorter ones the 257**3 counts go to all workers. The codes are joined with each part's grams and
sorted before its texts, so a worker holds the codes of one part only. A gram of up to seven symbols is a number of 64 bits.

The baseline needs every word's count. Words (64-bit hashes) are counted over the corpus in a table; the TOP most
frequent go to all workers, and only the others' occurrences are joined with the table, so a frequent word is
never a join key. Counts, V and N are over all training texts.

Nulls: a null text counts as empty; a null id's crc is that of the empty text. Rows that repeat stay rows (each has a number of its own).
Without training rows every count is 0. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, small_batches, text_or_empty, tidied, written

A = 257
EDGE = 256
TOP = 262_144
ORDER = 4
MOST_ORDER = 6  # 257**7 < 2**63
END = xxhash.xxh3_64_intdigest(b" ") - 2**63  # no word is a blank
_tables: dict = {}


def forget() -> None:
    _tables.clear()


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of (two predecessors, symbol) at all places of all texts, and where each text starts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 3
    ends = np.cumsum(lengths)
    x = np.full(int(ends[-1]) if len(ends) else 0, EDGE, np.int32)
    inner = np.ones(len(x), np.bool_)
    for e in (ends - lengths, ends - lengths + 1, ends - 1):
        inner[e] = False
    x[inner] = np.frombuffer(b"".join(texts), np.uint8)
    ids = (x[:-2] * A + x[1:-1]) * A + x[2:]
    keep = np.ones(len(ids), np.bool_)
    keep[(ends - 2)[:-1]] = keep[(ends - 1)[:-1]] = False  # places of the next text's edges
    return ids[keep], np.concatenate([[0], np.cumsum(lengths - 2)])[:-1]


def code_table(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 probability of each trigram id."""
    full = np.zeros(A**3, np.float64)
    full[ids] = counts
    n2 = full.reshape(A, A, A)
    n1 = n2.sum(axis=0)
    n0 = n1.sum(axis=0)
    t1, s1 = n1.sum(axis=1, keepdims=True), n1 > 0
    q1 = s1.sum(axis=1, keepdims=True)

    def log(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
        """log10 of a share; 0 where there's nothing to share."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(bottom > 0, np.log10(np.where(bottom > 0, top, 1) / np.where(bottom > 0, bottom, 1)), 0.0)

    def empty_context(excluded: np.ndarray) -> np.ndarray:
        """By rows of excluded symbols."""
        seen = n0 > 0
        t = (n0 * ~excluded).sum(axis=-1, keepdims=True)
        q = (seen & ~excluded).sum(axis=-1, keepdims=True)
        never = A - seen.sum()
        all_ = t + (q if never else 0)
        return np.where(seen, log(n0, all_), log(q, all_) - (np.log10(never) if never else 0))

    after1 = empty_context(s1)
    bare = empty_context(np.zeros((1, A), np.bool_))
    with1 = np.where(t1 > 0, np.where(s1, log(n1, t1 + q1 * (q1 < A)), log(q1, t1 + q1) + after1), bare)
    out = np.empty((A, A, A), np.float32)
    for a in range(A):
        n = n2[a]
        t2 = n.sum(axis=1, keepdims=True)
        if not t2.any():
            out[a] = with1
            continue
        s2 = n > 0
        q2 = s2.sum(axis=1, keepdims=True)
        t, q = t1 - (n1 * s2).sum(axis=1, keepdims=True), q1 - q2
        below = np.where(s1, log(n1, t + q * (q1 < A)), log(q, t + q) + after1)
        out[a] = np.where(t2 > 0, np.where(s2, log(n, t2 + q2 * (q2 < A)), log(q2, t2 + q2) + below), with1)
    return out.reshape(-1)


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of (`order` predecessors, symbol) at all places of all texts, and where each text starts."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(n + order + 1)
    x = np.full(int(ends[-1]) if len(ends) else 0, EDGE, np.int64)
    inner = np.repeat(np.arange(len(texts)) * (order + 1) + order, n) + np.arange(int(n.sum()))
    x[inner] = np.frombuffer(b"".join(texts), np.uint8)
    places = np.zeros(len(x), np.bool_)
    places[inner] = places[ends - 1] = True
    ids = np.zeros(max(0, len(x) - order), np.int64)
    for k in range(order + 1):
        ids = ids * A + x[k : k + len(ids)]
    return ids[places[order:]], np.concatenate([[0], np.cumsum(n + 1)])[:-1]


def trie_tables(ids: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """From the trigrams' counts, for contexts of 0, 1 and 2 symbols: ids and counts of the seen grams (in order), and of
    each context the sum, the different symbols, and the sum that the next shorter context gives to these symbols."""
    order = np.argsort(ids)
    keys, n = ids[order].astype(np.int64), counts[order].astype(np.int64)
    levels = [(keys, n)]
    for k in (2, 1):
        keys, where = np.unique(levels[0][0] % A**k, return_inverse=True)
        levels.insert(0, (keys, np.bincount(where, levels[0][1], len(keys)).astype(np.int64)))
    out = []
    for k, (keys, n) in enumerate(levels):
        below = levels[k - 1][1][np.searchsorted(levels[k - 1][0], keys % A**k)] if k else np.zeros(len(keys))
        out.append((keys, n, *(np.bincount(keys // A, w, A**k) for w in (n, n > 0, below))))
    return out


def _found(keys: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts of the wanted ids; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, n[at], 0)


def deep_codes(ids: np.ndarray, counts: np.ndarray, order: int, short: list[tuple]) -> np.ndarray:
    """log10 probability of each gram. ids: different, with training counts (0 as well), all of those that share
    their last three symbols of context; short: trie_tables."""
    # per level from the longest: the gram's count, and its context's sum, symbols, and these symbols' sum one level below
    levels, keys, n, back = [], ids, counts, np.arange(len(ids))
    for k in range(order, 2, -1):
        _, own = np.unique(keys // A, return_inverse=True)
        less, up = np.unique(keys % A**k, return_inverse=True)
        fewer = np.bincount(up, n, len(less)) if k > 3 else _found(short[2][0], short[2][1], less)
        t, q, r = (np.bincount(own, w) for w in (n, n > 0, np.where(n > 0, fewer[up], 0)))
        levels.append((n[back], t[own][back], q[own][back], r[own][back]))
        keys, n, back = less, fewer, up[back]
    for k in (2, 1, 0):
        seen, n, t, q, r = short[k]
        own = ids % A ** (k + 1)
        levels.append((_found(seen, n, own), t[own // A], q[own // A], r[own // A]))
    code, active = np.zeros(len(ids)), np.ones(len(ids), np.bool_)
    taken_t, taken_q = np.zeros(len(ids)), np.zeros(len(ids))  # what the longer context excludes
    for n, t, q, r in levels:
        left, kinds = t - taken_t, q - taken_q
        hit, escape = active & (n > 0), active & (n == 0) & (t > 0) & (kinds > 0)
        code[hit] += np.log10(n[hit] / (left + kinds * (q < A))[hit])
        code[escape] += np.log10(kinds[escape] / (left + kinds)[escape])
        active &= n == 0
        taken_t, taken_q = r, q
    code[active] -= np.log10(max(1, A - len(short[0][0])))
    return code


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    words = [t.lower().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(n.sum()))
    return (h ^ np.uint64(1 << 63)).view(np.int64), n


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def corpus_counts(train: DataFrame) -> DataFrame:
    """kind (0 words, 1 trigrams), key, n over all texts: workers merge what they count, then Spark does."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = _texts(part.column(0))
                h, _ = _hashes(texts)
                held[0].append(np.unique(np.concatenate([h, np.full(len(texts), END)]), return_counts=True))
                held[1].append(np.unique(trigrams(texts)[0], return_counts=True))
                for k in (0, 1):
                    if len(held[k]) == 8:
                        held[k][:] = [merged(held[k])]
        for k in (0, 1):
            if held[k]:
                keys, n = merged(held[k])
                for i in range(0, len(keys), 100_000):
                    own = keys[i : i + 100_000].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int8)), pa.array(own), pa.array(n[i : i + 100_000])], ["kind", "key", "n"])

    rows = train.select(text_or_empty().alias("text")).mapInArrow(tidied(run), "kind byte, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _part_grams(texts: DataFrame, order: int) -> DataFrame:
    """part, gram, n: the different grams of each part's texts, and how often its training texts have them."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    def rows(part: int, held: list) -> Iterator[pa.RecordBatch]:
        keys, n = merged(held)
        for i in range(0, len(keys), 100_000):
            own = keys[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, np.int32)), pa.array(own), pa.array(n[i : i + 100_000])], ["part", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, []
        for batch in batches:
            for few in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                parts, train = few.column(2).to_numpy(), ~few.column(1).to_numpy(zero_copy_only=False)
                texts = _texts(few.column(0))
                for own in np.unique(parts):
                    if own != part and held:
                        yield from rows(part, held)
                        held = []
                    part = int(own)
                    for kind in (False, True):
                        keys, n = np.unique(grams([texts[i] for i in np.flatnonzero((parts == own) & (train == kind))], order)[0], return_counts=True)
                        held.append((keys, n * kind))
                    if len(held) >= 16:
                        held = [merged(held)]
        if held:
            yield from rows(part, held)

    return texts.select("text", "held_out", "part").mapInArrow(tidied(run), "part int, gram long, n long")


def _codes(counts: DataFrame, order: int, short) -> DataFrame:
    """gram, code of counted grams (gram, n); short: trie_tables, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def coded(last: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[:last]), pa.array(deep_codes(keys[:last], n[:last], order, short.value))], ["gram", "code"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([n, batch.column(1).to_numpy()])
            # whole contexts only; the last one may go on
            context = keys // A % A**3
            last = int(np.flatnonzero(context != context[-1])[-1]) + 1 if context[0] != context[-1] else 0
            if last >= 50_000:
                yield coded(last)
                keys, n = keys[last:], n[last:]
        if len(keys):
            yield coded(len(keys))

    context = F.expr(f"(gram div {A}) % {A**3}")
    return counts.select("gram", "n", context.alias("context")).repartition("context").sortWithinPartitions("context").select("gram", "n").mapInArrow(tidied(run), "gram long, code double")


def scores(docs: DataFrame, held_out: Column, top: int = TOP, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Trains on rows not held out."""
    if not 2 <= order <= MOST_ORDER:
        raise ValueError(f"contexts of 2 to {MOST_ORDER} symbols")
    spark = docs.sparkSession
    small_batches(spark, 4096)
    # written with a number of its own for each row, so that rows of like ids and texts stay apart
    d = docs.select("doc_id", text_or_empty().alias("text"), held_out.alias("held_out"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rid"))
    d = written(d, "lm-texts")
    counts = written(corpus_counts(d.filter(~F.col("held_out"))), "lm-counts")
    words = counts.filter("kind = 0").select(F.col("key").alias("word"), "n")
    v, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    trie = counts.filter("kind = 1").select("key", "n").toArrow()  # 257 ** 3 rows at most
    often = words.orderBy(F.col("n").desc(), "word").limit(top).toArrow().sort_by("word")
    trie_ids, trie_n = trie["key"].to_numpy().astype(np.int32), trie["n"].to_numpy()
    bound = spark.sparkContext.broadcast((trie_ids, trie_n, often["word"].to_numpy(), often["n"].to_numpy()))
    below = float(np.log10(total + v + 1))

    def short_coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows of texts, with what codes their places."""
        ids, n, _, _ = bound.value
        key = (total, v, len(ids), int(n.sum()), int((ids.astype(np.int64) * n).sum()))
        if key not in _tables:
            _tables.clear()
            _tables[key] = code_table(ids, n)
        table = _tables[key]

        def code(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids, starts = trigrams(texts)
            return table[ids].astype(np.float64), starts

        for batch in batches:
            yield batch, code

    def deep_coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The same; before a part's texts come its codes, in the order of the grams."""
        now, held, table = None, [], None

        def code(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids, starts = grams(texts, order)
            return table[1][np.searchsorted(table[0], ids)], starts

        for batch in batches:
            parts = batch.column("part").to_numpy()
            coded = batch.column("gram").is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | (coded[1:] != coded[:-1])) + 1), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                if parts[a] != now:
                    now, held, table = parts[a], [], None
                if coded[a]:
                    held.append((own.column("gram").to_numpy(), own.column("code").to_numpy()))
                else:
                    if table is None:
                        table, held = tuple(np.concatenate(x) for x in zip(*held)), []
                    yield own, code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, known, known_n = bound.value
        gain = np.log10(known_n + 1.0)
        for batch, code in (deep_coded if order > 2 else short_coded)(batches):
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = _texts(part.column(1))
                codes, starts = code(texts)
                score = np.add.reduceat(codes, starts)
                h, n_words = _hashes(texts)
                owner = np.repeat(np.arange(len(texts)), n_words)
                h, owner = np.concatenate([h, np.full(len(texts), END)]), np.concatenate([owner, np.arange(len(texts))])
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[at] == h if len(known) else np.zeros(len(h), np.bool_)
                base = np.bincount(owner[hit], gain[at[hit]], len(texts)) - (n_words + 1) * below
                n_known = np.bincount(owner[hit], minlength=len(texts))
                rid, rest = part.column("rid").to_numpy(), ~hit
                tail = int(rest.sum())
                null = lambda kind: pa.nulls(tail, kind)
                both = lambda a: pa.chunked_array([a, null(a.type)]).combine_chunks()
                head = [part.column(0), part.column(2), pa.array(n_words + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score)]
                # a row for the text, and one for each occurrence of a word that is not among the most frequent
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rid, rid[owner[rest]]])), pa.array(np.concatenate([rid, h[rest]])), *map(both, head)], ["rid", "word", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    if order > 2:
        used = written(_part_grams(d, order), "lm-grams")
        codes = _codes(used.groupBy("gram").agg(F.sum("n").alias("n")), order, spark.sparkContext.broadcast(trie_tables(trie_ids, trie_n)))
        own = used.select("part", "gram").join(written(codes, "lm-codes"), "gram")
        d = d.unionByName(own, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", F.col("gram").asc_nulls_last())
    rows = d.mapInArrow(tidied(run, forget), f"rid long, word long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
    joined = rows.join(words, "word", "left")
    tail = F.col("n_tokens").isNull()
    by_text = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.max("score").alias("score"),
        F.max("n_known").alias("often"), F.count(F.when(tail, F.col("n"))).alias("seldom"),
        F.max("base").alias("base"), F.sum(F.when(tail, F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)))).alias("gain"),
    )
    return by_text.select(
        "doc_id", "held_out", "n_tokens", (F.col("often") + F.col("seldom")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), "score",
    )


def is_held_out(column: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(column), F.lit(7)) == 2
