"""The pipeline's final rows against plain Python and DuckDB, stage for stage, on documents with planted cases."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import decontaminate, mixing
from cairn.llm.queries import tokenizer

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
INSULTS = ["idiot", "moron", "scumbag", "worthless"]


def planted():
    """(documents, ids of toxic ones, benchmark items)."""
    rnd = random.Random(77)
    vocabulary = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeou") for _ in range(rnd.randint(1, 4))) for _ in range(4000)]
    body = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [body(rnd.randint(20, 40)) for _ in range(12)]
    texts, toxic = {}, set()
    for i in range(260):
        words = body(rnd.randint(30, 120))
        if i % 6 == 1:
            toxic.add(i)
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(INSULTS)
        if i % 11 == 2:
            at, item = rnd.randrange(len(words)), items[i % 12]
            words[at:at] = item if i % 2 else [w if rnd.random() > 0.1 else rnd.choice(vocabulary) for w in item]
        texts[i] = words
    for i in range(0, 260, 4):  # copies: like each other, near 0.8, and less
        for k in range(1 + i % 3):
            words = list(texts[i])
            for _ in range((i // 4 + 3 * k) % 8):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts[300 + 4 * i + k] = words
            if i in toxic:
                toxic.add(300 + 4 * i + k)
    rows = [(i, " ".join(w), "en", ("b", "hot", "hot", None, "a")[i % 5]) for i, w in texts.items()]
    rows += [(5000, None, "en", "a"), (5001, "", None, "hot"), (5002, "  ", "en", None)]
    rnd.shuffle(rows)
    return rows, toxic, [" ".join(x) for x in items]


def near_classes(texts):
    """Least id of each group of texts linked by five-word shingles at 80 %, from all pairs."""
    sets = {}
    for i, t in texts.items():
        words = (t or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    least = {i: i for i in texts}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: root(i) for i in texts}


def holds_an_item(text, items):
    words = decontaminate.words_of(text)
    for item in items:
        m = decontaminate.words_of(item)
        places = decontaminate.places_of(m)
        if any(decontaminate.common_subsequence(places, len(m), words[s : s + len(m) + len(m) // 4]) >= decontaminate.PASSAGE * len(m) for s in range(len(words))):
            return True
    return False


def test_final_rows_against_brute_force(spark, tmp_path):
    rows, toxic, items = planted()
    columns = [list(c) for c in zip(*rows)]
    write = lambda name, t: pq.write_table(t, tmp_path / f"{name}.parquet")
    write("documents", pa.table([*columns, [len(t or "") for t in columns[1]]], schema=SCHEMA))
    write("labels", pa.table({"doc_id": pa.array(columns[0], pa.int64()), "toxic": pa.array([int(i in toxic) for i in columns[0]], pa.int32())}))
    write("benchmark", pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": items}))

    docs = {r[0]: r for r in rows if r[0] not in toxic}
    classes = near_classes({i: r[1] for i, r in docs.items()})
    single = {i: r for i, r in docs.items() if classes[i] == i}
    clean = {i: r for i, r in single.items() if not holds_an_item(r[1], items)}
    assert len(docs) - len(single) > 30 and len(single) - len(clean) > 10  # there is something to do

    con = duckdb.connect()
    documents = pa.table([*[list(c) for c in zip(*clean.values())], [len(r[1] or "") for r in clean.values()]], schema=SCHEMA)
    con.register("documents", documents)
    copies = dict(con.execute(f"SELECT doc_id, n_copies FROM ({mixing.ORACLE})").fetchall())
    encoder, at, want = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), 0, []
    for i in sorted(clean):
        ids = [*encoder.encode(clean[i][1] or "", add_special_tokens=False).ids, 2]
        for _ in range(copies[i]):
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)

    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
