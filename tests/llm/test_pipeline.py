import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from cairn.llm import decontaminate

from .helpers import docs

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_their_predecessors_kept(spark, tmp_path):
    for name in ("labels", "benchmark"):
        pq.write_table(pq.read_table(f"{SF}/{name}.parquet"), tmp_path / f"{name}.parquet")
    source = pq.read_table(f"{SF}/documents.parquet")
    pq.write_table(source, tmp_path / "documents.parquet")
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, n = d.columns, d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, d, str(tmp_path))
        assert after.columns == columns, name
        after.write.parquet(str(tmp_path / f"{name}.out"))
        d = spark.read.parquet(str(tmp_path / f"{name}.out"))
        assert d.count() > 0.5 * n
    out = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).collect()
    assert len(out) == d.count() and sorted(r["start"] for r in out)[0] == 0
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in out)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_stages_of_an_empty_table(spark, tmp_path):
    for name in ("labels", "benchmark"):
        pq.write_table(pq.read_table(f"{SF}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    d = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, str(tmp_path)).count() == 0
    assert pa.__version__


def test_basis_of_the_stage_is_that_of_all_its_documents(spark, tmp_path, monkeypatch):
    """More than DOCUMENTS of them, whose words change with the row: the basis by which the pipeline's stage searches is what the iteration finds in the matrix of all their passages."""
    rnd = random.Random(9)
    items = [[f"t{i}" for i in rnd.sample(range(900), 30)] for _ in range(30)]
    texts = [" ".join(rnd.choice(["the", f"t{(d // 7 + int(rnd.expovariate(0.01))) % 900}"]) for _ in range(rnd.randint(0, 60))) for d in range(6000)]
    leaked = set(range(37, 6000, 600))
    for d in leaked:
        texts[d] += " " + " ".join(items[d % 30])
    pq.write_table(pa.table({"item_id": pa.array(range(30), pa.int64()), "text": [" ".join(x) for x in items]}), tmp_path / "benchmark.parquet")
    made, real = [], decontaminate.latent_basis

    def recorded(docs, terms, items, weights, n_docs):
        made.append((terms, weights, n_docs, real(docs, terms, items, weights, n_docs)))
        return made[-1][-1]

    monkeypatch.setattr(decontaminate, "latent_basis", recorded)
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["decontamination"](spark, docs(spark, texts), str(tmp_path)).select("doc_id").collect()}
    assert kept == set(range(6000)) - leaked
    [(terms, weights, n_docs, got)] = made
    assert n_docs == 6000 and (weights > 0).sum() > 300

    def gram(rows):
        a = np.zeros((len(rows), len(terms)))
        for row, words in zip(a, rows):
            np.add.at(row, [terms[w] for w in words if w in terms], 1.0)
        a *= weights
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        return a.T @ a

    def cut(text):
        words = text.encode().split()
        return [words[s : s + 40] for s in range(0, len(words), 40)]

    whole = gram([p for t in texts for p in cut(t)]) * decontaminate.DOCUMENTS / 6000 + gram([p for x in items for p in cut(" ".join(x))]) * decontaminate.ITEM_WEIGHT**2
    q = np.random.default_rng(5).standard_normal((len(terms), decontaminate.RANK + 8))
    for _ in range(3):
        q = np.linalg.qr(q)[0]
        z = q
        q = whole @ q
    vector = np.linalg.eigh(z.T @ whole @ z)[1]
    best = z @ vector[:, ::-1][:, : decontaminate.RANK]
    assert np.abs(got @ got.T - best @ best.T).max() < 1e-6
