import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from cairn.llm.common import Scratch
from cairn.llm import decontaminate, fingerprints, lm, minhash, personal_data, token_counts, token_files, toxicity
from cairn.llm.queries import tokenizer

from .helpers import AWKWARD, docs

CYRILLIC = "Привет, мир. <|endoftext|> </s> ▁x  two  blanks"


# ---- token counts


def test_counts_are_the_librarys(spark, tmp_path):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    texts = [*AWKWARD, CYRILLIC, *AWKWARD]
    cache = f"file://{tmp_path}/cache"
    got = sorted(token_counts.token_counts(docs(spark, texts), path, cache).collect())
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got] == [(len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for t in texts]
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in texts})
    # a second run finds all of these in the cache and appends only what is new
    token_counts.token_counts(docs(spark, [*texts, "quite new"]), path, cache).collect()
    assert spark.read.parquet(cache).count() == stored.count() + 1
    assert token_counts.token_counts(docs(spark, []), path).count() == 0


def test_counts_with_a_tokenizers_file(spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    got = sorted(token_counts.token_counts(docs(spark, [*AWKWARD, CYRILLIC]), path).collect())
    t = Tokenizer.from_file(path)
    assert [r["n_tokens"] for r in got] == [len(t.encode(x or "", add_special_tokens=False).ids) for x in [*AWKWARD, CYRILLIC]]


def test_counts_of_hot_digests_and_repeated_ids(spark):
    # one digest has over half of the rows; more digests than may be hot; ids repeat and one is null
    ids = [*range(3000), *range(3000), None]
    rows = spark.createDataFrame([(d, 1, (f"{i % 2500}" if i % 2 else "hot").encode()) for i, d in enumerate(ids)], "doc_id long, n_bytes long, digest binary").cache()
    counts = spark.createDataFrame([(str(k).encode(), k) for k in range(2500)] + [(b"hot", 7)], "digest binary, n_tokens long")
    got = sorted(token_counts.join_counts(rows, counts).select("doc_id", "n_tokens").collect(), key=str)
    assert [tuple(r) for r in got] == sorted(((d, i % 2500 if i % 2 else 7) for i, d in enumerate(ids)), key=lambda r: str(spark_row(r)))
    rows.unpersist()


def spark_row(r):
    return Row(doc_id=r[0], n_tokens=r[1])


# ---- token files


def test_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    texts = [*AWKWARD, CYRILLIC, "it's wor'ld. a1, _x_"]
    frame = docs(spark, texts, ids=[7 * i % 101 for i in range(len(texts))])
    got = sorted(token_files.encode_and_read(frame, path, f"file://{tmp_path}/ids").collect())
    t, at, want = Tokenizer.from_file(path), 0, []
    for i, x in sorted((7 * i % 101, x) for i, x in enumerate(texts)):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    # standard readers see only the ids; a damaged frame is noticed; one document needs one frame
    import zstandard

    file = sorted((tmp_path / "ids").glob("ids-*.zst"))[0].read_bytes()
    reader = token_files.FrameReader(lambda s, n: file[s : s + n], len(file))
    whole = np.concatenate([x for _, x in reader.documents()])
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(file) == whole.tobytes()
    damaged = bytearray(file)
    damaged[int(reader.table[0][0]) // 2] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.FrameReader(lambda s, n: bytes(damaged[s : s + n]), len(file)).documents())
    assert token_files.encode_and_read(docs(spark, []), path).count() == 0


def test_units_are_encoded_once(monkeypatch):
    """Lines' ends don't make units of two words, and units that recur outlive a task; ids stay the library's own."""
    from tokenizers import Tokenizer

    path, asked = tokenizer("byte_bpe_50k.json"), []
    encoder, library = token_files.UnitEncoder(path), Tokenizer.from_file(path)
    plain = encoder._plain
    monkeypatch.setattr(encoder, "_plain", lambda texts: asked.extend(texts) or plain(texts))
    monkeypatch.setattr(token_files, "_encoders", {path: encoder})
    ends, starts = [f"ab{chr(97 + i)}." for i in range(20)], [f"Z{chr(97 + i)}y" for i in range(20)]
    texts = ["so " + " ".join(f"{a}\n{b}" for a in ends for b in starts), "é.\nÉ'll\n1 \u0301\nx!\n|a", "a\n\nb c\n d", "\na b", "a b\n", "a\r\nb\tc"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]

    def got() -> list[list[int]]:
        return [x.tolist() for x in encoder.encode(texts)]

    assert got() == want and sum(map(len, asked)) < 500  # 400 pairs of words have 3,600 characters
    assert got() == want
    asked.clear()
    token_files.forget()
    assert got() == want and not "".join(asked)
    token_files.forget()
    kept = len(encoder.names)
    assert [x.tolist() for x in encoder.encode(["so other"])] == [library.encode("so other", add_special_tokens=False).ids]
    token_files.forget()
    assert kept > 40 and len(encoder.names) == 2  # only what was used again: "so", as a text's first unit and as another
    monkeypatch.setattr(token_files, "MOST_UNITS", 50)
    assert got() == want and got() == want


def test_only_wanted_frames_are_decompressed():
    w = token_files.FrameWriter()
    for i in range(40):
        w.add(i, np.full(1000 * (1 + i % 5), i, np.uint32))
    blob, asked = w.blob(), []
    reader = token_files.FrameReader(lambda s, n: asked.append((s, n)) or blob[s : s + n], len(blob))
    asked.clear()
    assert [(d, len(x), set(x)) for d, x in reader.documents([3, 33])] == [(3, 4000, {3}), (33, 4000, {33})]
    assert len(asked) == 2


# ---- fingerprints


def test_fingerprints_against_brute_force(spark):
    texts = [*AWKWARD, "para one is here\npara two is here\npara three", "same", "same"]
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(docs(spark, texts), 5).collect()}
    plain = [t or "" for t in texts]
    assert len(rows) == len(texts)
    for i, t in enumerate(plain):
        other = plain[i - 1] if i else plain[-1]
        half = len(t) // 2
        changed = t[: len(t) - half] + other[:half]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.printed(fingerprints.fingerprint(t)) and r["edited_fingerprint"] == fingerprints.printed(fingerprints.fingerprint(changed))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (Counter(t.split("\n")) == Counter(changed.split("\n")))
    assert fingerprints.fingerprints(docs(spark, [])).count() == 0
    assert fingerprints.fingerprints(docs(spark, ["alone"])).first()["near_next"] == 1.0


def test_likeness_of_long_repetitive_texts():
    for n in (30_000, 65_551, 131_087):
        x, y = "a" * n, "a" * (n - 100) + "".join(map(chr, range(300, 400)))
        assert fingerprints.likeness(fingerprints.fingerprint(x), fingerprints.fingerprint(y)) > 0.99
        assert fingerprints.likeness(fingerprints.fingerprint(x), fingerprints.fingerprint("b" * n)) < 0.01


def windows_in_common(x, y):
    """The likeness by hand: 2 x common / (all) of the squares of window counts, without a sketch."""
    counts = [Counter(w for line in t.encode().split(b"\n") for w in ([line[i : i + 16] for i in range(len(line) - 15)] or [line])) for t in (x, y)]
    dot = lambda a, b: sum(n * b[w] for w, n in a.items())
    return 2 * dot(*counts) / (dot(counts[0], counts[0]) + dot(counts[1], counts[1]))


def test_likeness_against_whole_window_counts():
    rnd = random.Random(12)
    for share in (0.0, 0.25, 0.5, 0.75, 0.95):
        x = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(600))
        y = x[: int(len(x) * share)] + " ".join(f"v{rnd.randrange(10**6)}" for _ in range(600))[: int(len(x) * (1 - share))]
        assert fingerprints.likeness(fingerprints.fingerprint(x), fingerprints.fingerprint(y)) == pytest.approx(windows_in_common(x, y), abs=0.2)


def test_fingerprints_are_homomorphic():
    a, b = ["first paragraph of all", "x"], ["second one, longer than a window", "x", ""]
    enc = lambda ps: [p.encode() for p in ps]
    both = fingerprints.fingerprint("\n".join(b + a))
    added = fingerprints.insert(fingerprints.fingerprint("\n".join(a)), enc(b))
    assert fingerprints.printed(both) == fingerprints.printed(added)
    assert fingerprints.printed(fingerprints.delete(added, enc(b))) == fingerprints.printed(fingerprints.fingerprint("\n".join(a)))
    words = [f"word{i}" for i in range(2000)]
    one, near = " ".join(words), " ".join(words[:1500] + [f"other{i}" for i in range(500)])
    assert 0.55 < fingerprints.likeness(fingerprints.fingerprint(one), fingerprints.fingerprint(near)) < 0.95


# ---- personal data


def brute_spans(x):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 16 <= len(digits(m.group())) <= 19 and personal_data.luhn(digits(m.group()))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(digits(m.group())) <= 15],
    }


def test_base_spans_against_the_patterns():
    rnd = random.Random(1)
    for _ in range(4000):
        x = "".join(rnd.choice("12 0.@a-+(4") for _ in range(rnd.randint(0, 40)))
        assert personal_data.base_spans(x) == brute_spans(x)
    long = "a" * 200_000
    assert personal_data.base_spans(long + "@b.c")["email"] == [(0, 200_004)]


def test_field_adds_what_patterns_miss(spark):
    texts = ["call (415) 555-2671 now", "mail joe at foo dot com ok", "host 192[.]168[.]1[.]7 up", "Version 2.0.1 of 2020-01-02, page 12", "the idea at home of a dot", "+1 (456) 555-2186 and 4111111111111111", *AWKWARD]
    rows = sorted(personal_data.personal_data(docs(spark, texts)).collect())
    assert [r["spans"] for r in rows[:6]] == ["phone:5:19", "email:5:23", "ip:5:22", "", "", "card:22:38,phone:0:17"]
    for r, t in zip(rows, texts):
        base = brute_spans(t or "")
        own = ",".join(f"{k}:{a}:{b}" for k in personal_data.KINDS for a, b in base[k])
        assert r["base_sha256"] == hashlib.sha256(own.encode()).hexdigest() and set(filter(None, own.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [len(base[k]) for k in personal_data.KINDS]
    assert personal_data.personal_data(docs(spark, [])).count() == 0


def test_every_labelled_line_is_found():
    """Through find(), so that no line is left out before the field sees it."""
    for line in personal_data.LABELLED:
        text, want = "", []
        for part in re.split(r"(\[(?:email|ip|card|phone)\|(?:[^\[\]]|\[[^\]]*\])*\])", line):
            m = re.fullmatch(r"\[(\w+)\|(.*)\]", part)
            if m:
                want.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2] if m else part
        base, every = personal_data.find([text])[0]
        own = {(k, *s) for k in personal_data.KINDS for s in base[k]}
        assert set(every) == set(want) | own, text


def test_written_addresses_without_digits():
    long = "maximiliane dot featherstonehaugh at subdomain dot department dot example dot com"
    for address in ("s.miller (at) uni-example.edu", "jane [at] example.org", "jane (at) example.org", long):
        text = f"write to {address} soon"
        assert personal_data.find([text])[0][1] == [("email", 9, 9 + len(address))], text
    assert not personal_data.fits("email", "the people at home dot com " + "and then some more words " * 3)
    assert not any(personal_data.find([t])[0][1] for t in ("look at this.then go", "arrive at home.Then go", "see it at www.example.com"))


#: lines that the field hasn't seen: [kind|text] marks what it should add to the patterns' spans
UNSEEN = """
please phone [phone|(303) 555-0188] before six
his line is [phone|718-555-0134] at work
Telefon [phone|040 555 01 23] in Hamburg
fax [phone|312.555.0166] or post
dial [phone|(617) 555 0111] again
mail to [email|ann dot lee at sample dot org] please
send to [email|r.jones (at) city (dot) net] soon
ask [email|mia[at]sample[dot]com] first
or [email|t.kim [at] sample.org] then
drop [email|paul at sample dot edu] a line
server [ip|172[.]20[.]1[.]9] is slow
from [ip|10[.]0[.]44[.]2] to the gate
node [ip|192(.)168(.)77(.)3] failed
card [card|4012.8888.8888.1881] was used
visa [card|5555/5555/5555/4444] on file
ssn 321-54-9876 was on the slip
the ratio 10-30-60 20 40 40 held
ratio 12-34-56 78 90 11 again
on 2022-11-05 at 09:15 they met
from 03.04.2019 to 05.06.2019 closed
version 3.11.4 and 2.0.19 run
they looked at a dot and at a line
pages 12-19, 45 and 101 are missing
build 20230517.3 passed 900 of 901 tests
id 7d444840-9dc0-11d1-b245-5ffdce74fad2 done
total 1,250,000 in 12 lots of 14
isbn 978-0-306-40615-7 was out
order 99120345 of 17 items left
""".strip().split("\n")


def test_precision_and_recall_on_unseen_lines():
    hit = wrong = missed = 0
    for line in UNSEEN:
        text, want = "", set()
        for part in re.split(r"(\[(?:email|ip|card|phone)\|(?:[^\[\]]|\[[^\]]*\])*\])", line):
            m = re.fullmatch(r"\[(\w+)\|(.*)\]", part)
            if m:
                want.add((m[1], len(text), len(text) + len(m[2])))
            text += m[2] if m else part
        base, every = personal_data.find([text])[0]
        added = set(every) - {(k, *s) for k in personal_data.KINDS for s in base[k]}
        hit, wrong, missed = hit + len(added & want), wrong + len(added - want), missed + len(want - added)
    assert hit / (hit + missed) >= 0.8 and hit / (hit + wrong) >= 0.9, (hit, wrong, missed)


def test_long_lines_take_linear_time():
    zeros = "0" * 5000 + ".1.2.3"
    assert personal_data.find([zeros])[0][1] == [("ip", 0, len(zeros))] and personal_data.base_spans("9" * 5000 + ".1.2.3")["ip"] == []
    began = time.perf_counter()
    for line in ("look at it ", "at-at-", "1 at a ", "x at y-"):
        personal_data.find([line * (1_000_000 // len(line))])
    assert time.perf_counter() - began < 60


def test_viterbi_is_the_best_path():
    import itertools

    f, rnd = personal_data.field(), np.random.default_rng(3)
    w = rnd.integers(0, f.edge + 1, (5, 3, 4))
    tags = f.viterbi(w, np.array([4, 2, 1]))
    pair, first = f._masked()
    u = f.scores(w)
    for i, n in enumerate((4, 2, 1)):
        value = lambda p: first[p[0]] + u[i, 0, p[0]] + sum(pair[a, b] + u[i, t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:])))  # noqa: B023, E731
        best = max(itertools.product(range(personal_data.N_TAGS), repeat=n), key=value)
        assert value(tuple(tags[i, :n])) == pytest.approx(value(best)) and not tags[i, n:].any()


# ---- near-duplicates


def brute_components(texts, width, percent=80):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or "")) if x]
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_brute_force(spark, width):
    rnd = random.Random(5)
    base = [[f"{rnd.choice('abcdefgh')}{rnd.randint(0, 400)}" for _ in range(rnd.choice([3, 12, 60, 150]))] for _ in range(12)]
    texts = list(AWKWARD)
    for b in base:
        for _ in range(rnd.randint(1, 7)):  # edits around the threshold, so that chains and near misses occur
            texts.append(" ".join(w if rnd.random() > 0.04 else f"z{rnd.randint(0, 99)}" for w in b))
    texts += ["A B c", "a b C"] * 3
    n, comp = brute_components(texts, width)
    rows = sorted(minhash.near_duplicates(docs(spark, texts), width).collect())
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in rows] == [(a, c, c == i) for i, (a, c) in enumerate(zip(n, comp))]
    kept = minhash.keep_one(docs(spark, texts), width)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, c in enumerate(comp) if c == i] and kept.columns[-1] == "size"


@pytest.mark.parametrize("small,rows,items", [(33, 512, 500_000), (2, 7, 500_000), (2, 512, 300)])
def test_near_duplicates_of_a_large_group(spark, monkeypatch, small, rows, items):
    """Buckets of many components, whole or in blocks by count and by size; a third of all rows are one text."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)
    monkeypatch.setattr(minhash, "BLOCK_ITEMS", items)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"y{i}"] + base[k + 1 :]) for i, k in ((i, rnd.randrange(60)) for i in range(60))]
    texts += [" ".join(base[:44] + [f"q{i}{j}" for j in range(16)]) for i in range(40)]
    texts += [" ".join(base[:k] + base[: k // 3]) for k in range(20, 60)] + [texts[5]] * 70
    _, comp = brute_components(texts, 2)
    rows = sorted(minhash.near_duplicates(docs(spark, texts), 2).collect())
    assert [r["component_id"] for r in rows] == comp


def test_near_duplicates_of_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = minhash.near_duplicates(docs(spark, [text, text, "other words here", "more of them", text, None], ids=[7, 7, 7, None, None, None]), 2).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows), key=str)
    assert got == sorted([(7, 39, 7, True), (7, 39, 7, True), (7, 2, 7, True), (None, 2, None, True), (None, 39, 7, False), (None, 0, None, True)], key=str)


def test_common_counts_and_links_of_blocks():
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 9000, rnd.integers(1, 9000)).astype(np.uint64)) for _ in range(12)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    off = ~np.eye(12, dtype=bool)
    assert (minhash.common_counts(sets, None)[off] == want[off]).all()
    assert (minhash.common_counts(sets[:5], sets[5:]) == want[:5, 5:]).all()


def test_near_copies_of_which_one_is_in_a_crowded_bucket(spark, monkeypatch):
    """What a member of a crowded bucket shares with a node outside such buckets counts as well."""
    rnd = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    own = lambda: [f"o{rnd.randrange(10**9)}" for _ in range(20)]
    minima = lambda words: minhash.minima(minhash.shingle_set(" ".join(words), 2)).reshape(minhash.BANDS, -1)
    meet = lambda a, b: np.flatnonzero((a == b).all(axis=1))
    x = passage + own()
    band = next(k for k in meet(minima(x), minima(passage)))
    crowd = []
    while len(crowd) < 12:
        other = passage + own()
        if band in meet(minima(other), minima(x)):
            crowd.append(other)
    y = next(y for k in range(1, 60) if not any(len(meet(minima(y := x[:k] + ["changed"] + x[k + 1 :]), minima(c))) for c in crowd) and len(meet(minima(y), minima(x))))
    texts = [" ".join(t) for t in (*crowd, x, y)]
    _, comp = brute_components(texts, 2)
    assert comp[-1] == comp[-2] == len(crowd)
    monkeypatch.setattr(minhash, "SMALL", 4)
    rows = sorted(minhash.near_duplicates(docs(spark, texts), 2).collect())
    assert [r["component_id"] for r in rows] == comp


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("900", "901")], "a string, b string")
    got = {r["node"]: r["comp"] for r in minhash.components(edges, Scratch(spark)).collect()}
    assert got == {f"{i:03d}": "000" for i in range(41)} | {"900": "900", "901": "900"}
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


# ---- language model


def test_byte_model_is_a_distribution():
    ids, n = np.unique(lm.trigrams([b"abracadabra", b"", b"cabbage"])[0], return_counts=True)
    p = 10 ** lm.code_table(ids, n).astype(float).reshape(-1, lm.A)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert 10 ** lm.code_table(np.array([], int), np.array([], int))[0] == pytest.approx(1 / lm.A, rel=1e-5)


def ppm_by_hand(train, text):
    """log10 probability, symbol by symbol, from dictionaries."""
    counts = {}
    for t in train:
        s = [256, 256, *t, 256]
        for i in range(2, len(s)):
            for k in (0, 1, 2):
                counts.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    total, s = 0.0, [256, 256, *text, 256]
    for i in range(2, len(s)):
        excluded, p = set(), 1.0
        for k in (2, 1, 0):
            c = counts.get(tuple(s[i - k : i]))
            if not c:
                continue
            own = {x: n for x, n in c.items() if x not in excluded}
            q, all_ = len(own), sum(own.values())
            if not own:
                continue
            if k == 0 and len(c) == lm.A:
                q = 0
            if s[i] in own:
                p *= own[s[i]] / (all_ + q)
                break
            p *= q / (all_ + q)
            excluded |= set(c)
        else:
            p *= 1 / (lm.A - len(counts.get((), ())))
        total += math.log10(p)
    return total


def test_scores_against_brute_force(spark):
    texts = ["the cat sat on the mat", "The dog sat", "zebra quux the", *AWKWARD[:8], "the cat ran and ran", "the the", "dog cat", "held out words here", "more of the same cat", "x"]
    rows = {r["doc_id"]: r for r in lm.scores(docs(spark, texts), lm.is_held_out(), top=5).collect()}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    assert any(held) and len(rows) == len(texts)
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    train = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(train.values()), len(train)
    own = [(t or "").encode() for t, h in zip(texts, held) if not h]
    for i, t in enumerate(tokens):
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(train[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t))
        if len(t) < 50:
            assert r["score"] == pytest.approx(ppm_by_hand(own, (texts[i] or "").encode()), rel=1e-4)
    doubled = lm.scores(docs(spark, ["a b", "a b"], ids=[4, 4]), lm.is_held_out()).collect()
    assert len(doubled) == 2 and doubled[0] == doubled[1] and lm.scores(docs(spark, []), lm.is_held_out()).count() == 0


def long_ppm_by_hand(train, text, order):
    """log10 probability with contexts of up to `order` symbols, from dictionaries."""
    counts = {}
    for t in train:
        s = [256] * order + [*t, 256]
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    total, s = 0.0, [256] * order + [*text, 256]
    for i in range(order, len(s)):
        excluded, p = set(), 1.0
        for k in range(order, -1, -1):
            c = counts.get(tuple(s[i - k : i]), {})
            own = {x: n for x, n in c.items() if x not in excluded}
            if s[i] in own:
                p *= own[s[i]] / (sum(own.values()) + len(own))
                break
            if own:
                p *= len(own) / (sum(own.values()) + len(own))
            excluded |= set(c)
        else:
            p *= 1 / (lm.A - len(counts.get((), ())))
        total += math.log10(p)
    return total


@pytest.mark.parametrize("order", [3, 4, 6])
def test_long_contexts_against_brute_force(spark, order):
    texts = ["the cat sat on the mat", "The dog sat", "zebra quux the", *AWKWARD[:8], "the cat ran and ran", "the the", "dog cat", "held out words here", "more of the same cat", "x", "the cat sat on the mat again", "a cat that sat"]
    own = [(t or "").encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = {r["doc_id"]: r for r in lm.scores(docs(spark, texts).repartition(3), lm.is_held_out(), order=order).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i]["score"] == pytest.approx(long_ppm_by_hand(own, (t or "").encode(), order), rel=1e-6)
    short = {r["doc_id"]: r for r in lm.scores(docs(spark, texts), lm.is_held_out()).collect()}
    assert all(rows[i]["base_score"] == pytest.approx(short[i]["base_score"]) and rows[i][:5] == short[i][:5] for i in rows)
    doubled = lm.scores(docs(spark, ["a b", "a b"], ids=[4, 4]), lm.is_held_out(), order=order).collect()
    assert len(doubled) == 2 and doubled[0] == doubled[1] and lm.scores(docs(spark, []), lm.is_held_out(), order=order).count() == 0
    ids = [1, 2**32 + 1, -1, -2, 5, 5 + 2**61 - 1, None, None]  # equal texts stay rows of their own ids
    alike = lm.scores(docs(spark, ["a b c"] * 8, ids=ids), lm.is_held_out(), order=order).collect()
    assert sorted((r["doc_id"] for r in alike), key=str) == sorted(ids, key=str) and {r["n_tokens"] for r in alike} == {4}
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 2) for r in alike)


def test_the_query_uses_long_contexts(tmp_path, spark):
    """Words of more than a trigram count: in two corpora of the same trigrams the longer context tells."""
    from cairn.llm.queries import op8_ppm_scores

    texts = [" - ".join(["xabcy", "zabcw"] * 30 + ["q"])] * 8 + ["xabcy - zabcw - q", "xabcw - zabcy - q"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r["score"] for r in op8_ppm_scores(spark, str(tmp_path)).collect()}
    short = {r["doc_id"]: r["score"] for r in lm.scores(docs(spark, texts), lm.is_held_out(), order=2).collect()}
    assert rows[8] - rows[9] > 1 > abs(short[8] - short[9])


# ---- toxicity


def kernel_by_hand(s, t, p=toxicity.P, lam=toxicity.LAMBDA):
    import itertools

    weights = [Counter(), Counter()]
    for k, x in enumerate((s, t)):
        for places in itertools.combinations(range(len(x)), p):
            weights[k]["".join(x[i] for i in places)] += lam ** (places[-1] - places[0] + 1)
    return sum(a * weights[1][u] for u, a in weights[0].items())


def test_kernel_and_common_subsequence_against_brute_force():
    rnd = random.Random(2)
    for _ in range(40):
        s, t = ("".join(rnd.choice("abc") for _ in range(rnd.randint(4, 9))) for _ in range(2))
        assert toxicity.kernel(toxicity._codes([s]), toxicity._codes([t])[0])[0] == pytest.approx(kernel_by_hand(s, t), rel=1e-4)
        places = np.zeros(5, np.uint64)
        for i, c in enumerate(t):
            places["xabc".index(c)] |= np.uint64(1 << i)
        lcs = [[0] * (len(t) + 1) for _ in range(len(s) + 1)]
        for i, a in enumerate(s):
            for j, b in enumerate(t):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if a == b else max(lcs[i][j + 1], lcs[i + 1][j])
        assert toxicity.common_length(np.array([["xabc".index(c) for c in s]]), places, len(t))[0] == lcs[-1][-1]


def test_held_out_accuracy_and_inserted_characters(spark):
    rnd = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "mo") for b in ("ra", "tu", "ni", "so") for c in ("n", "s", "mer", "")]
    texts, labels = [], []
    for i in range(600):
        t = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        if i % 4 == 0:
            t[rnd.randrange(len(t))] = rnd.choice(["idiot", "worthless", "scumbag"])
        texts.append(" ".join(t) + ".")
        labels.append(int(i % 4 == 0))
    frame = docs(spark, [*texts, *AWKWARD])
    table = spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)], "doc_id long, toxic int, lang int")
    model = toxicity.trained(frame, table)
    rows = {r["doc_id"]: r["score"] for r in toxicity.scores(frame, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(rows) == len(texts) + len(AWKWARD) and sum((rows[i] >= 0.5) == labels[i] for i in held) >= 0.97 * len(held)
    assert (toxicity.score_texts(["you i.d.i.o.t", "an idiiot here", "w o r t h l e s s", "idi ot", "idqiot", "id7iot", "worth less", "wozrthless", "wortqhlesss", "an " + "ba" * 40 + " idiot"], model) >= 0.5).all()
    assert (toxicity.score_texts([None, "", "bara"], model) < 0.5).all()
    kept = toxicity.reject(frame, model)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, s in rows.items() if s < 0.5) and kept.columns == frame.columns
    empty = toxicity.trained(docs(spark, []), table.limit(0))
    assert toxicity.scores(docs(spark, []), empty).count() == 0 and toxicity.score_texts(["x"], empty)[0] == 0


def test_landmarks_stand_anywhere_in_a_word_and_rows_are_bounded(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(30)) + ("moronic" if i % 2 else "") + rnd.choice("abc") * 3 for i in range(160)]
    model = toxicity.fit(texts, [i % 2 for i in range(160)])
    assert any("moronic" in g for g in model.landmarks)
    assert (toxicity.score_texts(["a" * 50 + "moronic" + "c" * 9, "xyz"], model) >= 0.5).tolist() == [True, False]
    ids = [1] * 50 + [2, 3, None]
    got = toxicity.sample(docs(spark, [f"t{i}" for i in range(53)], ids=ids), spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (None, 1)], "doc_id long, toxic int"), 5, lambda c: F.lit(True))
    assert len(got[0]) == 2 and got[1] == [1, 0]
    both = toxicity.sample(docs(spark, ["a"]).selectExpr("'k' as doc_id", "text"), spark.createDataFrame([("k", 1)], "doc_id string, toxic int"), 5, lambda c: F.lit(True))
    assert both == (["a"], [1])


def test_pieces_give_the_kernel_of_the_whole_word():
    rnd = random.Random(9)
    model = toxicity.Model(["^idiot$", "worthless"], own=[float(toxicity.kernel(toxicity._codes([g]), toxicity._codes([g])[0])[0]) for g in ("^idiot$", "worthless")])
    for at in range(0, 60, 7):
        word = "".join(rnd.choice("kmpq") for _ in range(at)) + "worthless" + "".join(rnd.choice("kmpq") for _ in range(30))
        assert model.features([word])[0][1] >= 0.5
        want = toxicity.kernel(toxicity._codes(["^" + word + "$"]), toxicity._codes(["worthless"])[0])[0]
        assert want == pytest.approx(model.own[1], rel=0.3)


# ---- decontamination


def test_leaks_and_recall_against_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice(["the", "of", "and"]) if rnd.random() < 0.4 else f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.randint(0, 3000)}"
    items = [[word() for _ in range(rnd.randint(15, 60))] for _ in range(40)]
    texts, want = list(AWKWARD), set()
    for d in range(150):
        body = [word() for _ in range(rnd.randint(20, 300))]
        if d % 3 == 0:
            i, at = rnd.randrange(40), rnd.randrange(len(body))
            passage = [w if rnd.random() > 0.12 else word() for w in items[i]] if d % 2 else items[i]
            body[at:at] = passage
            want.add((len(texts), i))
        texts.append(" ".join(body))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    # brute force: every window of the item's length against every item, by longest common subsequence
    brute = set()
    for d, t in enumerate(texts):
        words = decontaminate.words_of(t)
        for i, item in enumerate(items):
            n, places = len(item), decontaminate.places_of([w.encode() for w in item])
            if len(words) < 1000 and any(decontaminate.common_subsequence(places, n, words[s : s + n + n // 4]) >= decontaminate.PASSAGE * n for s in range(0, max(1, len(words) - n // 2), max(1, n // 8))):
                brute.add((d, i))
    assert len(brute & got) >= 0.9 * len(brute) and got <= want | brute and len(want & got) >= 0.9 * len(want)
    kept = {r["doc_id"] for r in decontaminate.clean(docs(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}
    assert decontaminate.leaks(docs(spark, []), bench).count() == 0 and decontaminate.leaks(docs(spark, texts), bench.limit(0)).count() == 0


def test_basis_of_all_documents(spark):
    """The basis is that of every document's passages, beyond 4,000 of them too: whichever ids they have, it is what the iteration finds in the whole matrix."""
    rnd = random.Random(8)
    terms = {f"t{i}".encode(): i for i in range(60)}
    items = [np.array(rnd.sample(range(60), 12)) for _ in range(5)]
    texts = [" ".join(rnd.choice(["the", f"t{min(59, int(rnd.expovariate(0.08)))}", f"t{(d // 100) % 60}"]) for _ in range(rnd.randint(0, 90))) for d in range(6000)]
    weights, matrix = np.linspace(0.5, 2, 60), []

    def gram(cuts):
        a = np.zeros((len(cuts), 60))
        for row, cut in zip(a, cuts):
            np.add.at(row, cut, weights[cut])
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        return a.T @ a

    for t in texts:
        own = [terms.get(w, -1) for w in decontaminate.words_of(t)]
        matrix += [np.array([x for x in own[s : s + 40] if x >= 0], np.int64) for s in range(0, len(own), 40)]
    whole = gram(matrix) * 4000 / 6000 + gram(items) * decontaminate.ITEM_WEIGHT**2
    q = np.random.default_rng(5).standard_normal((60, 20))
    for _ in range(3):
        q = np.linalg.qr(q)[0]
        z = q
        q = whole @ q
    vector = np.linalg.eigh(z.T @ whole @ z)[1]
    best = z @ vector[:, ::-1][:, :12]
    for ids in (range(6000), range(50_000, 56_000)):
        got = decontaminate.latent_basis(docs(spark, texts, ids=ids), terms, items, weights, 6000, rank=12)
        assert np.abs(got @ got.T - best @ best.T).max() < 1e-6


# ---- null and repeated ids, hot copies


def test_rows_of_null_repeated_and_hot_ids_stay(spark, tmp_path):
    """A third of all rows are one text, ids repeat or are null: each operator returns a row for each row."""
    texts = ["same words here again"] * 30 + [f"text number {i}" for i in range(30)] + [None, "", "same words here again"]
    ids = [*range(30), *([7] * 10), *([None] * 10), *range(100, 110), None, None, 7]
    frame = docs(spark, texts, ids=ids)
    model = toxicity.Model(prior=0.25)
    made = {
        "counts": token_counts.token_counts(frame, tokenizer("piece_bpe_32k.model")), "marks": fingerprints.fingerprints(frame, 3), "personal": personal_data.personal_data(frame),
        "scores": lm.scores(frame, lm.is_held_out(), order=3), "files": token_files.encode_and_read(frame, tokenizer("byte_bpe_50k.json")), "toxic": toxicity.scores(frame, model),
        "near": minhash.near_duplicates(frame, 2),
    }
    for name, rows in made.items():
        assert Counter(r["doc_id"] for r in rows.collect()) == Counter(ids), name
