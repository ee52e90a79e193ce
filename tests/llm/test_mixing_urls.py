import re
from collections import defaultdict

import pytest

from cairn.llm import mixing, urls

from .helpers import AWKWARD, LONG, docs


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check_mix(spark, frame):
    rows = mixing.decisions(frame).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, biggest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in frame.collect():
        sizes[r["source"]] += words(r["text"])
        biggest[r["source"]] = max(biggest[r["source"]], words(r["text"]))
    goal = brute_targets(sizes)
    assert len(rows) == frame.count()
    for r in rows:
        assert r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= biggest[s] / 2 + 1e-6
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.decisions(frame).collect()), key=str)
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(r["n_copies"] for r in rows)


def test_mix_meets_targets_at_awkward_rows(spark):
    check_mix(spark, docs(spark, AWKWARD * 8, [["a", None, "b", "", "hot", "hot"][i % 6] for i in range(96)]))


def test_mix_of_a_hot_source(spark):
    check_mix(spark, docs(spark, [f"{'w ' * (i % 37)}" for i in range(400)], ["hot" if i % 3 else f"s{i % 11}" for i in range(400)]))


def test_mix_of_nothing(spark):
    assert mixing.decisions(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0


def test_unequal_propensities_keep_targets(spark):
    from pyspark.sql import functions as F

    frame = docs(spark, ["w " * (5 + i % 7) for i in range(600)], ["ab"[i % 2] for i in range(600)]).withColumn("p", F.when(F.col("doc_id") % 3 == 0, 2.0).otherwise(0.5))
    rows = mixing.decisions(frame, propensity="p", share=0.5).collect()
    for s in "ab":
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        mean = lambda f: sum(r["n_copies"] for r in own if f(r)) / sum(1 for r in own if f(r))
        assert mean(lambda r: r["doc_id"] % 3 == 0) > mean(lambda r: r["doc_id"] % 3 > 0)


def brute_url(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, "allow"))


URLS = [None, "", "no scheme", "http://com/en/", "https://A.Example.COM/en/7?x#y", "https://example.com/en/70", "https://xexample.com/en/7", "http://com/en", "http://a.net/de/8", "http://example.net/de/8/9", "x://y://z.com/en/a", "http://org?/es/", "http://a.b.org/es/ü", "https://example.com:80/en/7", "http:///en/"]


@pytest.mark.parametrize("group_rows", [1, 1024])
def test_rules_against_brute_force(spark, group_rows):
    rules = urls.RULES + [("example.com", "/en/", "block"), ("a.example.com", "", "block"), ("", "/en/", "allow"), ("example.com", "/en/70", "block"), ("example.com", "/en/7/8", "block")]
    many = URLS + [f"http://{h}.example.{t}/{p}/{i}" for i in range(30) for h in ("a", "b.a") for t in ("com", "net") for p in ("en", "de")] + ["https://a.example.com/en/7"] * 50
    frame = spark.createDataFrame([(i, u, "clash", "x", 1) for i, u in enumerate(many)], "page_id long, url string, verdict string, h_ string, level int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(frame, urls.rule_table(spark, rules), group_rows=group_rows).collect()}
    assert got == {i: brute_url(u, rules) for i, u in enumerate(many)}


def test_no_urls_and_no_rules(spark):
    frame = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    assert urls.judge(frame.limit(0), urls.rule_table(spark)).count() == 0
    assert urls.judge(frame, urls.rule_table(spark).limit(0)).first()["verdict"] == "allow"
    assert len(LONG) > 100_000
