import re
from collections import Counter

from lumenframe.llm import quality
from lumenframe.llm.quality import MEASURES, estimate, judge, op5_quality

from .fixtures import documents, odd_texts

SF = "/root/testdata/sf0.001"


def brute(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {k for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        n = len(w)
        out.append((i, n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n))
    return sorted(out, key=str)


def test_op5_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = op5_quality(spark, SF)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == brute(rows)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = got.join(labels.withColumnRenamed("quality", "label"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.label == 1) for r in seen) >= 0.95 * len(seen)


def test_odd_rows(spark):
    rows = odd_texts() + [(30, "a b c a b c a b"), (31, "z z z z"), (32, "z z z"), (33, " ".join("p q r s t u v w x y".split() * 40)), (34, "l\nl\n \nl\r\nm"), (35, "🙂é #|<"), (36, " ".join(f"k{i % 60}" for i in range(130)))]
    got = judge(documents(spark, rows)).select("doc_id", *MEASURES, "base_failed").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert judge(documents(spark, [])).count() == 0


def test_estimate_finds_accuracies():
    import random

    rng, kinds = random.Random(5), ["a", "a", "b"]
    truth = {"good": (0.002, 0.003, 0.004), "a": (0.9, 0.7, 0.01), "b": (0.01, 0.01, 0.85)}
    patterns = Counter()
    for _ in range(20_000):
        rates = truth[rng.choices(["good", "a", "b"], (0.8, 0.12, 0.08))[0]]
        patterns[tuple(-1 if rng.random() < q else 1 for q in rates)] += 1
    classes, shares, rates = estimate(patterns, kinds)
    assert classes == ["good", "a", "b"] and abs(shares[0] - 0.8) < 0.05
    assert abs(rates[1][0] - 0.9) < 0.05 and abs(rates[1][1] - 0.7) < 0.05 and abs(rates[2][2] - 0.85) < 0.1


def test_the_corpus_decides_about_one_objection_of_three():
    """The same votes: good where three rules about a fault object together, bad where each finds cases of its own."""
    kinds, one = ["a", "a", "a"], (-1, 1, 1)
    together = quality.estimate({(1, 1, 1): 8_000, (-1, -1, -1): 1_990, one: 10}, kinds)
    apart = quality.estimate({(1, 1, 1): 8_000, one: 700, (1, -1, 1): 700, (1, 1, -1): 600}, kinds)
    assert quality.posterior(one, *together[1:])[0] > 0.5 > quality.posterior(one, *apart[1:])[0]


def test_observed_rates_show_where_the_bound_decides():
    patterns = {(1, 1, 1): 9_000, (1, 1, -1): 600, (-1, -1, 1): 400}
    _, shares, rates = quality.estimate(patterns, ["a", "a", "b"], false_objections=0.2)
    free = quality.observed_rates(patterns, shares, rates)
    assert all(0 <= x <= 1 for row in free for x in row) and free[1][0] > 0.9
    _, shares, rates = quality.estimate(patterns, ["a", "a", "b"])
    assert rates[0][2] <= 0.005
