"""Fuzzy matches against a comparison of all titles with all names."""

import random

import pytest

from vacantia.operators import matching


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(titles, names, least):
    out = {}
    for t in titles:
        found = []
        for n in names:
            a, b = set(t.split()), set(n.split())
            score = int((0.6 * (1 - edits(t, n) / max(len(t), len(n))) + 0.4 * len(a & b) / len(a | b)) * 10_000 + 0.5 + 1e-9) / 10_000
            if score >= least:
                found.append((-score, n))
        out[t] = (min(found)[1], -min(found)[0]) if found else (None, None)
    return out


@pytest.mark.parametrize("least", [0.5, 0.45, 0.2])
def test_against_all_names(spark, least):
    rnd = random.Random(1)
    names = ["developer", "nurse", "data analyst", "software engineer", "cook", "truck driver", *("".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 30))) for _ in range(60))]
    titles = {"developr", "nurse aide", "dta analist", "softwar enginer", "kook", "trucker drivers"}
    for n in names[6:]:
        for _ in range(3):
            t = list(n)
            for _ in range(rnd.randrange(0, max(1, len(t) // 4) + 1)):
                at = rnd.randrange(len(t) + 1)
                t[at : at + rnd.randrange(2)] = [rnd.choice("abc")][: rnd.randrange(2)]
            titles.add("".join(t) or "a")
    titles = sorted(titles)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)] + [(-1, None), (-2, "")], "id int, title string")
    got = matching.fuzzy_match(df, "id", "title", spark.createDataFrame([(n,) for n in names], "n string"), "n", least).collect()
    want = brute(titles, names, least)
    assert {r["title"]: (r["name"], r["score"]) for r in got if r["title"]} == want
    assert len(got) == len(titles) + 2 and all(r["name"] is None for r in got if not r["title"])
    assert want["developr"][0] == "developer"
