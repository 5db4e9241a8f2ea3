import random
import re
from itertools import combinations

import pytest

import __spark_entry__ as entry
from textloom.operators import lineage as N


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def brute_families(names, least):
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    parts = {n: {p.lower() for p in re.split(r"_|(?<=[a-z0-9])(?=[A-Z])", n) if len(p) > 2} for n in names}
    for a, b in combinations(names, 2):
        if parts[a] & parts[b] or 1 - distance(a.lower(), b.lower()) / max(len(a), len(b)) >= least:
            parent[find(a)] = find(b)
    groups = {}
    for n in names:
        groups.setdefault(find(n), []).append(n)
    return {tuple(sorted(g)) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("least", [0.55, 0.7])
def test_families_are_all_found(spark, least):
    rng = random.Random(5)
    names = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 14))) for _ in range(180)} | {"treeWalk", "walk_deep", "Deep", "qq", "qr"})
    for name in names[:80]:  # near by a change at each end, so that no end or single cut is shared
        names.append("z" + name[1 : len(name) // 2] + "j" + name[len(name) // 2 + 1 : -1] + "k")
    names = sorted(set(names))
    want = brute_families(names, least)
    got = N.identifier_families(spark.createDataFrame([(n,) for n in names], "name string"), least).collect()
    assert len(want) > 1 and {tuple(r.members.split()) for r in got} == want


def test_query_takes_every_name(spark, tmp_path):
    letters = "abcdefghijklmnopqrst"
    common = [x + y + "xx" for x in letters for y in letters]
    text = " ".join(common * 2 + ["quizzebuwovuh", "quizzebuwovuk"])
    spark.createDataFrame([(1, text, "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = entry.queries()["identifier_families"](spark, str(tmp_path)).collect()
    assert ("quizzebuwovuh", "quizzebuwovuk") in {tuple(r.members.split()) for r in rows}
    assert sum(r["size"] for r in rows) == len(common) + 2


@pytest.mark.parametrize("first,second,sent,together", [(3, 5, 7, 11), (1, 1, 1000, 1000)])
def test_families_do_not_depend_on_what_is_compared_first(spark, monkeypatch, first, second, sent, together):
    """Names beside the largest family were spread over lengths and salts, and the planner sent that to all tasks by way of the driver."""
    from textloom.operators import nearnames as NN

    for name, value in (("FIRST", first), ("SECOND", second), ("THIRD", second), ("SENT", sent), ("TOGETHER", together)):
        monkeypatch.setattr(NN, name, value)
    rng = random.Random(8)
    names = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.choice([3, 4, 6, 9, 13, 70, 300]))) for _ in range(120)} | {"treeWalk", "walk_deep", "Deep", "qq", "qr", "QQ"})
    names += ["j" + n[1:-1] + "k" for n in names[:40]]
    names = sorted(set(names))
    found = N.family_groups(spark.createDataFrame([(n,) for n in names], "name string"))
    groups = {}
    for r in found.collect():
        groups.setdefault(r.component, []).append(r.node)
    assert {tuple(sorted(g)) for g in groups.values() if len(g) > 1} == brute_families(names, 0.55)
    assert all(c == min(g) for c, g in groups.items()) and sum(map(len, groups.values())) == len(names)
