import random
from itertools import combinations

import pytest

from tidemark.operators import relations, scoring

MARKET = "ticker string, series string, title string, category string, tags array<string>, last_price double, volume_24h long"


def markets(n, seed, series=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        common = ["the", "of"] if r.random() < 0.8 else []
        title = common + r.sample(words, r.choice((0, 1, 3, 6)))
        if out and r.random() < 0.4:  # a like one
            title = out[-1][2].split() + r.sample(words, 1)
        out.append((f"t{i:05d}", f"s{r.randrange(series)}" if r.random() < 0.95 else None, " ".join(title), r.choice(["a", "b", None]), r.choice([None, [], ["x"], ["x", "y"], r.sample(words, 3)]), r.random(), i))
    return out


def likeness(a, b):
    j = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    if a[4] is None or b[4] is None:
        return None
    return 0.3 * j(set(a[4]), set(b[4])) + 0.4 * j(set(a[2].split()), set(b[2].split())) + (0.2 if a[3] is not None and a[3] == b[3] else 0) + 0.1


@pytest.mark.parametrize("least", [0.95, 0.6, 0.35, 0.3, 0.05])
def test_market_pairs_equal_all_pairs(spark, least):
    rows = markets(150, 5)
    got = {(r["ticker_1"], r["ticker_2"]): r["similarity"] for r in scoring.market_pairs(spark.createDataFrame(rows, MARKET), least - 1e-9).collect()}
    want = {(a[0], b[0]): s for a, b in combinations(rows, 2) if a[1] is not None and a[1] == b[1] and (s := likeness(a, b)) is not None and s >= least - 1e-9}
    assert got == pytest.approx(want) and (least > 0.9 or len(got) > 20)


def test_market_candidates_grow_with_the_rows(spark):
    """One series whose titles have two words in common and else their own, or a like one's."""
    rows = [(f"t{i:06d}", "s", f"will it a{i // 2} b{i // 2} c{i // 2} d{i}", f"c{i % 5}", [f"x{i // 3}", "y"], 0.5, i) for i in range(8000)]
    found = scoring.candidates(spark.createDataFrame(rows, MARKET), 0.6)
    assert 0 < found.count() < 10 * len(rows)


def plain_reach(edges, depth):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for node in near:
        seen = front = {node}
        for _ in range(depth):
            front = {m for f in front for m in near[f]} - seen
            seen = seen | front
        out[node] = len(seen) - 1
    return out


@pytest.mark.parametrize("nodes,links", [(30, 40), (200, 260), (150, 1500)])
def test_reach_equals_breadth_first_search(spark, nodes, links):
    r = random.Random(nodes)
    edges = [(f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for _ in range(links)] + [("hub", f"n{i}") for i in range(0, nodes, 3)] + [("x", "x")]
    steps = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a string, b string")
    got = {r["node"]: (r["reach_1"], r["reach_2"], r["reach_4"]) for r in relations.reached(steps, (1, 2, 4)).collect()}
    assert got == {n: tuple(plain_reach(edges, d)[n] for d in (1, 2, 4)) for n in plain_reach(edges, 1)}


@pytest.mark.parametrize("least", [0.85, 0.6])
def test_twins_equal_all_pairs(spark, least):
    r = random.Random(7)
    near = {}
    for g in range(12):
        members = r.sample(range(60), r.randrange(1, 6))
        for k in range(3):
            near[f"g{g}-{k}"] = {m: r.choice((0.5, 0.52, 0.9)) for m in members if r.random() < 0.9} | {0: 0.5}
    edges = [(n, f"m{m}", e) for n, x in near.items() for m, e in x.items()]
    both = {}
    for a, b, e in edges:
        both.setdefault(a, {})[b] = e
        both.setdefault(b, {})[a] = e
    want = {}
    for u, v in combinations(sorted(both), 2):
        common = both[u].keys() & both[v].keys()
        if common:
            s = (len(common) / min(len(both[u]), len(both[v])) + 1 - sum(abs(both[u][c] - both[v][c]) for c in common) / len(common)) / 2
            if s >= least:
                want[u, v] = s
    got = {(t["u"], t["v"]): t["similarity"] for t in relations.twins(spark.createDataFrame(edges, "a string, b string, effect double"), least).collect()}
    assert got == pytest.approx(want) and len(want) > 10


def test_equal_markets_are_compared_once_and_not_broadcast(spark):
    """Markets of five kinds, 40 of each: all pairs of like kinds are told, though the kinds alone are compared."""
    kinds = [("s", "a b c", "k", ["x", "y"]), ("s", "c b a", "k", ["y", "x"]), ("s", "a b c d", "k", ["x", "y"]), ("s", "e", None, ["z"]), ("t", "a b c", "k", ["x", "y"])]
    rows = [(f"t{i:03d}", s, title, category, tags, i / 200, i) for i in range(200) for s, title, category, tags in [kinds[i % 5]]]
    out = scoring.market_pairs(spark.createDataFrame(rows, MARKET), 0.6 - 1e-9)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["ticker_1"], r["ticker_2"]): (r["similarity"], r["p1"], r["p2"], r["volume"]) for r in out.collect()}
    want = {(a[0], b[0]): (s, a[5], b[5], (a[6] + b[6]) / 2) for a, b in combinations(rows, 2) if a[1] == b[1] and (s := likeness(a, b)) >= 0.6 - 1e-9}
    assert len(got) > 5000 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
