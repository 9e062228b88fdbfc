import random
from itertools import combinations

import pytest

from tidemark.llm import ngram_join

from .conftest import prose


def shingles(text, words=3):
    w = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def like(a, b, percent):
    return bool(a) and 100 * len(a & b) >= percent * len(a | b)


def plain(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for x, y in combinations(range(len(rows)), 2):
        if label[x] != label[y] and like(sets[x], sets[y], percent):
            label = [label[x] if k == label[y] else k for k in label]
    out = []
    for (i, _), k, s in zip(rows, label, sets, strict=True):
        ids = [j for (j, _), m in zip(rows, label, strict=True) if m == k and j is not None]
        out.append((i, len(s), min(ids, default=None)))
    return sorted(out, key=repr)


def edited(text, r, n):
    words = text.split()
    for _ in range(n):
        at = r.randrange(len(words))
        kind = r.randrange(3)
        if kind == 0:
            words[at] = f"new{r.randrange(99)}"
        elif kind == 1 and len(words) > 4:
            del words[at]
        else:
            words.insert(at, f"put{r.randrange(99)}")
    return " ".join(words)


def copies(seed, groups=8):
    """Texts of all sizes with chains of versions, copies of the hub, and a passage that a third of them share."""
    r, out = random.Random(seed), []
    passage = prose(seed + 500, 30)
    for g in range(groups):
        base = prose(seed * 100 + g, r.choice((4, 9, 12, 20, 21, 40, 90, 300))) + (" " + passage if g % 3 == 0 else "")
        out.append(base)
        last = base
        for _ in range(5):
            last = edited(last, r, r.choice((0, 1, 1, 2)))
            out += [last, edited(base, r, r.choice((1, 1, 2, 3)))]
    out += ["", " \n", "one", "one two", "One  two", "one two three", *(passage + f" {w}" for w in "abcdef")]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("upgrade", [ngram_join.UPGRADE, 1, 0])
def test_components_equal_those_of_all_pairs(spark, upgrade):
    for seed in (1, 2):
        rows = copies(seed)
        got = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), upgrade=upgrade)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("percent,upgrade", [(90, 0), (90, 1 << 14), (70, 0), (70, 2)])
def test_all_partners_meet_in_a_bucket(spark, percent, upgrade):
    rows = copies(7, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = ngram_join.sets(docs, 3, percent).cache()
    node = {r["doc_id"]: r["node"] for r in own.select("doc_id", "node").collect()}
    of = {}
    for r in ngram_join.buckets(docs, own, 3, percent, upgrade).collect():
        of.setdefault(r["node"], set()).add(r["key"])
    sets = {i: shingles(t) for i, t in rows}
    met = 0
    for x, y in combinations(sets, 2):
        if node[x] != node[y] and like(sets[x], sets[y], percent):
            met += 1
            assert of.get(node[x], set()) & of.get(node[y], set()), (x, y)
    assert met > 20


def test_partners_lie_in_the_bands_that_are_asked():
    for percent in (50, 80, 90):
        starts = ngram_join.bands(percent, 400)
        for size in range(1, 300):
            asked = {band: (segments, needed) for band, segments, needed in ngram_join.asked_bands(size, percent)}
            for partner in range(-(-size * percent // 100), size + 1):
                band = max(k for k, s in enumerate(starts) if s <= partner)
                segments, needed = asked[band]
                differ = max(size + partner - 2 * c for c in range(partner + 1) if 100 * c >= percent * (size + partner - c))
                assert differ < needed <= segments


def test_a_passage_that_all_share_makes_no_candidates(spark):
    passage = prose(3, 40)
    docs = spark.createDataFrame([(i, prose(50 + i, 200) + " " + passage) for i in range(30)], "doc_id long, text string")
    own = ngram_join.sets(docs, 3, 90).cache()
    assert ngram_join.buckets(docs, own).count() == 0


def test_odd_rows_and_empty_tables(spark, docs, rows, none):
    got = sorted(map(tuple, ngram_join.joined(docs).collect()), key=repr)
    assert got == plain([(r[0], r[1]) for r in rows])
    assert ngram_join.joined(none).count() == 0
