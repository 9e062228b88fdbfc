import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import resample


def features(text, longest=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, percent, least, longest, n):
    bucket = lambda f: zlib.crc32(f.encode()) % n
    own = [(i, *features(t, longest)) for i, t in rows]
    s = Counter(bucket(f) for _, _, fs in own for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + n) / ((s[b] + 1) * (t.total() + n))))
    out = []
    for i, words, fs in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("longest,percent", [(1, 10), (1, 60), (3, 100)])
def test_weights_scores_and_ranks_equal_plain_ones(spark, docs, rows, longest, percent):
    wanted = ["ka to mi Ünd 12 x-y", None, "", rows[0][1][:900]]
    target = spark.createDataFrame([(t, 1) for t in wanted], "text string, buckets int")
    got = resample.resampled(docs, target, percent, 3, longest, 997)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    expected = plain([(r[0], r[1]) for r in rows], wanted, percent, 3, longest, 997)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_production_buckets_and_words_beyond_ascii(spark):
    texts = ["ÀB éÉ ß" * 9, "A\x00b\x7fc d0", "日本 𝒳y " * 30, "same words here " * 10, "same words here " * 10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = resample.resampled(docs, spark.createDataFrame([("日本 same",)], "text string"), 50, 2)
    assert sorted(map(tuple, got.collect())) == plain(list(enumerate(texts)), ["日本 same"], 50, 2, 1, 10_000)


def test_gains_are_a_literal_and_scoring_shuffles_no_features(spark, docs, capsys):
    resample.resampled(docs, docs.limit(3)).explain("formatted")
    plan = capsys.readouterr().out
    assert "Generate" not in plan and "BatchEvalPython" not in plan


def test_empty_tables(spark, none, docs):
    assert resample.resampled(none, docs).count() == 0
    assert resample.resampled(docs, none.select("text")).count() == docs.count()
