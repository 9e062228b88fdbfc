import hashlib
import json
import random
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import pytest

from tidemark.llm import alignment
from tidemark.llm.queries import vocabulary
from tidemark.llm.util import sorted_aggregates

A, B = vocabulary(), vocabulary("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "a", " ", "  ", "\n", " a", "a ", "a  ", "  a  b \n c\t d ", "x  y", "x  y", "　 x　　 y", "a\x1c b", "a \x1c b", "a\x85 b", "tab\t\ttab", "<|endoftext|> <s> </s><unk>",
    "▁", "has ▁ mark", "日本語 のテキスト 日本", "é́ ﬁ Å", "\x00 zero\x00", "it's we'll  don't", "1234567 12 3", "😀 😀😀 a😀", "a" * 3000, " " * 3000 + "b", "}\r\n  }\r\n", "__init__(self): ...",
]


def library():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(rows):
    """By whole texts, with the tokenizers' own calls."""
    a, b = library()
    plain_bytes = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    byte = {chr(c): c for c in plain_bytes} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain_bytes)}
    with open(A, encoding="utf-8") as f:
        word = {i: bytes(byte[c] for c in w) for w, i in json.load(f)["model"]["vocab"].items() if w != "<|endoftext|>"}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    told = []
    for i, t in rows:
        own_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        own_b = b.encode(t) if t else []
        bytes_a, bytes_b = [word[x] for x in own_a], [piece(x) for x in own_b]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            told.append((i, None))
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            at = 0
            ends.append([at := at + len(p) for p in parts])
        cuts = sorted(set(ends[0]) & set(ends[1]))
        parts = [([], []) for _ in cuts]
        for side, ids in enumerate((own_a, own_b)):
            for e, x in zip(ends[side], ids, strict=True):
                parts[bisect_left(cuts, e)][side].append(x)
        at_b = {}
        for e, x in zip(ends[1], own_b, strict=True):
            at_b.setdefault(e, []).append(x)
        links = [(x, y) for e, x in zip(ends[0], own_a, strict=True) for y in at_b.get(e, ())]
        told.append((i, (own_a, own_b, parts, links)))
    count = Counter(p for _, x in told if x for p in x[3])
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for i, x in told:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join("|".join(",".join(map(str, s)) for s in p) for p in x[2])
        out.append((i, len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(count[p] == most[p[1]] for p in x[3]), sum(count[p] for p in x[3]), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("head,pairs", [(alignment.HEAD, alignment.PAIRS), (40, 50), (0, 0)])
def test_alignment_equals_that_of_whole_texts(spark, docs, rows, none, head, pairs):
    got = alignment.aligned(docs, A, B, head, pairs)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain([(r[0], r[1]) for r in rows]), key=repr)
    assert alignment.aligned(none, A, B).count() == 0


def test_odd_texts(spark):
    rows = list(enumerate([*ODD, *(" ".join(ODD[i:] + ODD[:i]) for i in range(0, len(ODD), 5))]))
    rows = [(i, t.replace("▁", "") if i >= len(ODD) and i % 2 else t) for i, t in rows]
    got = alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string"), A, B, 4)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_stretches_have_the_whole_texts_tokens():
    a, b = library()
    mine, pieces = alignment.encoder(A), alignment.pieces(B)
    for t in ODD:
        each = alignment.stretches(t)
        if each:
            assert "".join(" " + s for s in each) == " " + t
            assert [i for s in each for i in mine.ordinary(" " + s)] == a.encode(" " + t, add_special_tokens=False).ids
            assert [i for x in pieces.ids(each) for i in x] == b.encode(t)


def test_counting_in_parts(spark, docs, rows, monkeypatch):
    whole = Counter(s for r in rows for s in alignment.stretches(r[1]))
    monkeypatch.setattr(alignment, "COUNTED", 3)
    assert {r["stretch"]: r["n"] for r in alignment.counted(docs).collect()} == whole


def test_tokens_move_once(spark, docs, capsys):
    texts = spark.createDataFrame([(1, 2, 1, [5, 6])], "key long, n long, n_a int, tokens array<int>")
    alignment.groups(texts.repartition("key")).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("hashpartitioning(key") == plan.count("REPARTITION_BY_COL") > 0 == plan.count("ENSURE_REQUIREMENTS")


def test_sorted_tokens_are_grouped_as_they_come(spark, capsys):
    texts = spark.createDataFrame([(1, 2, 1, [5, 6])], "key long, n long, n_a int, tokens array<int>")
    with sorted_aggregates(spark):
        alignment.groups(texts.repartition("key")).explain("formatted")
    plan = capsys.readouterr().out
    assert "SortAggregate" in plan and "ObjectHashAggregate" not in plan and plan.count(") Sort\n") == 2  # those of the windows


def test_cut_equals_a_pattern():
    r = random.Random(5)
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    near = "\x1b\x08\x84\x86\xa1\u0185\u01a0\u167f\u1681\u1fff\u200b\u2027\u202a\u202e\u205e\u2060\u2fff\u3001\u3040\u4080😀é"
    texts = [None, "", *ODD, *("".join(r.choices([" "] * 30 + blanks + list(near) + ["a"] * 20 + ["▁"], k=r.randint(1, 30))) for _ in range(3000))]
    pattern = re.compile("(?<=[^" + re.escape("".join(blanks)) + "])(?= )")
    want = [[s.encode() for s in pattern.split(" " + t)] if t and "▁" not in t else [] for t in texts]
    for given in (pa.array(texts, pa.string()), pa.array(["x y", *texts, "z"], pa.string())[1:-1]):
        each, at = alignment.cut(given)
        each = each.to_pylist()
        assert [each[i:j] for i, j in zip(at[:-1], at[1:], strict=True)] == want
    assert alignment.stretches(None) == [] and len(alignment.cut(pa.array([], pa.string()))[0]) == 0


def test_texts_told_in_parts(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(alignment, "TOLD", 100)
    got = alignment.aligned(docs, A, B, 40, 50)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain([(r[0], r[1]) for r in rows]), key=repr)
