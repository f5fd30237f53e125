"""Alignment of two tokenizers against whole texts encoded one by one."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lumenspan.llm import queries, token_alignment


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = {chr(x): x for x in plain}, 256
    for x in range(256):
        if x not in plain:
            out[chr(more)], more = x, more + 1
    return out


def brute(data):
    a, b, byte = Tokenizer.from_file(P.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), byte_of()
    a.encode_special_tokens = True
    found, counts = [], Counter()
    for doc, text in data:
        groups, links = [], []
        if text:
            x = a.encode(" " + text, add_special_tokens=False)
            left = [(i, bytes(byte[c] for c in t)) for i, t in zip(x.ids, x.tokens, strict=True)]
            right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
            want = b" " + text.encode()
            if b"".join(t for _, t in left) == want == b"".join(t for _, t in right):
                ends = []
                for side in (left, right):
                    at, out = 0, {}
                    for i, t in side:
                        at += len(t)
                        out[at] = i
                    ends.append(out)
                own = [[], []]
                for end in sorted(ends[0].keys() | ends[1].keys()):
                    for ids, side in zip(own, ends, strict=True):
                        ids += [str(side[end])] if end in side else []
                    if end in ends[0] and end in ends[1]:
                        groups.append("|".join(map(",".join, own)))
                        links.append((ends[0][end], ends[1][end]))
                        own = [[], []]
                counts.update(links)
                found.append((doc, len(left), len(right), links, groups))
                continue
        found.append((doc, 0, 0, [], []))
    top = Counter()
    for (x, y), n in counts.items():
        top[y] = max(top[y], n)
    return [
        (d, n, m, len(g), len(ls), sum(counts[z] == top[z[1]] for z in ls), sum(counts[z] for z in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, n, m, ls, g in found
    ]


AWKWARD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\tb c", "x▁y z", "▁", "<|endoftext|> </s> <s> <unk>", "<0x41> b", "é́ ﬁ ½ Ａ 日本 語", "a　b c",
    "it's 'tis 12,345.67 -- ... don't", "\x00 \x01", "🙂 👩‍👩‍👧 x", "ünï cödé", "wörld\r\n\r\n next", "a  b", "​ z", "word " * 40 + "end",
]


def table(spark, rows):
    data = [(i, t, "en", "clash", 1, 2.0, "g") for i, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, part string, k1 int, h1 double, groups string")


def rows():
    rng = random.Random(7)
    words = ["the", "The", "tokenization", "of", "Wörter", "naïve,", "x1", "foo_bar", "(baz)", "end.\nNext", "日本"]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 80]))) for _ in range(40)]
    data = list(enumerate(AWKWARD + out)) + [(None, out[0]), (None, None), (3, out[1]), (3, out[1]), (3, out[2])]
    return data + [(500, " ".join(rng.choice(words) + str(rng.randrange(3000)) for _ in range(8000)))]


@pytest.mark.parametrize("frequent", [0, 20, 1 << 17])
def test_equals_brute_force(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(token_alignment.align, "__kwdefaults__", token_alignment.align.__kwdefaults__ | {"frequent": frequent})
    table(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows()), key=repr)


def test_whole_texts_and_nothing(spark):
    docs = table(spark, rows()[:40])
    one, two = (token_alignment.align(docs, split=s).collect() for s in (True, False))
    assert sorted(one, key=repr) == sorted(two, key=repr)
    assert token_alignment.align(table(spark, [])).count() == 0
    assert [tuple(r) for r in token_alignment.align(table(spark, [(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_given_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op12_token_alignment(spark, sf).collect())) == sorted(brute(data))


def test_frequent_parts_are_bounded(spark):
    parts = spark.range(1000).selectExpr("1 + id div 10 as n")
    for most in (0, 5, 10, 100, 999, 1000):
        least = token_alignment.frequent_from(parts, most)
        assert parts.where(parts.n >= least).count() <= most
    assert token_alignment.frequent_from(parts, 1000) == 1


def test_documents_and_groups_are_not_shuffled(spark):
    plan = token_alignment.align(table(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_parts_are_forgotten_and_encoded_together(spark, monkeypatch):
    for name, value in (("MAX_CACHE", 5), ("CHUNK", 60), ("AT_ONCE", 7)):
        monkeypatch.setattr(token_alignment, name, value)
    docs = table(spark, rows()).coalesce(1)
    got = token_alignment.align(docs, frequent=20).drop("groups").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((r[:-1] for r in brute(rows())), key=repr)
    both = token_alignment.pair(*map(token_alignment.vocabulary, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    parts = ["a", "Wörter", "end.\nNext", "日本", "x1\t", "(baz)", "don't"] * 80
    for one, many in zip(both.encode(parts, [True] * len(parts)), both.encode(parts, [False] * len(parts)), strict=True):
        assert one.tolist() == many.tolist()
