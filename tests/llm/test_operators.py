"""The training-data operators against brute force, with awkward rows."""

import base64
import hashlib
import random
import warnings
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenspan.llm import ann, components, decontamination, language_id, license_scan, line_dedup, mixing, ngram_join, queries, token_ids, toxicity, warc
from lumenspan.llm.common import scratch_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, sid int, token double, label string, part int, key string, keep boolean, w string"
NAMES = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(NAMES) + rng.choice(["", "", ",", "."]) for _ in range(n))


def rows(seed=0, n=60):
    rng = random.Random(seed)
    out, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.25:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(NAMES)
            text = " ".join(words)
        else:
            text = prose(rng, rng.choice([1, 3, 5, 40, 90, 150]))
        texts.append(text)
        if rng.random() < 0.3:
            text = text.replace(". ", ".\n").upper()
        out.append((i, text))
    awkward = [(n, None), (n + 1, ""), (n + 2, " \t\n "), (None, texts[5]), (None, None), (3, texts[3]), (3, texts[3]), (3, texts[9]), (n + 3, prose(rng, 9000)), (n + 4, "é ñ 日本 ퟿"), (n + 5, "WARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")]
    return [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}" if i else None, len(t or "")) + ("x", 1, 2.0, "l", 3, "k", True, "w") for i, t in out + awkward]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- n-gram join -----------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute_components(data):
    sets = [shingles(r[1]) for r in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(data):
        ids.setdefault(find(i), []).append(r[0])
    least = {k: min([x for x in v if x is not None], default=None) for k, v in ids.items()}
    return sorted(((r[0], len(s), least[find(i)] if s else r[0]) for i, (r, s) in enumerate(zip(data, sets, strict=True))), key=repr)


def test_ngram_join_equals_brute_force(docs, none):
    got = ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
    assert plain(got) == brute_components(rows())
    assert ngram_join.near_duplicates(none).count() == 0


def test_ngram_join_large_groups_and_splits(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_MOST", 16)
    monkeypatch.setattr(ngram_join, "ALL_PAIRS", 8)
    rng = random.Random(4)
    base = prose(rng, 80).split(" ")
    data = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(80)] = rng.choice(NAMES)
        data.append((i, " ".join(words)))
    got = ngram_join.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string")).select("doc_id", "n_shingles", "component_id")
    assert plain(got) == brute_components(data)


def test_block_search_loses_no_link():
    rng = random.Random(1)
    texts = [r[1].encode() for r in rows(3, 80) if r[1]]
    sets = [s for s in ngram_join.shingle_sets(texts) if len(s)]
    n = np.array([len(s) for s in sets])
    pairs = {(min(a, b), max(a, b)) for i, j in ngram_join.block_pairs(n, [ngram_join.bitmap(s) for s in sets], np.arange(len(sets)), False) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            if ngram_join.links_at_least(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                assert (j, i) in pairs
    assert rng


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_components(spark, one_task):
    rng = random.Random(2)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(200 + i, 201 + i) for i in range(40)]
    label = {x: x for ab in links for x in ab}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint"), one_task=one_task)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert plain(got) == sorted(((k, label[k]) for k in linked), key=repr)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), one_task=one_task).count() == 0


# ---- line dedup ---------------------------------------------------------------------


def test_line_dedup_equals_brute_force(spark, none):
    rng = random.Random(5)
    lines = [prose(rng, rng.choice([2, 4, 60])) for _ in range(12)]
    data = [(i, "\n".join(rng.choice([*lines, "", " "]) for _ in range(rng.randrange(12)))) for i in range(40)] + [(50, None), (51, ""), (None, "\n".join(lines[:4]))]
    seen, want = set(), []
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))
    windows, longs = {}, {}
    for place, (_, text) in enumerate(order):
        units = [x.strip() for x in (text or "").encode().split(b"\n") if x.strip()]
        for p in range(len(units)):
            if p + 1 < len(units):
                windows.setdefault((units[p], units[p + 1]), (place, p))
            if len(units[p].split()) >= 50:
                longs.setdefault(units[p], (place, p))
    for place, (i, text) in enumerate(order):
        raw = (text or "").encode().split(b"\n")
        at = [k for k, x in enumerate(raw) if x.strip()]
        units = [raw[k].strip() for k in at]
        gone = set()
        for p in range(len(units)):
            if p + 1 < len(units) and windows[(units[p], units[p + 1])] != (place, p):
                gone |= {p, p + 1}
            if len(units[p].split()) >= 50 and longs[units[p]] != (place, p):
                gone.add(p)
        lost = {at[p] for p in gone}
        want.append((i, len(units), len(gone), b"\n".join(x for k, x in enumerate(raw) if k not in lost).decode()))
    got = line_dedup.deduplicate(spark.createDataFrame(data, "doc_id bigint, text string")).select("doc_id", "n_lines", "n_removed", "text")
    assert plain(got) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 20 and not seen
    assert line_dedup.deduplicate(none).count() == 0


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_line_dedup_equals_maximal_extension(spark, run):
    """Every pair of places, extended line by line as far as they agree: where
    that makes a run of ``run`` lines, the later place's lines go."""
    rng = random.Random(run)
    lines = [prose(rng, rng.choice([1, 3])) for _ in range(7)]
    docs_ = [[rng.choice(lines) if rng.random() < 0.8 else prose(rng, 4) for _ in range(rng.randrange(25))] for _ in range(30)]
    docs_ += [docs_[3][2:] + docs_[4], [lines[0]] * 9, [lines[0]] * 4 + lines]
    want = []
    for i, mine in enumerate(docs_):
        gone = set()
        for j, other in enumerate(docs_[: i + 1]):
            for p in range(len(mine)):
                for q in range(len(other) if j < i else p):
                    n = 0
                    while p + n < len(mine) and q + n < len(other) and mine[p + n] == other[q + n]:
                        n += 1
                    if n >= run:
                        gone |= set(range(p, p + n))
        want.append((i, len(gone), "\n".join(x for k, x in enumerate(mine) if k not in gone)))
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(docs_)], "doc_id bigint, text string")
    assert plain(line_dedup.deduplicate(df, run=run).select("doc_id", "n_removed", "text")) == sorted(want, key=repr)


# ---- decontamination ------------------------------------------------------------------


def alnum(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination_equals_brute_force(spark, none):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice([1, 2, 7, 13, 14, 30]))) for i in range(14)] + [(20, None), (21, "..."), (None, prose(rng, 20)), (3, prose(rng, 15))]
    data = [r[:2] for r in rows(7, 30)]
    for i in range(30):
        w = prose(rng, 60).split(" ")
        item = rng.choice([x for x in items if x[1]])[1].split(" ")
        a = rng.randrange(len(item))
        w[10:10] = item[a : a + rng.choice([5, 13, 20])]
        data.append((100 + i, " ".join(w)))
    windows = {}
    for k, (item, text) in enumerate(items):
        w = alnum(text)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault((n, tuple(w[p : p + n])), set()).add(item)
        assert k >= 0
    want = []
    for i, text in data:
        w, hit, found = alnum(text), set(), set()
        for n in {k[0] for k in windows}:
            for p in range(len(w) - n + 1):
                for item in windows.get((n, tuple(w[p : p + n])), ()):
                    hit |= set(range(p, p + n))
                    found.add(item)
        want.append((i, len(w), len(hit), sorted(found - {None}), bool(hit) and 20 * len(hit) >= len(w)))
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 20, 100):
        got = decontamination.contamination(spark.createDataFrame(data, "doc_id bigint, text string"), b, block_bytes=block)
        assert plain(got.select("row.doc_id", "n_words", "n_hit", "item_ids", "contaminated")) == sorted(want, key=repr)
    assert any(x[4] for x in want)
    assert decontamination.contamination(none, b).count() == 0
    assert decontamination.contamination(spark.createDataFrame(data, "doc_id bigint, text string"), b.limit(0)).where("n_hit > 0 or contaminated").count() == 0


# ---- token ids --------------------------------------------------------------------------


def test_token_ids_round_trip(docs, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_ids.vocabulary())
    start, want = 0, []
    signed = lambda x: np.uint64(xxhash.xxh64(x.encode(), seed=42).intdigest()).astype(np.int64)
    for i, text in sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]), r[1].encode())):
        ids = np.array([*tk.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert plain(token_ids.roundtrip(docs)) == sorted(want, key=repr)
    assert token_ids.roundtrip(none).count() == 0


def test_token_ids_remember_parts_put_together():
    import pyarrow as pa

    enc = token_ids.Encoder(token_ids.vocabulary())
    texts = pa.array(["a word, end.\nNext, word, word"])
    first, again = (enc.encode(texts)[0].tolist() for _ in range(2))
    assert first == again == enc.tokenizer.encode(texts[0].as_py(), add_special_tokens=False).ids
    assert {"word,", "end.\nNext,"} <= enc.known[" "].keys()


def test_encoder_on_odd_white_space():
    import pyarrow as pa

    texts = ["", " ", "  ", " a", "a ", " a  b \n c ", "\n \n", "x\n y\n\n z", "\t a <|endoftext|> b", "<|endoftext|>", "don't 's 'S ' s", "é   x　 y  z", "a \x1cb", " \r\n q", "12 345 \n\n\n  6", "word, word. word? W.", "x" * 5000]
    enc = token_ids.Encoder(token_ids.vocabulary())
    flat, size = enc.encode(pa.array(texts, pa.string()), 2)
    got = np.split(flat, np.cumsum(size)[:-1])
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == [*enc.tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_encoder_puts_parts_together_from_known_words():
    """Marks and a line's end are parted from words, as the vocabulary does."""
    import pyarrow as pa

    enc = token_ids.Encoder(token_ids.vocabulary())
    enc.encode(pa.array(["a Alpha b\nBeta c*** d."], pa.string()))
    asked, encode = [], enc._encode
    enc._encode = lambda texts: asked.extend(texts) or encode(texts)
    text = "a Alpha***\nBeta. Alpha.\nBeta Alpha***"
    assert enc.encode(pa.array([text], pa.string()))[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert asked == ["a"]  # the word that no space leads

    draw = np.random.default_rng(5)
    some = [*"aéZ中2².,!\n\n   \t\r\u00a0'-_#\"…\u0301ʰİ", "'s", "'ll", "<|", "|>", "The", "<|endoftext|>"]
    texts = ["".join(draw.choice(some, draw.integers(0, 14))) for _ in range(3000)]
    flat, size = enc.encode(pa.array(texts, pa.string()))
    for text, ids in zip(texts, np.split(flat, np.cumsum(size)[:-1]), strict=True):
        assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_orc_reader_skips_by_id(spark, docs):
    from lumenspan.llm.common import scratch_path

    out = scratch_path(spark, "orc-test")
    token_ids.write(docs, out)
    plan = token_ids.read(spark, out).where("doc_id = 7")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(doc_id,7)" in plan
    assert token_ids.read(spark, out).where("doc_id = 7").count() == 1


# ---- mixing --------------------------------------------------------------------------------


def test_a_pass_holds_one_block_of_the_benchmark(spark):
    rng = random.Random(15)
    items = [prose(rng, 20) for _ in range(5)]
    docs = spark.createDataFrame([(i, f"{prose(rng, 30)} {x}") for i, x in enumerate(items)], "doc_id bigint, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontamination.contamination(docs, b, block_bytes=1)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow ") == 1
    assert sorted((r.row.doc_id, r.n_hit, r.item_ids) for r in got.collect()) == [(i, 20, [i]) for i in range(5)]


def raked_table(spark, seed, hot):
    rng = random.Random(seed)
    data = [(f"s{a}", f"l{b}", f"t{c}", rng.randrange(1, 1000) * (hot if a == 0 else 1)) for a in range(7) for b in range(4) for c in range(3) if rng.random() < 0.9]
    return spark.createDataFrame(data, "source string, lang string, topic string, n bigint")


@pytest.mark.parametrize("one_task", [True, False])
def test_raking_meets_the_marginals(spark, one_task, monkeypatch):
    """A hot source holds most tokens: cells of the others fill up, the rate is
    as large as they allow, and the marginals are met all the same."""
    cells = raked_table(spark, 8, 60)
    monkeypatch.setattr(mixing, "CUT_ROUNDS", 10 if one_task else 3)
    monkeypatch.setattr(mixing, "CLOSED", 1e-10 if one_task else 0.02)
    out, rate, gap = mixing.rake(cells, one_task=one_task)
    got = out.toPandas()
    assert (got["m"] <= got["n"] + 1e-6).all() and 0.05 < rate < mixing.RATE
    assert abs(got["m"].sum() / got["n"].sum() / rate - 1) < 0.02
    for d in mixing.POWERS:
        by = got.groupby(d).agg({"m": "sum", f"t_{d}": "first", "n": "sum"})
        share = (by["n"] / by["n"].sum()) ** mixing.POWERS[d]
        assert np.allclose(by[f"t_{d}"], share / share.sum())
    worst = mixing.gaps(out, list(mixing.POWERS)).toPandas()["gap"].abs().max()
    assert worst == pytest.approx(gap, abs=1e-12) and gap < (1e-8 if one_task else 0.05)


def test_raking_to_given_targets(spark):
    cells = raked_table(spark, 9, 1)
    out, rate, gap = mixing.rake(cells, rate=0.3, targets={"source": {"s1": 0.3, "s2": 0.1, "absent": 0.1}, "lang": {f"l{i}": 0.25 for i in range(4)}})
    by = {(r.dimension, r.level): (r.target, r.gap) for r in mixing.gaps(out, list(mixing.POWERS)).collect()}
    assert by["source", "s1"][0] == pytest.approx(0.3) and by["source", "s2"][0] == pytest.approx(0.1)
    assert sum(t for (d, _), (t, _) in by.items() if d == "source") == pytest.approx(1)
    assert all(by["lang", f"l{i}"][0] == pytest.approx(0.25) for i in range(4))
    assert max(abs(g) for _, g in by.values()) == pytest.approx(gap, abs=1e-9) and gap < 1e-8 and rate <= 0.3


def test_contradictory_targets_are_reported(spark):
    """Each target is possible alone; together they are not, for a language of
    its own belongs to one source."""
    rng = random.Random(10)
    data = [(i, prose(rng, 20), *rng.choice([("a", "x"), ("a", "x"), ("b", "y"), ("b", "y"), ("c", "y")]), 1) for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    targets = {"source": {"a": 0.5}, "lang": {"x": 0.2}}
    with pytest.warns(RuntimeWarning, match="cannot be met together.*lang x|cannot be met together.*source a"):
        assert mixing.mix(docs, targets=targets).count() == 200
    with pytest.raises(ValueError, match="cannot be met together"):
        mixing.mix(docs, targets=targets, strict=True)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        got = mixing.mix(docs, targets={"source": {"a": 0.25}, "lang": {"x": 0.25}}).select("source", "n_tokens", "prob").toPandas()
    kept = (got["n_tokens"] * got["prob"]).groupby(got["source"]).sum()
    assert kept["a"] / kept.sum() == pytest.approx(0.25, abs=1e-3)


def test_mixing_of_awkward_rows(docs, none, monkeypatch):
    got = mixing.mix(docs)
    assert got.count() == len(rows()) and got.where("prob < 0 or prob > 1 or keep is null").count() == 0
    assert got.where("n_tokens = 0 and weight <> 1").count() == 0
    assert got.where("source = '(none)'").count() > 0
    assert mixing.mix(none).count() == 0
    one = plain(got.select("row.doc_id", "source", "lang", "topic", "weight", "keep"))
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", 0)
    assert plain(mixing.mix(docs).select("row.doc_id", "source", "lang", "topic", "weight", "keep")) == one


def test_drawn_marginals_of_the_production_rate(spark):
    """The expected tokens meet every target; the drawn ones miss it by what
    chance leaves (four standard deviations), for a document is kept whole or
    not at all."""
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), keep=["doc_id"]).select("source", "lang", "topic", "n_tokens", "prob", "keep").toPandas()
    got["expected"], got["drawn"] = got["n_tokens"] * got["prob"], got["n_tokens"] * got["keep"]
    got["variance"] = got["n_tokens"] ** 2 * got["prob"] * (1 - got["prob"])
    assert abs(got["expected"].sum() / got["n_tokens"].sum() - mixing.RATE) < 1e-3
    for d in mixing.POWERS:
        by = got.groupby(d)[["n_tokens", "expected", "drawn", "variance"]].sum()
        target = (by["n_tokens"] / by["n_tokens"].sum()) ** mixing.POWERS[d]
        assert (by["expected"] / by["expected"].sum() / (target / target.sum()) - 1).abs().max() < 1e-3
        assert ((by["drawn"] - by["expected"]).abs() < 4 * by["variance"] ** 0.5 + 1).all()


# ---- language id and toxicity ------------------------------------------------------------------


def test_forward_backward_equals_plain_recursion():
    rng = np.random.default_rng(0)
    n = 3
    trans, begin = rng.random((n, n)) + 0.1, np.full(n, 1 / n)
    lengths = [1, 5, 70, 130, 2]
    scores = rng.normal(size=(sum(lengths), n))
    start = np.zeros(len(scores), bool)
    start[np.cumsum([0, *lengths[:-1]])] = True
    got, at = language_id.marginals(scores, start, trans, begin), 0
    for size in lengths:
        e = np.exp(scores[at : at + size])
        alpha, beta = np.zeros((size, n)), np.ones((size, n))
        alpha[0] = begin * e[0]
        for t in range(1, size):
            alpha[t] = (alpha[t - 1] @ trans) * e[t]
            alpha[t] /= alpha[t].sum()
        for t in range(size - 2, -1, -1):
            beta[t] = trans @ (e[t + 1] * beta[t + 1])
            beta[t] /= beta[t].sum()
        p = alpha * beta
        assert np.allclose(got[at : at + size], p / p.sum(1, keepdims=True))
        at += size


def test_language_of_code_switched_text():
    rng = random.Random(3)
    words = {"aa": ["thing", "other", "with", "this"], "bb": ["zwischen", "schön", "nicht", "doch"]}
    runs = [(lang, [rng.choice(w).encode() for _ in range(50)]) for lang, w in words.items() for _ in range(40)]
    model = language_id.train(runs)
    tagger = language_id.Tagger(model)
    text = " ".join(["thing other with this"] * 10 + ["nicht doch schön"] * 2).encode()
    assert [x for x, _ in tagger.documents([text, b"", b"12 34 !!", "schön".encode(), " …".encode()])] == ["aa", "und", "und", "bb", "und"]
    p = language_id.marginals(tagger.score_words(language_id.letter_words(text)), np.arange(46) == 0, model.trans, model.begin)
    assert p[:40, 0].min() > 0.5 and p[40:, 1].min() > 0.5


def test_language_of_text_without_spaces_is_read_whole():
    assert language_id.letter_words("Ab 日本語の文章を読む, x".encode()) == ["ab".encode(), "日本語の文".encode(), "章を読む".encode(), b"x"]
    rng = random.Random(12)
    aa, bb = ["あいうえおかきくけこ", "一丁七万丈三上下不与"]
    runs = [(lang, language_id.letter_words("".join(rng.choice(own) for _ in range(200)).encode())) for _ in range(40) for lang, own in (("aa", aa), ("bb", bb))]
    tagger = language_id.Tagger(language_id.train(runs))
    text = "".join(rng.choice(aa) for _ in range(5)) + "".join(rng.choice(bb) for _ in range(300))
    assert tagger.documents([text.encode(), text[:5].encode()])[0][0] == "bb"
    assert b"".join(language_id.letter_words(text.encode())) == text.encode()


def test_every_language_is_sampled(spark):
    docs = spark.createDataFrame([(i, f"wort{i} thing other", f"l{i % 230}") for i in range(690)], "doc_id bigint, text string, lang string")
    assert len({x for x, _ in language_id.sample_runs(docs)}) == 230


def test_language_query_on_awkward_rows(spark, docs, none):
    model = language_id.train(language_id.sample_runs(docs))
    got = language_id.identify(docs, model, keep=docs.columns)
    assert got.count() == len(rows()) and got.select("row.*").columns == docs.columns
    assert got.where("score < 0 or score > 1 or lang_pred is null").count() == 0
    assert got.where("(row.text is null or trim(row.text) = '') and lang_pred <> 'und'").count() == 0
    assert language_id.identify(none, language_id.train(language_id.sample_runs(none))).count() == 0


def test_toxicity_learns_stems_and_spares_clean_text():
    rng = random.Random(9)

    def text(bad):
        w = prose(rng, rng.choice([20, 60])).split(" ")
        if bad:
            for _ in range(4):
                w[rng.randrange(len(w))] = "grumpf" + rng.choice(["en", "ig", "ach", "ste", "ung"])
        return " ".join(w).encode()

    net = toxicity.train([(text(i % 2), i % 2, "x") for i in range(300)])
    held = [(i % 2, text(i % 2).replace(b"grumpfen", b"grumpfoo")) for i in range(100)]

    def score(t):
        w = toxicity.alnum_words(t)
        known = {x: i for i, x in enumerate(dict.fromkeys(w))}
        return net.logits(net.project(list(known)), np.array([known[x] for x in w]), np.array([len(w)]))[0] + net.shift

    right = sum((score(t) >= np.log(0.3 / 0.7)) == bool(y) for y, t in held)
    assert right >= 95


def test_held_out_accuracy(spark):
    """Of the queries with their production parameters, on documents that
    neither model saw."""
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").dropDuplicates(["doc_id"])
    got = queries.op5_language_id(spark, sf).where("held_out and lang_pred <> 'und'").join(truth.where("lang is not null"), "doc_id").toPandas()
    assert len(got) > 2000 and (got["lang_pred"] == got["lang"]).mean() > 0.98
    toxic = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = queries.op4_toxicity(spark, sf).where("held_out").join(toxic, "doc_id").toPandas()
    hit = ((got["predicted"] == 1) & (got["toxic"] == 1)).sum()
    assert hit / (got["predicted"] == 1).sum() > 0.8 and hit / (got["toxic"] == 1).sum() > 0.7


def test_toxicity_on_awkward_rows(spark, docs, none):
    net = toxicity.train(toxicity.sample(docs, spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")))
    got = toxicity.score(docs, net)
    assert got.count() == len(rows()) and got.where("score < 0 or score > 1 or score is null or predicted <> cast(score >= 0.3 as int)").count() == 0
    assert toxicity.score(none, net).count() == 0
    assert toxicity.train(toxicity.sample(none, spark.createDataFrame([], "doc_id bigint, toxic int"))).by_lang == {}


# ---- nearest neighbours -----------------------------------------------------------------------


def test_nearest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(2000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    data = [(i, [float(x) for x in v[i]]) for i in range(2000)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    want = {(r.query_id, r.vec_id): r.score for r in ann.exact_nearest(df).collect()}
    got = ann.nearest(df, sample=500, leaf=60, bucket=100).collect()  # fat leaves come in parts
    assert len(got) == 100 * 20
    assert sum((r.query_id, r.vec_id) in want for r in got) >= 0.9 * len(want)
    assert all(abs(want[(r.query_id, r.vec_id)] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in want)


def test_nearest_on_awkward_rows(spark):
    same = [1.0, 0.0]
    data = [(i, same) for i in range(60)] + [(60, [0.0, 0.0]), (61, None), (62, []), (None, same), (63, [float("nan"), 1.0]), (64, [None, 1.0]), (80, [1.0, 2.0, 3.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(data, "vec_id bigint, embedding array<float>")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(by) == {0, 20, 40, 100}
    assert [v for _, v in sorted(by[20])] == [i for i in range(21) if i != 20]
    assert [v for _, v in sorted(by[100])] == list(range(20))
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


@pytest.mark.parametrize("n", [10, 15, 21, 40, 500])
def test_nearest_is_whole_on_small_tables(spark, n):
    v = np.random.default_rng(n).normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(n)], "vec_id bigint, embedding array<float>")
    want = {(r.query_id, r.rank, r.vec_id) for r in ann.exact_nearest(df, every=5).collect()}
    assert {(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, every=5).collect()} == want


def test_nearest_with_ids_that_repeat(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 8))
    near = v[0] + rng.normal(size=(400, 8)) * 1e-3
    data = [(0, v[0])] + [(1, v[0])] * 60 + [(i, v[0]) for i in range(2, 15)] + [(7, 5 * x) for x in near] + [(i, v[i]) for i in range(15, 60)]
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in data], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(df).collect()}
    for q in (0, 20, 40):
        best = {}
        for i, x in data:
            if i != q:
                best[i] = max(best.get(i, -1e9), float(x @ (v[q] if q else v[0])))
        want = sorted(best, key=lambda i: (-round(best[i], 9), i))[:20]
        assert sorted(i for a, i in got if a == q) == sorted(want)


def test_nearest_with_production_parameters_on_clusters(spark):
    """A few leaves serve where vectors have neighbours, whatever the share of
    the table in one cluster."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 16)) * 3
    own = np.where(rng.random(12_000) < 0.4, 0, rng.integers(0, 40, 12_000))
    v = centre[own] + rng.normal(size=(12_000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(df, every=200).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    right = 0
    for q in range(0, 12_000, 200):
        s = v @ v[q]
        s[q] = -9
        assert len(got[q]) == 20
        right += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert right >= 0.9 * 60 * 20
    f = ann.Forest(v, leaves=32)
    reach = f.reach(v, 20, ann.GOAL)
    held = np.bincount(f.file(v).ravel(), minlength=128).tolist()
    assert np.mean([len(f.open(x, reach, held, 0)) for x in v[::100]]) < 0.5 * 128


def test_forest_opens_by_queue_distance():
    x = np.random.default_rng(2).normal(size=(300, 8))
    f = ann.Forest(x[:40], leaves=128)
    held = np.bincount(f.file(x[:40]).ravel(), minlength=f.leaves * 4).tolist()
    key = f.keys(x[:5])
    for i in range(5):
        want = {j for j in range(len(held)) if held[j] and key[i, j] <= 1.0}
        assert set(f.open(x[i], 1.0, held, 0)) == want
    assert max(sum(held[i] for i in f.open(x[0], -1.0, held, 25) if i // f.leaves == t) for t in range(4)) >= 25
    for goal in (0.5, 0.97):
        reach, leaf = f.reach(x[:40], 5, goal), f.file(x[:40])
        found = [key.min() <= reach for i in range(40) for key in f.keys(x[i : i + 1])[0][leaf[np.argsort(-(x[:40] @ x[i]) + 1e9 * (np.arange(40) == i))[:5]]]]
        assert abs(np.mean(found) - goal) < 0.02


def test_packing_of_leaves():
    parts, first, bucket = ann.pack([0, 5, 1000, 30, 7], 3, 100)
    assert parts.tolist() == [1, 1, 10, 1, 1] and first.tolist() == [0, 1, 2, 12, 13] and len(bucket) == 14
    load = np.bincount(bucket, np.repeat(np.array([0, 5, 1000, 30, 7]) / parts, parts))
    assert load.max() <= 400


# ---- licenses ------------------------------------------------------------------------------------


def test_license_after_dense_partial_notices(spark):
    rng = random.Random(13)
    body = [f"lic{i}" for i in range(60)]
    dense = [w for _ in range(60) for w in [*body[:5], rng.choice(NAMES), rng.choice(NAMES)]]
    for tail in ([], NAMES[:300]):
        text = " ".join([*dense, *body, *tail])
        got = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), templates={"lic": [" ".join(body)]}, phrases={}).first()
        assert (got.labels, got.score) == ("lic", 1.0)


def test_similarity_equals_plain_subsequence():
    rng = random.Random(14)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(30))] for _ in range(2))
        best = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
        for i, t in enumerate(b, 1):
            for j, x in enumerate(a, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == t else max(best[i - 1][j], best[i][j - 1])
        assert license_scan.similarity(a, b) == best[-1][-1] / max(1, len(b))


def test_license_scan(spark, none):
    mit = license_scan.TEMPLATES["mit-text"][1]
    broken = mit.replace("without restriction", "with no limits at all").replace("free of charge", "free of any charge")
    data = [(1, "x MIT License MIT license"), (2, f"hello {broken} bye"), (3, "permission is granted"), (4, None), (5, ""), (5, ""), (None, "the GNU General Public License"), (6, "Licensed under CC BY-NC 4.0."), (7, prose(random.Random(0), 3000) + " Released under the MIT License.")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (5, 2, 1, 3, "mit")
    assert got[2].labels == "mit-text" and 0.8 < got[2].score < 1 and got[2].n_base == 0
    assert (got[3].labels, got[3].score, got[3].first_word) == ("", 0.0, None)
    assert got[None].base_labels == "gpl" and got[4].n_words == 0
    assert got[6].labels == "cc-by,cc-by-nc-4.0" and got[7].labels == "mit,mit-text" and got[7].first_word == 3003
    assert license_scan.scan(none).count() == 0


def test_license_votes_of_repeated_rows(spark):
    """A row's result is the same however often the row stands in the table."""
    for text in ("Permission is hereby granted, free of charge, to any person", license_scan.TEMPLATES["mit-text"][1][:120], "released under the mit license"):
        once, twice = ([(1, text)] * n + [(None, text)] * n for n in (1, 3))
        a, b = (license_scan.scan(spark.createDataFrame(x, "doc_id bigint, text string")).distinct().collect() for x in (once, twice))
        assert sorted(a, key=repr) == sorted(b, key=repr) and len(a) == 2


def test_license_scan_equals_brute_force(spark):
    """Phrases' places and the votes by diagonal, on random texts with columns
    of any name beside them and one very long text."""
    rng = random.Random(12)
    phrases, templates = license_scan.PHRASES, {"t": ["alpha beta gamma delta epsilon zeta eta theta iota kappa"]}
    body, k = templates["t"][0].split(" "), license_scan.K
    pool = [*phrases, "license", "mit", "apache", "cc", "by", "gnu general", *[" ".join(body[x : x + 5]) for x in range(0, 8, 2)]]
    texts = [" ".join(rng.choice(pool + NAMES[:4]).title() + rng.choice(["", ",", "."]) for _ in range(rng.randrange(60))) for _ in range(60)] + [prose(rng, 30_000) + " MIT license"]
    df = spark.createDataFrame([(i, x, "a", 1, "b") for i, x in enumerate(texts)], "doc_id bigint, text string, spans string, n_base int, own string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for i, text in enumerate(texts):
        words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
        hits = [(x, label) for p, label in phrases.items() for n in [len(p.split(" "))] for x in range(len(words)) if words[x : x + n] == p.split(" ")]
        at = [x for x, _ in hits]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in hits})) and set(got[i].base_labels.split(",")) - {""} <= set(got[i].labels.split(","))
    want = {}
    for i, text in enumerate(texts):
        words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
        diagonals = {}
        for a in range(len(words) - k + 1):
            for b in range(len(body) - k + 1):
                if words[a : a + k] == body[b : b + k]:
                    diagonals.setdefault(a - b, []).append(a)
        runs = []
        for d in sorted(diagonals):
            if runs and d - runs[-1][0] <= license_scan.NEAR:
                runs[-1] = (d, runs[-1][1] + diagonals[d])
            else:
                runs.append((d, diagonals[d]))
        for _, places in runs:
            want.setdefault(i, []).append((min(places), max(places) + k, len(places)))
    found = {}
    for r in license_scan.votes(license_scan._keyed(df), templates).collect():
        found.setdefault(r.doc_id, []).append((r.lo, r.hi, r.n))
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in want.items()} and want


# ---- WARC ---------------------------------------------------------------------------------------------


def warc_record(page, url, body):
    """A response record by hand, as bytes."""
    block = warc.HTTP.encode() + body
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def sha1_32(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def warc_rows():
    inner = warc_record(99, "http://x", b"payload").decode()
    return [(1, "http://a", "<p>one</p>"), (2, "http://b\r\nX: \U0001f600y", "<p>one</p>"), (3, None, inner), (4, "", None), (5, "u", ""), (6, "u", "é" * 50_000), (7, "u", inner * 3 + "WARC/1.0\r\n"), (None, "u", "<p>one</p>"), (8, "u", "\r\n\r\n"), (8, "u", "\r\n\r\n"), (9, "u", "WARC/1.0\r\n" * 5), (10, "u", "\r\n" * 9 + inner), (11, "u", inner[:-4])]


@pytest.mark.parametrize("split", [0, 7, 64, 1000])
def test_warc_round_trip(spark, split, monkeypatch):
    """Also with byte ranges so small that they part marks and headers."""
    data = warc_rows()
    df = spark.createDataFrame(data, "page_id bigint, url string, html string").withColumnRenamed("url", "url")
    keep = {}
    for i, _, h in data:
        if i is not None:
            keep[h or ""] = max(keep.get(h or "", i), i)
    want = []
    for i, _, h in data:
        body = (h or "").encode()
        revisit = sum((x[2] or "") == (h or "") for x in data) > 1 and keep[h or ""] != i
        want.append((i, len(body), sha1_32(body), "revisit" if revisit else "response", keep[h or ""] if revisit else None))
    out = scratch_path(spark, "warc-test")
    if split and split < 1000:  # hundreds of tasks
        df, want = df.where("page_id <> 6"), [w for w in want if w[0] not in (6, None)]
    warc.write(df, out, records_per_file=0 if split else 3)
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", str(split))
        assert sorted(map(tuple, warc.read(spark, out).collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    if not split:
        assert warc.roundtrip(df.limit(0)).count() == 0
        clash = df.withColumns({"digest": F.lit("x"), "keeper": F.lit(1), "value": F.lit(2), "file": F.lit("f"), "row": F.lit(3)})
        assert sorted(map(tuple, warc.roundtrip(clash).collect()), key=repr) == sorted(want, key=repr)


def test_warc_chain_rejects_marks_in_payloads(spark):
    inner = warc_record(99, "http://x", b"p").decode()
    df = spark.createDataFrame([(i, "u", f"{i}" + inner * 2) for i in range(20)], "page_id bigint, url string, html string").coalesce(1)
    out = scratch_path(spark, "warc-test")
    warc.write(df, out)
    assert warc.places(warc._pieces(spark, out)).where("next is not null").count() > 40
    got = warc.read(spark, out).collect()
    assert sorted((r.page_id, r.payload_digest) for r in got) == sorted((i, sha1_32((f"{i}" + inner * 2).encode())) for i in range(20))


def test_warc_read_survives_a_change_of_parallelism(spark, monkeypatch):
    """Executors that come or go between the two scans move no row."""
    inner = warc_record(99, "http://x", b"payload").decode()
    data = [(i, "u", f"{i} " + (inner * (i % 3)) + "x" * (i * 37 % 400)) for i in range(200)]
    out = scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame(data, "page_id bigint, url string, html string").repartition(5), out)
    inside, key = warc._spanning, "spark.sql.leafNodeDefaultParallelism"

    def later(*args):
        spark.conf.set(key, "9")
        return inside(*args)

    monkeypatch.setattr(warc, "_spanning", later)
    try:
        spark.conf.set(key, "2")
        got = sorted((r.page_id, r.payload_digest) for r in warc.read(spark, out).collect())
    finally:
        spark.conf.unset(key)
    assert got == sorted((i, sha1_32(h.encode())) for i, _, h in data)
    assert spark.conf.get(warc.SPLITS, None) is None


def test_warc_lost_payload_is_an_error(spark, monkeypatch):
    inner = warc_record(99, "http://x", b"payload").decode()
    out = scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame([(1, "u", inner), (2, "u", inner + "x")], "page_id bigint, url string, html string"), out)
    inside = warc._spanning
    monkeypatch.setattr(warc, "_spanning", lambda *a: inside(*a).limit(1))
    with pytest.raises(Exception, match="was not found again"):
        warc.read(spark, out).collect()


def test_warc_files_are_rolled_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 10_000)
    out = scratch_path(spark, "warc-test")
    df = spark.createDataFrame([(i, "u", "x" * 1500) for i in range(40)], "page_id bigint, url string, html string").coalesce(1)
    warc.write(df, out)
    files = spark.read.format("binaryFile").load(out).where("path like '%part-%'").select("length").collect()
    assert len(files) == 8 and max(f["length"] for f in files) < 12_000  # five records each
    assert warc.read(spark, out).count() == 40


def test_warc_archive_of_many_records_and_a_damaged_one(spark, tmp_path):
    """A chain longer than any number of rounds fixed beforehand; bytes that are
    no text; an end at the damaged record, whatever follows."""
    bodies = [bytes([i % 256, 0, 255]) + b"WARC/1.0\r\n" * (i % 7 == 0) for i in range(3000)]
    good = b"".join(warc_record(i, "u", x) for i, x in enumerate(bodies))
    (tmp_path / "part-0").write_bytes(good + b"WARC/1.0\r\nContent-Length: 9999\r\n\r\n" + warc_record(3000, "u", b""))
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read(spark, str(tmp_path)).where("page_id is not null").collect())
    assert got == [(i, len(x), sha1_32(x)) for i, x in enumerate(bodies)]


def test_every_numbered_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in range(1, 14) if sum(k.startswith(f"op{n}_") for k in names) != 1] == []
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(names)
