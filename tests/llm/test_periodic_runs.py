"""Periodic runs against all pairs of places, and the contract's digests."""

import hashlib
import random
import re
import zlib

from lumenspan.llm import periodic_runs, queries


def brute(words, least=12):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, t - s, q) for (s, t), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(1, 8)):
            n = rng.choice([0, 1, 5, 30, 80, 200])
            words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(n)]
            for _ in range(rng.randrange(3)):
                if n > 4:
                    a, p = rng.randrange(n), rng.randrange(1, n)
                    for i in range(a + p, min(n, a + p * rng.randrange(2, 6))):
                        words[i] = words[i - p]
            docs.append(words)
        docs.append(list(docs[0]))  # equal documents share no run
        least = rng.choice([2, 4, 12])
        assert [list(map(tuple, r.tolist())) for r in periodic_runs.runs_of(docs, least)] == [brute(w, least) for w in docs]


def test_pairs_in_slices(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    words = [b"a", b"b", b"c"] * 9 + [b"x"] + [b"a", b"b", b"c"] * 7 + [b"y"] * 20
    assert list(map(tuple, periodic_runs.runs_of([words])[0].tolist())) == brute(words)


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    cols = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *cols, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    data = []
    for i in range(150):
        words = [rng.choice(["a", "b", "ä", "Wort", "日本"]) + rng.choice(["", "1", "2"]) for _ in range(rng.choice([1, 4, 20, 60, 150]))]
        if rng.random() < 0.4:
            p = rng.randrange(1, 12)
            words = [words[j % p] if j > 3 else w for j, w in enumerate(words)]
        data.append((i, rng.choice([" ", "\t", " \n"]).join(words)))
    data += [(200, None), (201, ""), (202, " \r\n\x0b\x0c "), (None, "x " * 30), (None, None), (3, data[3][1]), (3, data[3][1]), (3, data[4][1]), (203, "long " + " ".join(f"v{j % 700}" for j in range(20000)))]
    rows = [(i, t, "en", "clash", 1, "row") for i, t in data]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, runs string, collapsed int, h string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [digest(i, t) for i, t in data if i != 203]
    assert sorted(map(tuple, got.where("doc_id is null or doc_id <> 203").collect()), key=repr) == sorted(want, key=repr)
    long = got.where("doc_id = 203").first()
    assert zlib.crc32(b"203") % 10 and (long["n_runs"], long["start"], long["length"], long["period"]) == (1, 1, 20000, 700)
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert periodic_runs.digests(periodic_runs.find_runs(periodic_runs.plant(none))).count() == 0
