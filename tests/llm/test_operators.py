"""The operators on small tables against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import byte_cnn, merkle, packing, perplexity, pii, queries, separators, suffixes, superminhash, toxicity, winnowing
from ledgerlens.llm.tokens import WordIds

#: Names that the operators use inside, carried by the inputs as extra columns.
CLASHES = ["row", "hits", "n", "k1", "class", "score", "spans", "key", "gram", "sequence_id", "_text", "bands", "log_p", "ids", "items"]


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "or", "es", "in", "ti", "ou", "le"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def near(rng, text, share):
    return " ".join(prose(rng, 1) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base, passage = prose(rng, 200), prose(rng, 60)
    out = {1: None, 2: "", 3: " \n\t ", 4: "Word", 5: "word", 6: "two words", 7: prose(rng, 9000), 8: base, 9: base, 10: base.upper()}
    out |= {20 + i: near(rng, base, 0.02 + 0.01 * (i % 6)) for i in range(24)}
    out |= {60 + i: prose(rng, 30) + " " + passage + " " + prose(rng, 20 + i) for i in range(6)}
    out |= {80 + i: prose(rng, rng.randint(1, 120)) for i in range(20)}
    out |= {100: "a line\nA line\na line\n\n  \na line", 101: "x y z x y z x y z w", 102: "### % a|b <c>\x00d \x85 e", 103: "é à ü " * 20}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def words(text, pattern=r"[^\x20\x09-\x0D]+", lower=True):
    text = text or ""
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def rows(df):
    return {r[0]: r for r in df.collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, texts, size):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = rows(superminhash.near_duplicates(docs, size=size))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert len({find(i) for i in range(20, 44)}) < 24


def test_near_duplicate_blocks(spark):
    """A chain: neighbours are linked, the ends are far apart, so one leader per bucket does not settle it."""
    rng = random.Random(3)
    chain = [[f"w{k}" for k in range(300)]]
    for step in range(40):
        w = list(chain[-1])
        for k in rng.sample(range(300), 14):
            w[k] = f"n{step}x{k}"
        chain.append(w)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(chain)], "doc_id long, text string")
    got = rows(superminhash.near_duplicates(df, size=2))
    assert {r.component_id for r in got.values()} == {0}


def test_near_duplicates_ids_and_empty(spark, docs):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(map(str, superminhash.near_duplicates(df, size=2).collect()))
    assert got == sorted(["Row(doc_id=None, n_shingles=3, component_id=7, kept=False)", "Row(doc_id=7, n_shingles=3, component_id=7, kept=True)",
                          "Row(doc_id=7, n_shingles=3, component_id=7, kept=True)", "Row(doc_id=None, n_shingles=0, component_id=None, kept=True)"])
    assert superminhash.near_duplicates(docs.where("false")).count() == 0


def test_signature_agreement_follows_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)])
    sig = superminhash.signatures(np.concatenate([a, b]), np.array([0, 300, 600]), 256)
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.1
    assert (superminhash.signatures(a[:1], np.array([0, 1]), 16) >> 40 < 16).all()


def test_winnowing(spark, docs, texts):
    rng = random.Random(9)
    w = words(texts[7])
    items = {1: " ".join(w[100:140]), 2: " ".join(w[500:510]), 3: "Word", 4: None, 5: "", 6: prose(rng, 40), 7: " ".join(w[500:510]), 8: "two, words!", 9: " ".join(w[900:905]), 10: " ".join(w[1:9])}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    known = collections.defaultdict(set)
    for i, t in items.items():
        u = words(t, pattern)
        for k in range(len(u) - min(10, len(u)) + 1 if u else 0):
            known[tuple(u[k : k + min(10, len(u))])].add(i)
    got = rows(winnowing.find_contamination(docs, bench))
    for i, t in texts.items():
        u, hit, found = words(t, pattern), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(u) - n + 1):
                if (ids := known.get(tuple(u[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= ids
        assert (got[i].n_words, got[i].n_hit, list(got[i]["items"])) == (len(u), len(hit), sorted(found)), i
        assert sum(s.end - s.start for s in got[i].spans) == len(hit)
    assert winnowing.find_contamination(docs.where("false"), bench).count() == 0
    assert all(r.n_hit == 0 for r in winnowing.find_contamination(docs, bench.where("false")).collect())


def test_repeats(docs, texts):
    got = collections.defaultdict(set)
    for r in suffixes.repeats(docs).collect():
        assert r.end - r.start >= 50
        got[r.doc_id] |= set(range(r.start, r.end))
    for least, inside in ((50, True), (27, False)):
        seen = collections.defaultdict(set)
        for i, t in texts.items():
            w = words(t)
            for k in range(len(w) - least + 1):
                seen[tuple(w[k : k + least])].add(i)
        for i, t in texts.items():
            w = words(t)
            want = {x for k in range(len(w) - least + 1) if len(seen[tuple(w[k : k + least])]) > 1 for x in range(k, k + least)}
            assert want <= got[i] if inside else got[i] <= want, (i, least)
    assert got[60] and suffixes.repeats(docs.where("false")).count() == 0


def test_repeats_are_shared_by_two_documents(spark):
    """Shares with different documents that chain to 50 words are no repeat; the result is that of 50-word brute force."""
    rng = random.Random(31)
    w = [f"w{k}" for k in range(51)]
    part = [prose(rng, 35) for _ in range(8)]
    texts_ = [f"{prose(rng, 9)} {' '.join(w)} {prose(rng, 9)}", f"{prose(rng, 9)} {' '.join(w[:39])} {prose(rng, 9)}", f"{prose(rng, 9)} {' '.join(w[12:])} {prose(rng, 9)}"]
    texts_ += [" ".join(rng.sample(part, 5)) for _ in range(12)]
    got = collections.defaultdict(set)
    for r in suffixes.repeats(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")).collect():
        got[r.doc_id] |= set(range(r.start, r.end))
    seen = collections.defaultdict(set)
    for i, t in enumerate(texts_):
        for k in range(len(words(t)) - 49):
            seen[tuple(words(t)[k : k + 50])].add(i)
    for i, t in enumerate(texts_):
        u = words(t)
        assert got[i] == {x for k in range(len(u) - 49) if len(seen[tuple(u[k : k + 50])]) > 1 for x in range(k, k + 50)}, i
    assert not got[0] and any(got.values())


def test_packing_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer())
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    got, sequences = collections.defaultdict(dict), collections.defaultdict(dict)
    for r in packing.packed(docs, queries.tokenizer()).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id][r.start] = ids
        sequences[r.sequence_id][r.offset] = r.length
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in got.items()} == want
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset in sorted(parts):
            assert offset == at
            at += parts[offset]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.01 * sum(map(len, want.values()))
    assert packing.packed(docs.where("false"), queries.tokenizer()).count() == 0


def test_best_fill_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 60): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        capacity = rng.randint(1, 150)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = packing.best_fill(sorted(counts), counts, capacity)
        assert all(got[n] <= counts[n] for n in got)
        assert sum(n * c for n, c in got.items()) == max(s for s in sums if s <= capacity)


def test_equal_lengths_leave_little_padding():
    pool = packing.Pool(0)
    for i in range(100):
        pool.add(i, 0, bytes(4 * 1500), 1500)
    while pool.tokens >= 4096:
        pool.fill(4096, 16)
    while pool.tokens:
        pool.fill(1 << (pool.tokens.bit_length() - 1), 0)
    size = collections.Counter()
    for r in pool.rows():
        size[r[4]] += r[2]
    assert sum(size.values()) == 150_000 and all(s == 4096 or s & (s - 1) == 0 or 4096 - s <= 16 for s in size.values())


def test_words_of_a_text_give_its_ids():
    from tokenizers import Tokenizer

    path = queries.tokenizer()
    tokenizer, own = Tokenizer.from_file(path), WordIds(path)
    for text in ["Hi<|endoftext|>there <|ENDOFTEXT|>", "Á B\xa0c\x1cd İ Σας ΟΔΟΣ.", "it's 'S don't. ...,. a.,b", "", " ", "x" * 3000 + " y", "\x00a b", "日本,。 12,3"]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode_all([text.encode()])[0], "<u4").tolist() == want == np.frombuffer(own.encode(text.encode()), "<u4").tolist()


def test_separator_scan(spark, docs, texts, tmp_path):
    rng = np.random.default_rng(0)
    want = set()
    for k in range(4):
        a = np.where(rng.random(3000) < 0.01, 7, rng.integers(10, 20, 3000)).astype("<u2")
        a = {0: np.where(np.arange(3000) < 2500, 12, a), 1: a[:0], 2: np.concatenate([[7, 7], a, [7]])}.get(k, a).astype("<u2")
        a.tofile(tmp_path / f"t{k}.bin")
        start = n = 0
        for i in np.flatnonzero(a == 7):
            want.add((f"t{k}.bin", n, start, int(i) - start, True))
            start, n = int(i) + 1, n + 1
        if start < len(a):
            want.add((f"t{k}.bin", n, start, len(a) - start, False))
    assert {tuple(r) for r in separators.find_documents(spark, str(tmp_path), 7, 2, 64).collect()} == want
    folder = str(tmp_path / "own")
    written = separators.write_token_files(docs, folder, queries.tokenizer(), 49407).collect()
    assert sum(r.documents for r in written) == len(texts)
    found = separators.find_documents(spark, folder, 49407).collect()
    own = WordIds(queries.tokenizer())
    assert sorted(r.length for r in found) == sorted(len(own.encode((t or "").encode())) // 4 for t in texts.values())


def test_merkle_audit(spark):
    rng = random.Random(4)
    left = [(f"f{i % 3}", 500 * i, f"record {i} " + "x" * rng.randint(0, 400)) for i in range(600)] + [("f0", 10**7, None), (None, 5, "no file"), ("f1", None, "no offset"), ("f0", 0, "again")]
    right = list(left)
    right[17] = (right[17][0], right[17][1], "changed")
    right[600] = ("f0", 10**7, "")  # null against empty
    del right[41]
    right += [("f9", 0, "extra file"), ("f2", 123, "extra record")]
    frame = lambda rows: merkle.index(spark.createDataFrame(rows, "file string, offset long, payload string"), span=4096)
    got = {(r.file, r.offset, r.status) for r in merkle.audit(frame(left), frame(right), fan=4).collect()}
    assert got == {(left[17][0], left[17][1], "changed"), (left[41][0], left[41][1], "missing"), ("f0", 10**7, "changed"), ("f9", 0, "extra"), ("f2", 123, "extra")}
    assert merkle.audit(frame(left), frame(left)).count() == 0
    assert merkle.audit(frame(left).where("false"), frame(left).where("false")).count() == 0


def base_spans(text):
    def luhn(d):
        return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, d[::-1]))) % 10 == 0

    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(1)
    parts = ["1", "23", ".", "-", " ", "+", "(", "@", "a", "b.c", "%", "256", "4.5.6.7", "é", "4111111111111111", "\n", "00000000000000000000001"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(text) == base_spans(text), text
    assert pii.base_spans("9" * 200_000 + " a@b.c") == [("email", 200_001, 200_006)]


def test_personal_data(spark):
    rng = random.Random(8)
    rows_ = []
    for i in range(300):
        t = prose(rng, 20)
        t += {0: f" mail u{i}@host{i}.org now", 1: f" call +44 20 7946 {1000 + i}", 2: f" from 10.0.{i % 256}.7 to", 3: " pay 4111 1111 1111 1111.", 4: " é 1234567", 5: ""}[i % 6]
        rows_.append((i, t, "x"))
    rows_ += [(1000, None, "x"), (1001, "", "x"), (1001, "a@b.co", "y"), (1002, "1." * 50_000, "x")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, spans string")
    got = pii.find_spans(df, pii.fit(df), "doc_id", "text", True, F.col("text").alias("was")).collect()
    assert len(got) == len(rows_)
    for r in got:
        assert [tuple(s) for s in r.spans if s.kind in pii.KINDS] == base_spans(r.was)
        assert r.redacted == r.was or r.spans
    texts_ = {r.doc_id: r.redacted for r in got}
    assert "@" not in texts_[0] and texts_[0].count("<email>") == 1 and texts_[1000] is None
    nothing = pii.fit(df.where("false"))
    assert pii.find_spans(df.where("false"), nothing).count() == 0
    assert [tuple(s) for s in pii.find_spans(df.where("doc_id = 0"), nothing).first().spans] == base_spans(rows_[0][1])


def test_near_misses_of_personal_data(spark):
    """Formats that the patterns miss are found and redacted, lookalikes are not; neither stands in the texts that the trees see."""
    rng = random.Random(18)

    def card(n, sep):
        d = f"4{n:014d}"
        d = next(d + c for c in "0123456789" if pii.luhn(d + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    rows_ = []
    for i in range(900):
        ip = f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}"
        span = [f"u{i}.x@host{i % 40}.org", f"+44 20 {7000 + i} {1000 + i}", f"+1 ({200 + i % 700}) 555-{1000 + i}", ip, card(i * 7919, ""), str(10**15 + 2 * i)][i % 6]
        rows_.append((i, f"{prose(rng, 12)} {span} {prose(rng, 12)}"))
    near = {"email": ["ann.lee [at] firm.net", "bo(at)shop.example.com", "cy @ mail.org"], "phone": ["44 20 7946 1234", "1 (415) 555-2671", "0044 20 7946 5678"],
            "ip": ["10:20:30:40", "192 . 168 . 1 . 77", "172. 16. 254. 3"], "card": [card(123456789, "."), card(987654321, "/")]}
    other = ["see you @ noon", "1:300:400:999", "2024-03-15 10:20:30", "1234567", "4111.1111.1111.1112", "9333317852687140"]
    planted = {2000 + k: (kind, span) for k, (kind, span) in enumerate((kind, span) for kind, spans in near.items() for span in spans)}
    texts_ = {i: f"{prose(rng, 12)} {span}, {prose(rng, 12)}" for i, (_, span) in planted.items()}
    texts_ |= {3000 + k: f"{prose(rng, 12)} {span} {prose(rng, 12)}" for k, span in enumerate(other)}
    finder = pii.fit(spark.createDataFrame(rows_ + rows_[:300], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(list(texts_.items()), "doc_id long, text string"), finder, redact=True).collect()}
    for i, (kind, span) in planted.items():
        at = texts_[i].index(span)
        assert base_spans(texts_[i]) == [] and [tuple(s) for s in got[i].spans] == [(f"{kind}_like", at, at + len(span))], span
        assert got[i].redacted == texts_[i].replace(span, f"<{kind}>")
    for i in range(3000, 3000 + len(other)):
        assert not got[i].spans, texts_[i]


def test_quality_figures(docs, texts):
    with_lang = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    got = rows(perplexity.quality(with_lang))
    for i, t in texts.items():
        t = t or ""
        w = words(t, lower=False)
        lines = [x for x in t.split("\n") if words(x)]
        count = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {x for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for x in (k, k + 1, k + 2)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed), i
        assert not (failed and r.kept)
    assert perplexity.quality(with_lang.where("false")).count() == 0


def kneser_ney(texts_, order):
    """Interpolated modified Kneser-Ney by dictionaries."""
    tables = {order: collections.Counter()}
    for t in texts_:
        b = bytes(int(perplexity.FOLDED[x]) for x in t.encode())
        b = b" " * (order - 1) + b
        tables[order].update(b[k : k + order] for k in range(len(b) - order + 1))
    for n in range(order - 1, 0, -1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])
    p = {b"": 1 / 256}
    for n in range(1, order + 1):
        c = [sum(v == k for v in tables[n].values()) for k in range(6)]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0
        d = [min(k - 0.05, max(0.05, k - (k + 1) * y * c[k + 1] / c[k])) if c[k] and c[k + 1] else 0.5 for k in (1, 2, 3)]
        total, spare = collections.Counter(), collections.Counter()
        for g, v in tables[n].items():
            total[g[:-1]] += v
            spare[g[:-1]] += d[min(v, 3) - 1]
        now = {g: (v - d[min(v, 3) - 1]) / total[g[:-1]] + spare[g[:-1]] / total[g[:-1]] * p[g[1:]] for g, v in tables[n].items()}
        p = now | ({b"": 1.0} if n == 0 else {})
    return p


def test_perplexity(spark, monkeypatch):
    rng = random.Random(6)
    texts_ = [prose(rng, 60) for _ in range(12)] + ["Qz9!" * 90]
    df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts_)], "doc_id long, text string, lang string")
    p = kneser_ney(texts_, 3)
    for shard in (perplexity.SHARD, 100):  # in one pass and in several
        monkeypatch.setattr(perplexity, "SHARD", shard)
        got = rows(perplexity.quality(df, order=3))
        for i, t in enumerate(texts_):
            b = b"  " + bytes(int(perplexity.FOLDED[x]) for x in t.encode())
            want = -sum(np.log(p[b[k : k + 3]]) for k in range(len(b) - 2)) / (len(b) - 2)
            assert abs(got[i].log_perplexity - want) < 1e-4
    assert all(r.low < r.high for r in got.values())


def test_unusual_texts_are_rejected(spark):
    """Random and shuffled texts with bytes of their own, single and copied, lie outside the band of texts that they stand among."""
    rng = random.Random(16)
    letter = "abcdefghijklmnopqrstuvwxyz"
    rows_ = [(i, prose(rng, 150)) for i in range(300)]
    noise = [" ".join("".join(rng.choice(letter) for _ in range(rng.randint(2, 9))) for _ in range(120)) for _ in range(6)]
    shuffled = ["".join(rng.sample(t, len(t))) for _, t in rows_[:6]]
    rows_ += [(1000 + i, t) for i, t in enumerate([*noise, *shuffled, *noise[:1] * 10])]
    got = rows(perplexity.quality(spark.createDataFrame([(i, t, "xx") for i, t in rows_], "doc_id long, text string, lang string")))
    assert not any(r.base_failed for r in got.values())
    assert not any(r.kept for i, r in got.items() if i >= 1000)
    assert all(r.kept for i, r in got.items() if i < 1000)
    assert len({got[i].left_out for i in (1000, *range(1012, 1022))}) == 1


def test_left_out_is_the_other_folds_model(spark):
    rng = random.Random(26)
    texts_ = [prose(rng, 60) for _ in range(12)] + ["Qz9!" * 90]
    df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts_)], "doc_id long, text string, lang string")
    folds = {r[0]: r[1] for r in df.select("doc_id", perplexity.fold("text")).collect()}
    assert set(folds.values()) == {0, 1}

    got = rows(perplexity.quality(df, order=1))
    for i, t in enumerate(texts_):
        p = kneser_ney([u for k, u in enumerate(texts_) if folds[k] != folds[i]], 1)
        b = [bytes([int(perplexity.FOLDED[x])]) for x in t.encode()]
        if all(x in p for x in b):
            assert abs(got[i].left_out + sum(np.log(p[x]) for x in b) / len(b)) < 1e-4


def test_language(spark):
    rng = random.Random(7)
    parts = {"aa": ["the", "ing", "er", "on"], "bb": ["sch", "ung", "ü", "keit"], "cc": ["eau", "é", "ment", "oi"]}
    rows_ = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(rng.randint(5, 80))), k) for i in range(150) for k in [sorted(parts)[i % 3]]]
    df = spark.createDataFrame([*rows_, (900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "bb"), (903, "é", None), (903, "the " * 20_000, None)], "doc_id long, text string, lang string")
    model = byte_cnn.fit(df.where("doc_id < 100"), "text", "lang", "doc_id")
    got = byte_cnn.identify(df, model).collect()
    held = [r for r in got if 100 <= r.doc_id < 150]
    assert np.mean([r.lang_pred == rows_[r.doc_id][2] for r in held]) >= 0.95
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)] == [("und", 0.0)] * 3
    assert {r.lang_pred for r in got if r.doc_id == 903} == {"aa", "cc"} and all(0 <= r.score <= 1 for r in got)
    assert byte_cnn.fit(df.where("false"), "text", "lang", "doc_id") is None
    assert {r.lang_pred for r in byte_cnn.identify(df, None).collect()} == {"und"} and byte_cnn.identify(df.where("false"), model).count() == 0


def test_byte_tables_sum_like_a_convolution():
    rng = np.random.default_rng(0)
    f = byte_cnn.FILTERS
    model = byte_cnn.ByteCnn(["a", "b"], [rng.normal(size=(w, 256, f)).astype(np.float32) for w in byte_cnn.WIDTHS], np.zeros(f * 3, np.float32), np.zeros((f * 3, 2), np.float32), np.zeros(2, np.float32))
    x = rng.integers(0, 256, (3, byte_cnn.WINDOW)).astype(np.uint8)
    want = np.concatenate([sum(t[j][x[:, j : byte_cnn.WINDOW - w + 1 + j]] for j in range(w)).max(axis=1) for w, t in zip(byte_cnn.WIDTHS, model.filters)], axis=1)
    assert np.allclose(model.features(x), np.maximum(want, 0), atol=1e-4)


def test_toxicity(spark):
    rng = random.Random(11)
    bad = ["scumbag", "moronic", "vileness"]
    rows_ = []
    for i in range(240):
        w = prose(rng, rng.randint(5, 150)).split(" ")
        if i % 3 == 0:
            for _ in range(1 + len(w) // 40):
                w[rng.randrange(len(w))] = rng.choice(bad).title() + rng.choice(["", ",", "."])
        rows_.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows_] + [(900, None, "x"), (901, "", "x"), (1, rows_[1][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows_ if i < 180] + [(None, 1), (3, None), (900, 0)], "doc_id long, toxic int")
    network = toxicity.fit(df, labels, steps=500)
    got = toxicity.score(df, network).collect()
    held = [r for r in got if 180 <= r.doc_id < 240]
    assert np.mean([r.predicted == rows_[r.doc_id][2] for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got) and len(got) == 243
    assert toxicity.fit(df, labels.where("false")) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0} and toxicity.score(df.where("false"), network).count() == 0


def test_gradients_of_the_network():
    import pyarrow as pa

    column = pa.array(["one two three", "two four " * 30, ""])
    words_ = toxicity.words_of(column, toxicity.LETTER_LOWER)
    data, _ = toxicity.text_bytes(column)
    pieces, _ = toxicity.pieces_of(data, words_.starts, words_.ends)
    network = toxicity.Network.new(1, np.unique(words_.hashes), np.unique(pieces))
    network.values = {k: v.astype(np.float64) for k, v in network.values.items()}
    known = toxicity.Vocabulary(data, words_, network.word_keys, network.piece_keys)
    places, first = toxicity.window_rows(words_.offsets)
    all_rows, labels = known.rows(places), (np.arange(len(places)) % 2).astype(float)

    def loss():
        p = toxicity.sigmoid(network.logits(known, all_rows).astype(float))
        return -np.mean(np.log(np.where(labels == 1, p, 1 - p)))

    grads = network.gradients(known, all_rows, labels, np.ones(len(labels)))
    for name, at in (("in_f", (3, 5)), ("state_b", (2, 7)), ("attend_f", (1,)), ("out_b", (4,)), ("word", (0, 2)), ("piece", (1, 3)), ("bias_f", (20,))):
        step = 1e-2
        network.values[name][at] += step
        up = loss()
        network.values[name][at] -= 2 * step
        down = loss()
        network.values[name][at] += step
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3, name


def test_folds_match_crc32(spark):
    from ledgerlens.llm.samples import folded

    got = spark.range(50).select("id", folded("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_op8_digest(spark, docs, texts, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(12, texts[8]), (3, texts[8])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    r = rows(queries.op8_winnowing(spark, str(tmp_path)))[9]
    assert r.items_sha256 == hashlib.sha256(b"12,3").hexdigest() and r.n_items == 2 and r.contaminated


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    from checks import compare, duck

    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    assert compare(queries.QUERIES[name](spark, sf), con, queries.ORACLE_SQL[name]) is None
    assert con.execute(f"select * from ({queries.ORACLE_SQL[name]}) limit 2000000").fetchall() is not None


def test_thresholds_come_from_all_texts(spark):
    # Held-out examples of every text are counted, those of equal texts once, whatever the trees were fitted on.
    texts_ = [f"Write to user{i}@mail{i}.example.org or +49 30 {1000000 + 7919 * i}." for i in range(60)]
    df = spark.createDataFrame([(t,) for t in texts_ + texts_[:20]], "text string").repartition(4)
    want = [(int(x[0]), int(y)) for t in texts_ for x, y, missed, span in pii.examples(t) if missed and span % 3 == 0]
    got = pii.scored_examples(df, pii.boosting.BoostedTrees(3)).collect()
    assert {r.kind: (r.seen, r.right) for r in got} == {k: (sum(a == k for a, _ in want), sum(y for a, y in want if a == k)) for k, _ in want}
    few, every = pii.fit(df, most=1), pii.fit(df)
    assert len(few.thresholds) == len(every.thresholds) == 4 and all(0.5 <= t for t in every.thresholds)
    assert pii.thresholds(np.array([60000, 50000, 40000]), np.array([5, 95, 9]), np.array([5, 93, 0]), np.zeros(3), 0.98)[0] == 50000 / pii.STEPS
