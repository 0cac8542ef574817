"""Directly addressable codes, collocations and bag search against brute force: nulls, empty and long texts, ties, repeated rows and ids, empty tables, clashing names."""

import collections
import math
import random
import re
import zlib
from array import array

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bags, dac, phrases, queries
from ledgerlens.llm.byte_tokens import ByteWordIds

CLASHES = ["row", "n", "key", "m", "bag", "w", "lang_", "word", "item", "slot", "rank", "score", "part", "path", "base", "_order", "a.b"]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def phrase_text(rng, n):
    return "".join(rng.choice(["the cat", "Sat", "on", "the mat", "a", "\t", "É", "of the"]) + rng.choice([" ", " ", " ", "  ", ", ", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(None, "en", "the cat sat"), (None, "en", "the cat sat"), (1, None, None), (2, "en", ""), (3, "en", " \n\t "), (4, "de", "Word\x00x"), (5, None, "the cat " * 40)]
    out += [(7, "en", "a line, of words and <|endoftext|> a mark"), (7, "en", "a line, of words and <|endoftext|> a mark"), (7, "fr", "the cat")]
    out += [(20 + i % 50, rng.choice(["en", "en", "en", "de", None]), phrase_text(rng, rng.randint(1, 60))) for i in range(120)]
    return out + [(300, "en", phrase_text(rng, 9000)), (301, "es", "x" * 50000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(1, "the cat sat on the mat"), (2, "of of of É"), (3, None), (4, "unknown words"), (1, "the cat sat on the mat"), (5, "")]
    docs.where("doc_id is not null").select("doc_id", "lang", "text").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def duck(folder):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return con


def test_byte_ids(rows):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    pieces = [" ", " ", "  ", "\n", " ", "　", "\u0085", "it's", "Éa", "12", ",", "a,", "b.", "日本", "<|endoftext|>", "\x00", " <", "Ġ"]
    texts = [t for *_, t in rows] + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    plain = Tokenizer.from_file(VOCABULARY)
    words = ByteWordIds(VOCABULARY)
    for at in range(0, len(texts), 700):
        part = texts[at : at + 700]
        ids, bounds = words.encode(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in plain.encode_batch([t or "" for t in part], add_special_tokens=False)]


def test_cached_part_of_equal_hash(monkeypatch):
    """Parts that share a hash keep their own ids."""
    from ledgerlens.llm import byte_tokens

    words = ByteWordIds(VOCABULARY)
    monkeypatch.setattr(byte_tokens, "hash_spans", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    for text in ("a red car and one big old barn", "a sad fox has two bad odd cats"):
        kept = [words.encode(pa.array([w]))[0].tolist() for w in [text]]
        assert kept == [words.plain([text.encode()])[0].tolist()]


@pytest.mark.parametrize("widths", [(8, 8, 16), (4, 8, 20), (16, 16), (32,)])
def test_codes_give_any_id(widths):
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 2**32, 500), np.zeros(700), rng.integers(0, 70000, 1111)]).astype(np.uint32)
    writer = dac.Writer(widths)
    writer.add(pa.array([5, None]), np.array([5000, 311]), ids)
    reader = dac.Reader(pa.BufferReader(writer.bytes()))
    assert (reader.range(0, len(ids)) == ids).all() and reader.starts().tolist() == [0, 5000, 5311] and reader.doc_ids().to_pylist() == [5, None]
    for first in (0, 1, 7, 511, 512, 513, 3000, 5310, 5311):
        for size in (0, 1, 9, 600):
            assert (reader.range(first, min(len(ids), first + size)) == ids[first : first + size]).all()
    places = rng.integers(0, len(ids), 300)
    assert (reader.at(places, near=50) == ids[places]).all()
    with pytest.raises(IndexError):
        reader.range(0, len(ids) + 1)
    with pytest.raises(ValueError, match="directly addressable"):
        dac.Reader(pa.BufferReader(b"something else"))


@pytest.mark.parametrize("file_tokens", [dac.FILE_TOKENS, 500])
def test_files_of_documents(spark, docs, rows, file_tokens):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(VOCABULARY)
    folder = dac.dac_folder(spark)
    files = dac.write_files(docs, folder, VOCABULARY, file_tokens=file_tokens)
    got = [tuple(r) for r in dac.read_documents(files, folder).orderBy("start").collect()]
    want = collections.Counter()
    for i, _, text in rows:
        ids = array("I", [*plain.encode(text or "", add_special_tokens=False).ids, 0])
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((i, n, c) for i, _, n, c in got) == want
    assert [s for _, s, _, _ in got] == np.cumsum([0, *[n for _, _, n, _ in got]])[:-1].tolist()
    assert [i if i is not None else -1 for i, *_ in got] == sorted(i if i is not None else -1 for i, _, _ in rows)
    if file_tokens == 500:
        assert files.count() > 10 and files.where("tokens > 500 and documents > 1").count() == 0
    total = files.agg(F.sum("tokens")).first()[0]
    places = [0, 3, 3, total - 1, total, -1, *range(1000, 1040)]
    found = dac.look_up(spark.createDataFrame([(p,) for p in places], "position long"), files, folder)
    spelled = np.zeros(total, np.int64)
    parts = {(i, n, c): None for i, _, n, c in got}
    for i, _, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        parts[i, len(ids), zlib.crc32(array("I", ids).tobytes())] = ids
    for i, s, n, c in got:
        spelled[s : s + n] = parts[i, n, c]
    assert sorted(map(tuple, found.collect())) == sorted((p, int(spelled[p])) for p in places if 0 <= p < total)


def test_no_documents(spark, docs):
    folder = dac.dac_folder(spark)
    assert dac.read_documents(dac.write_files(docs.limit(0), folder, VOCABULARY), folder).count() == 0
    assert phrases.collocations(docs.limit(0)).count() == 0
    items = spark.createDataFrame([(1, "the cat")], "item_id long, text string")
    assert bags.ranked(docs.limit(0), items).count() == 0
    assert bags.ranked(docs, items.limit(0)).count() == 0


def brute_collocations(rows, least, percent, top):
    f = collections.defaultdict(collections.Counter)
    for _, lang, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        candidates = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        inside = collections.Counter()
        for g, a in candidates.items():
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    inside[part] = max(inside[part], a)
        found = []
        for g, a in candidates.items():
            if 100 * inside[g] >= percent * a and inside[g]:
                continue
            score, k = min((10**6 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("entries", [phrases.ENTRIES, 60])
def test_collocations(docs, rows, entries, monkeypatch):
    monkeypatch.setattr(phrases, "ENTRIES", entries)
    for least, top in ((2, 15), (10, 2000)):
        found = phrases.collocations(docs, least=least, top=top)
        assert sorted(map(tuple, found.collect())) == brute_collocations(rows, least, 50, top)


def test_trie_bursts_and_leaves():
    rng = random.Random(4)
    trie, want = phrases.HatTrie(True, burst=5), collections.Counter()
    got = collections.Counter()
    for _ in range(30):
        block = [(rng.randint(0, 4), rng.randint(0, 6), rng.randint(0, 20)) for _ in range(50)]
        want.update(block)
        first, second, third = (np.array(x, np.int64) for x in zip(*block))
        trie.add(first, second << 32 | third)
        if rng.random() < 0.4:
            for a, b, n in zip(*(x.tolist() for x in trie.leave(40))):
                got[a, b >> 32, b & 0xFFFFFFFF] += n
            assert sum(map(trie.size, trie.root.values())) <= 40
    assert any(isinstance(n, dict) and not isinstance(n, collections.Counter) for n in trie.root.values())
    for a, b, n in zip(*(x.tolist() for x in trie.leave(0))):
        got[a, b >> 32, b & 0xFFFFFFFF] += n
    assert got == want and not trie.root


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(rows, items, k):
    bagged = [(i, collections.Counter(terms(t)), len(terms(t))) for i, _, t in rows if terms(t)]
    n_all, l_all = len(bagged), sum(n for *_, n in bagged)
    df = collections.Counter(t for _, b, _ in bagged for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, n in bagged:
            m = 25 + 75 * n * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "block_terms", "cells"), [(10, bags.BLOCK_TERMS, bags.CELLS), (3, 4, 7), (200, 1000, 40)])
def test_bag_search(spark, docs, rows, k, block_terms, cells, monkeypatch):
    monkeypatch.setattr(bags, "CELLS", cells)
    items = [(1, "the cat sat on the mat"), (2, "of of of É"), (3, None), (4, "unknown words"), (None, "cat the mat"), (5, ""), (1, "the cat sat on the mat"), (6, "x" * 50000)]
    frame = spark.createDataFrame(items, "item_id long, text string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    found = bags.ranked(docs, frame, k=k, block_terms=block_terms)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_search(rows, items, k)


def test_long_items_are_summed_exactly(spark, docs, rows, monkeypatch):
    """The way for sums beyond 2**53 gives the same scores."""
    items = [(1, "the cat sat " * 50)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    held = bags.best_classes

    def huge(classes, weights, postings, n, k):
        return held(classes, weights, (*postings[:2], postings[2] * 10**6), n, k)

    monkeypatch.setattr(bags, "best_classes", huge)
    want = [(i, r, d, s * 10**6) for i, r, d, s in brute_search(rows, items, 10)]
    assert sorted(map(tuple, bags.ranked(docs, frame).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["op12_hat_trie", "op13_bag_search"])
def test_queries_equal_their_sql(spark, tables, name):
    found = queries.QUERIES[name](spark, tables)
    cursor = duck(tables).execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, found.select(names).collect())) == sorted(cursor.fetchall())


def test_code_query(spark, tables, rows):
    found = queries.QUERIES["op11_dac"](spark, tables)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [r[0] for r in found.orderBy("start").collect()] == sorted(i for i, *_ in rows if i is not None)
