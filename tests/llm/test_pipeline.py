"""Stages of the corpus pipeline and the whole run on a planted corpus: nulls, repeated ids and rows, names that clash, empty tables."""

import collections
import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import toxicity

#: Columns beyond those of the table: names the stages use inside, a dot, a backtick.
EXTRA = ["_text_hash", "_row", "_place", "_kept", "a.b", "c`d", "spans", "score", "doc id"]
BAD = ["scumbag", "moronic", "vileness"]


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "or", "es", "in", "ti", "ou", "le"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(200):
        w = prose(rng, rng.randint(20, 120)).split(" ")
        if i % 3 == 0:
            for _ in range(2 + len(w) // 30):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    base, item = prose(rng, 120), prose(rng, 14)
    copies = [(301, base), (300, base), (None, base), (302, base + " more words"), (301, base), (303, " ".join(base.split(" ")[:115] + ["x"] * 5))]
    other = [(300, prose(rng, 50)), (None, prose(rng, 50)), (None, None), (304, ""), (304, ""), (305, " \n")]
    hits = [(310, f"{prose(rng, 10)} {item} {prose(rng, 10)}"), (311, f"{prose(rng, 10)} {item.upper()} {prose(rng, 10)}")]
    private = [(320, f"{prose(rng, 30)} write to jane.doe@example.org now {prose(rng, 5)}"), (321, f"{prose(rng, 30)} from 10.20.30.40 {prose(rng, 5)}")]
    rows += copies + other + hits + private
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(EXTRA)])
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "short item"), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {"folder": folder, "docs": spark.read.parquet(f"{folder}/documents.parquet"), "rows": rows, "copies": copies, "hits": hits, "private": private}


def rows_of(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates_keep_one_row_of_each_group(spark, corpus):
    out = P.drop_near_duplicates(spark, corpus["docs"], corpus["folder"])
    assert out.columns == corpus["docs"].columns
    sets = [shingles(t) for _, t in corpus["rows"]]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    members = collections.defaultdict(list)
    for k, g in enumerate(group):
        members[g].append(corpus["rows"][k])
    want = collections.Counter(min(m, key=lambda r: (r[0] is None, r[0] or 0)) for m in members.values())
    got = rows_of(out)
    assert len(members) < len(sets) - 3
    assert collections.Counter(i for i, _ in got.elements()) == collections.Counter(i for i, _ in want.elements())
    assert set(got) <= set(corpus["rows"]) and got[(304, "")] == 2 and got[(None, None)] == 1


def test_decontamination(spark, corpus):
    out = P.decontaminate(spark, corpus["docs"], corpus["folder"])
    assert out.columns == corpus["docs"].columns
    assert rows_of(out) == collections.Counter(r for r in corpus["rows"] if r not in corpus["hits"])


def test_personal_data(spark, corpus):
    out = P.redact(spark, corpus["docs"], corpus["folder"])
    assert out.columns == corpus["docs"].columns and out.schema == corpus["docs"].schema
    got = {r.doc_id: r for r in out.where("doc_id >= 320").collect()}
    assert "jane" not in got[320].text and "10.20" not in got[321].text and got[320]["a.b"] == EXTRA.index("a.b")
    assert all(r.n_chars == len(r.text) for r in got.values())
    kept = rows_of(out.where("doc_id < 320 or doc_id is null"))
    assert kept == collections.Counter(r for r in corpus["rows"] if r not in corpus["private"])


def test_toxicity(spark, corpus):
    out = P.drop_toxic(spark, corpus["docs"], corpus["folder"])
    assert out.columns == corpus["docs"].columns
    kept = rows_of(out)
    toxic = [r for r in corpus["rows"][:200] if r[0] % 3 == 0]
    clean = [r for r in corpus["rows"] if r not in toxic]
    assert sum(kept[r] for r in toxic) <= 0.1 * len(toxic) and sum(min(kept[r], 1) for r in clean) >= 0.9 * len(clean)
    assert kept[(None, None)] == 1 and not set(kept) - set(corpus["rows"])


def test_run(spark, corpus, monkeypatch):
    """Every stage works on what the one before it kept; every kept document is packed whole."""
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: None)  # no network: nothing is toxic
    assert [n for n, _ in P.STAGES] == ["toxicity", "near-duplicates", "benchmark decontamination", "personal data", "packing"]
    pieces = P.run(spark, corpus["folder"]).collect()
    docs = collections.Counter()
    for p in pieces:
        docs[p.doc_id] += p.length
    assert not {310, 311, 302, 303} & set(docs) and {300, 304, 320, 321, None} <= set(docs)
    spaces = collections.defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == spaces[p.sequence_id]
        spaces[p.sequence_id] += p.length
    assert max(spaces.values()) <= 4096


def test_no_documents(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus['folder']}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
