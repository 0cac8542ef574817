"""Repeated and null ids, markers inside texts, replicas written anew, samples of repeated rows."""

import random

import pytest

from ledgerlens.llm import merkle, queries, samples, separators, suffixes
from ledgerlens.llm.tokens import WordIds


def fresh(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.getrandbits(40):x}" for _ in range(n)]


def test_spans_belong_to_a_text_not_to_an_id(spark):
    rng = random.Random(5)
    part, other = fresh(rng, 60), fresh(rng, 70)
    rows = [
        (None, " ".join(fresh(rng, 10) + part + fresh(rng, 15))), (None, " ".join(fresh(rng, 20) + part)), (3, " ".join(part)),
        (2, " ".join(other + fresh(rng, 5))), (2, " ".join(fresh(rng, 30) + other)), (2, " ".join(fresh(rng, 8))), (4, " ".join(other)),
        (4, " ".join(other)), (5, None), (None, None), (6, "")]
    # two texts of one id alone repeat nothing
    only = " ".join(fresh(rng, 60))
    rows += [(7, only), (7, only + " more"), (7, only)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id or 0, r.start, r.end) for r in suffixes.repeats(docs).collect()))
    assert got == [(0, 10, 70), (0, 20, 80), (2, 0, 70), (2, 30, 100), (3, 0, 60), (4, 0, 70)]
    assert len({r.text_hash for r in suffixes.repeats(docs).where("doc_id = 2").collect()}) == 2


def test_markers_inside_texts_do_not_split_them(spark, tmp_path):
    texts_ = ["before <|endoftext|> after", "plain words here", "<|endoftext|>", "", None, "<|endoftext|><|endoftext|> twice"]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").repartition(2)
    folder = str(tmp_path / "files")
    written = separators.write_token_files(docs, folder, queries.tokenizer(), queries.END_OF_TEXT).collect()
    found = separators.find_documents(spark, folder, queries.END_OF_TEXT).collect()
    assert sum(r.documents for r in written) == len(found) == len(texts_) and all(r.terminated for r in found)
    assert sum(r.tokens for r in written) == sum(r.length + 1 for r in found)
    plain = len(WordIds(queries.tokenizer()).encode(b"plain words here")) // 4
    assert plain in [r.length for r in found] and sorted(r.length for r in found)[:2] == [0, 0]


def test_separators_that_are_words_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    with pytest.raises(Exception, match="among its ids"):
        first = int.from_bytes(WordIds(queries.tokenizer()).encode(b"one")[:4], "little")
        separators.write_token_files(docs, str(tmp_path / "x"), queries.tokenizer(), first).collect()


def test_a_lost_record_moves_those_behind_it(spark):
    rng = random.Random(6)
    payloads = [f"record {i} " + "y" * rng.randint(0, 300) for i in range(300)]
    payloads[250] = payloads[10]  # an equal record twice

    def file(rows):
        at, out = 0, []
        for p in rows:
            out.append(("f", at, p))
            at += len(p)
        return out

    left, right = file(payloads), file(payloads[:120] + payloads[121:])
    frame = lambda rows: merkle.index(spark.createDataFrame(rows, "file string, offset long, payload string"), span=2048)
    got = merkle.audit(frame(left), frame(right), fan=4).collect()
    assert [(r.offset, r.left_length) for r in got if r.status != "moved"] == [(left[120][1], len(payloads[120]))]
    assert [r.status for r in got if r.status != "moved"] == ["missing"]
    assert {(r.offset, r.right_offset) for r in got if r.status == "moved"} == {(left[i][1], right[i - 1][1]) for i in range(121, 300)}
    back = merkle.audit(frame(right), frame(left), fan=4).where("status <> 'moved'").collect()
    assert [(r.offset, r.status) for r in back] == [(left[120][1], "extra")]


def test_samples_stay_bounded_under_repeats(spark):
    rows = [(1, "same", "a")] * 20000 + [(i, f"text {i}", "a") for i in range(2, 3002)] + [(i, f"text {i}", "b") for i in range(50)] + [(9, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = samples.bounded(docs, "lang", 600, "doc_id", "text").groupBy("lang").count().collect()
    assert {r["lang"] for r in got} == {"a", "b"}
    counts = {r["lang"]: r["count"] for r in got}
    assert counts["b"] == 50 and 450 < counts["a"] < 750
