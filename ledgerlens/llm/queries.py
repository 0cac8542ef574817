"""The registered queries of this package: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bags, byte_cnn, dac, merkle, packing, perplexity, phrases, pii, separators, suffixes, superminhash, toxicity, winnowing
from ledgerlens.llm.samples import folded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: End-of-text id of the vocabulary.
END_OF_TEXT = 49407


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as flat token files, and the documents found in them."""
    folder = separators.token_folder(spark)
    files = separators.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer(), END_OF_TEXT)
    files.agg(F.sum("documents")).collect()
    return separators.find_documents(spark, folder, END_OF_TEXT)


def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table as WARC records against a replica with planted faults."""
    records = merkle.warc_records(table(spark, sf_dir, "pages"))
    return merkle.audit(merkle.index(records), merkle.index(merkle.damaged(records))).drop("right_offset")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = folded("doc_id", 5) == 0
    network = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    return toxicity.score(docs, network, "doc_id", "text", held_out.alias("held_out"))


def op6_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.fit(docs))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged by models without the document: log_perplexity is the one that low and high bound."""
    found = perplexity.quality(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("left_out").alias("log_perplexity"), "low", "high")


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = folded("doc_id", 4) == 2
    model = byte_cnn.fit(docs.where(~held_out), "text", "lang", "doc_id")
    return byte_cnn.identify(docs, model, "doc_id", "text", held_out.alias("held_out"))


def op11_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table in files of directly addressable codes, read back from them."""
    import public_tokenizers

    docs, folder = table(spark, sf_dir, "documents"), dac.dac_folder(spark)
    files = dac.write_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return dac.read_documents(files, folder, docs.schema["doc_id"].dataType.simpleString())


def op12_hat_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_separator_scan": op1_separator_scan,
    "op2_merkle_audit": op2_merkle_audit,
    "op3_suffix_array": op3_suffix_array,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_boosted_pii": op6_boosted_pii,
    "op7_superminhash": op7_superminhash,
    "op8_winnowing": op8_winnowing,
    "op9_perplexity": op9_perplexity,
    "op10_byte_cnn": op10_byte_cnn,
    "op11_dac": op11_dac,
    "op12_hat_trie": op12_hat_trie,
    "op13_bag_search": op13_bag_search,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Letters, digits and what is not ASCII.
TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

ORACLE_SQL: dict[str, str] = {
    "op7_superminhash": rf"""
with recursive d as materialized (select row_number() over (order by doc_id) as r, doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (
  select distinct r, hash(case when len(w) > 1 then w[p:p + 1] else w end) as shingle from (select r, w, unnest(range(1, greatest(2, len(w)))) as p from d where len(w) > 0)),
n as materialized (select r, count(*) as n from s group by r),
sized as materialized (select s.*, n.n from s join n on s.r = n.r),
pairs as (select a.r as x, b.r as y, a.n as na, b.n as nb, count(*) as common from sized a join sized b
  on a.shingle = b.shingle and a.r < b.r and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
links as materialized (select x, y from pairs where 100 * common >= 80 * (na + nb - common)),
ends as materialized (select x, y from links union select y, x from links),
reach as (select x, y from ends union select reach.x, ends.y from reach join ends on reach.y = ends.x),
least_ as (select x as r, min(d.doc_id) as low from reach join d on d.r = reach.y group by x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) as kept
from d left join n on n.r = d.r left join least_ on least_.r = d.r""",
    "op8_winnowing": rf"""
with d as materialized (select row_number() over (order by doc_id) as r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
items as materialized (
  select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as g from (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from b where len(w) > 0)),
windows as (
  select r, p, k, array_to_string(w[p:p + k - 1], ' ') as g from (select r, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from items) where len(w) >= k)),
hits as materialized (select r, p, windows.k, item_id from windows join items on windows.k = items.k and windows.g = items.g),
words as (select r, count(distinct p + j) as n_hit from (select r, p, unnest(range(k)) as j from hits) group by r),
found as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, cast(item_id as varchar) as item from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join words on words.r = d.r left join found on found.r = d.r""",
    "op12_hat_trie": rf"""
with p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from (select coalesce(lang, 'und') as lang, {LOWERED} as t from documents)),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
f as materialized (select lang, k, g, lang || chr(10) || g as key, f from (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as g, cast(count(*) as bigint) as f from (
    select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3)) as s(k) where len(w) >= k) group by all)),
n as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang),
candidates as materialized (select lang, k, g as phrase, f as a, string_split(g, ' ') as t from f where k > 1 and f >= 10),
cuts as materialized (select lang, phrase, a, cut, lang || chr(10) || array_to_string(t[1:cut], ' ') as key1, lang || chr(10) || array_to_string(t[cut + 1:], ' ') as key2
  from candidates, (values (1), (2)) as s(cut) where cut < k),
halves as materialized (select cuts.*, f.f as l from cuts join f on f.key = cuts.key1),
scored as (select halves.*, f.f as r, cast((cast(1000000 as hugeint) * a * a) // (cast(l as hugeint) * f.f) as bigint) as score from halves join f on f.key = halves.key2),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inner_ as (select lang, array_to_string(t[i:i + 1], ' ') as phrase, max(a) as inside from candidates, (values (1), (2)) as s(i) where k = 3 group by all),
kept as (select lowest.* from lowest left join inner_ using (lang, phrase) where 100 * coalesce(inside, 0) < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000""",
    "op13_bag_search": rf"""
with d as materialized (select row_number() over () as x, doc_id, regexp_extract_all({LOWERED}, {TERM}) as w from documents),
a as (select cast(count(*) as bigint) as n_all, cast(sum(len(w)) as bigint) as l_all from d where len(w) > 0),
q as materialized (select r, item_id, t, count(*) as q from (
  select r, item_id, unnest(w) as t from (select row_number() over () as r, item_id, regexp_extract_all({LOWERED}, {TERM}) as w from benchmark)) group by all),
tf as materialized (
  select x, doc_id, n, t, count(*) as tf from (select x, doc_id, len(w) as n, unnest(w) as t from d) where t in (select t from q) group by all),
weights as (select t, cast(floor(1000 * ln(cast(2 * n_all + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w
  from (select t, count(*) as df from tf group by t), a),
scored as (
  select r, item_id, doc_id, cast(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_all) // l_all)))) as bigint) as score
  from tf join weights using (t) join q using (t), a group by r, item_id, x, doc_id),
ranked as (select *, cast(row_number() over (partition by r order by score desc, doc_id) as integer) as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10""",
    "op2_merkle_audit": r"""
with raw as (
  select page_id, concat('segment-', cast(cast(floor(page_id / 1000) as bigint) as varchar), '.warc') as file,
    concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
      'Content-Length: ', cast(octet_length(encode(coalesce(html, ''))) as varchar), chr(13), chr(10), chr(13), chr(10),
      coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) as payload
  from pages),
placed as (
  select *, coalesce(sum(octet_length(encode(payload))) over (partition by file order by page_id rows between unbounded preceding and 1 preceding), 0) as offset_
  from raw),
drawn as (select *, page_id % 97 as draw from placed),
compared as (
  select file, cast(offset_ as bigint) as "offset", cast(1 as integer) as copy, payload,
    case draw when 7 then null when 3 then concat('#', substr(payload, 2)) when 5 then substr(payload, 1, length(payload) - 7) else payload end as other
  from drawn)
select file, "offset", copy, case when other is null then 'missing' else 'changed' end as status,
  cast(octet_length(encode(payload)) as bigint) as left_length, sha256(payload) as left_sha256,
  cast(octet_length(encode(other)) as bigint) as right_length, sha256(other) as right_sha256
from compared where other is distinct from payload""",
}
