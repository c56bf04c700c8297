"""The registered queries of the corpus operators, each over its whole table, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, fingerprints, lines, mixing, neardup, packing, phrases, quality, secrets, substrings, toxicity, warc, whitening
from .common import materialize, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "group_id", "kept")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(read(spark, sf_dir, "documents"))
    # the digest stands for the ids, which need not be kept for it
    slim = materialize(pieces.select("doc_id", "row", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packing.pack(slim).drop("row")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint_edits(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("line_count").alias("n_lines"), F.col("line_removed").alias("n_removed"), F.sha2("line_kept", 256).alias("kept_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest("spans").alias("spans"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", *(F.col(f"mix_{c}").alias(c) for c in ("size", "source_size", "target", "taken")))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(read(spark, sf_dir, "pages"))
    records = warc.read_archives(spark, [path for path, _, _ in archives], keep_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), lexicon, "score")
    return scored.select("doc_id", toxicity.is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


OP10_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
top as (select html, max(page_id) as top from p where octet_length(encode(html)) >= 1000 group by html)
select p.page_id, octet_length(encode(p.html)) as payload_bytes, sha1(p.html) as payload_digest,
       case when top.top is null or top.top = p.page_id then 'response' else 'revisit' end as record_type,
       case when top.top <> p.page_id then top.top end as refers_to
from p left join top on p.html = top.html
"""

_WORDS = r"words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents)"

OP1_SQL = f"""
with recursive {_WORDS},
sh as (select doc_id, s, count(*) as n from (
    select doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') as s
    from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from words where len(ws) > 0)) group by all),
total as (select doc_id, sum(n) as n from sh group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, sum(least(a.n, b.n)) as n from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
near as (select a, b from shared join total x on x.doc_id = a join total y on y.doc_id = b where shared.n >= 0.8 * (x.n + y.n - shared.n)),
edge as (select a, b from near union all select b, a from near),
reach(node, label) as (select doc_id, doc_id from documents union select e.b, r.label from reach r join edge e on e.a = r.node)
select node as doc_id, min(label) as group_id, min(label) = node as kept from reach group by node
"""

OP2_SQL = f"""
with {_WORDS},
win as (select doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') as k
    from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from words where len(ws) >= 50)),
least as (select k, min(doc_id) as first from win group by k),
gone as (select distinct doc_id, p from (select w.doc_id, unnest(range(w.i, w.i + 50)) as p from win w join least l on l.k = w.k and l.first < w.doc_id)),
each as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from words),
kept as (select e.doc_id, string_agg(e.word, ' ' order by e.p) as t, count(*) as n from each e anti join gone g on g.doc_id = e.doc_id and g.p = e.p group by e.doc_id)
select w.doc_id, len(w.ws) as n_words, len(w.ws) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from words w left join kept k on k.doc_id = w.doc_id
"""

OP9_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as e from v
    where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_inner_product(e, e) > 0),
edge as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_inner_product(a.e, b.e) >= 0.95),
reach(node, label) as (select vec_id, vec_id from v union select e.b, r.label from reach r join edge e on e.a = r.node),
links as (select a, count(*) as n from edge group by a)
select node as vec_id, coalesce(min(l.n), 0) as n_links, min(label) as component_id, min(label) = node as kept
from reach left join links l on l.a = node group by node
"""

OP11_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
total as (select lang, sum(len(ws)) as n from w group by lang),
grams as (select lang, s, array_to_string(list_slice(ws, i, i + s - 1), ' ') as phrase
    from (select lang, ws, s, unnest(range(1, len(ws) - s + 2)) as i from w, (values (1), (2), (3)) as sizes(s))),
f as (select lang, s, phrase, count(*) as f from grams group by all having count(*) >= 10),
c as (select *, string_split(phrase, ' ') as ws from f where s > 1),
cuts as (select c.lang, c.phrase, c.f as a, k, x.f as l, y.f as r, (1000000::hugeint * c.f * c.f) // (x.f::hugeint * y.f) as score
    from (select *, unnest(range(1, s)) as k from c) c
    join f x on x.lang = c.lang and x.phrase = array_to_string(list_slice(c.ws, 1, k), ' ')
    join f y on y.lang = c.lang and y.phrase = array_to_string(list_slice(c.ws, k + 1, c.s), ' ')),
worst as (select lang, phrase, a, l, r, score from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
held as (select c.lang, array_to_string(list_slice(c.ws, i, i + 1), ' ') as phrase, max(c.f) as most from (select *, unnest([1, 2]) as i from c where s = 3) c group by all),
kept as (select w.* from worst w left join held h on h.lang = w.lang and h.phrase = w.phrase where h.most is null or 100 * h.most < 50 * w.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n::bigint as n, k.score::bigint as score from ranked k join total t on t.lang = k.lang where k.rank <= 2000
"""

QUERIES: dict[str, Query] = {
    "op1_neardup": op1_neardup,
    "op2_substrings": op2_substrings,
    "op3_packing": op3_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_quality": op5_quality,
    "op6_lines": op6_lines,
    "op7_secrets": op7_secrets,
    "op8_mixing": op8_mixing,
    "op9_embeddings": op9_embeddings,
    "op10_warc": op10_warc,
    "op11_phrases": op11_phrases,
    "op12_whitening": op12_whitening,
    "op13_toxicity": op13_toxicity,
}

ORACLES: dict[str, str] = {
    "op1_neardup": OP1_SQL,
    "op2_substrings": OP2_SQL,
    "op9_embeddings": OP9_SQL,
    "op10_warc": OP10_SQL,
    "op11_phrases": OP11_SQL,
}
