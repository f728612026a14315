"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkwalk.llm import bpe, chat, divergence, embeddings, html, iblt, lexical, packing, quality, simhash, suffix, urls, warc
from sparkwalk.llm.common import map_batches, once, table

URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(record: bytes) -> tuple:
        head, block = warc.parse(record)
        return *map(head.get, ("WARC-Target-URI", "WARC-Date", "WARC-Block-Digest")), len(block), hashlib.sha256(record).hexdigest()

    told = {"target_uri": "string", "warc_date": "string", "block_digest": "string", "n_bytes": "long", "record_sha256": "string"}
    return warc.build(warc.responses(table(spark, sf_dir, "pages")), tell=digests, told=told)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


OP3_SQL = """
with parsed as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parsed),
rules(action, rule_host, rule_path) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'),
         ('block', 'com', '/de/')),
fits as (
  select page_id, max_by(struct_pack(rule := rule_host || rule_path, action := action), length(rule_host || rule_path)) as best
  from split join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id)
select page_id, host, path, best.rule as rule, coalesce(best.action, 'allow') as verdict
from split left join fits using (page_id)
"""


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
with texts as (
  select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t from documents),
split as (
  select doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from texts),
windows as (
  select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as s from split, unnest(range(1, len(ws) - 1)) as u(i)),
twice as (select doc_id, s from windows group by doc_id, s having count(*) > 1),
repeated as (
  select doc_id, count(distinct i + k) as n from windows join twice using (doc_id, s), range(3) as r(k) group by doc_id),
f as (
  select doc_id, lang, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
         coalesce(n, 0) as n_repeat_words, len(list_filter(ws, lambda x: x = upper(x) and x <> lower(x))) as n_capitals,
         length(t) - length(replace(t, '!', '')) as n_exclamations, len(ls) as n_lines
  from split left join repeated using (doc_id)),
levels(level, symbols, capitals, exclamations, repeats, lines) as (
  values (0, 2.0, 0.95, 2.0, 0.9, 0.9), (1, 1.0, 0.9, 1.5, 0.8, 0.8), (2, 0.7, 0.8, 1.0, 0.75, 0.75), (3, 0.5, 0.7, 0.75, 0.7, 0.7),
         (4, 0.35, 0.6, 0.5, 0.65, 0.65), (5, 0.25, 0.5, 0.4, 0.6, 0.6), (6, 0.15, 0.4, 0.3, 0.55, 0.55), (7, 0.1, 0.3, 0.2, 0.5, 0.5)),
judged as (
  select doc_id, lang, level, n_symbols > symbols * greatest(n_words, 1) or n_capitals > capitals * greatest(n_words, 1)
         or n_exclamations > exclamations * greatest(n_words, 1) or n_repeat_words > repeats * greatest(n_words, 1)
         or n_dup_lines > lines * greatest(n_lines, 1) as rejected
  from f, levels),
good as (select doc_id from labels group by doc_id having min(quality) = 1),
counted as (
  select lang, level, count(*) as n, count(*) filter (where rejected) as k from judged join good using (doc_id) group by lang, level),
tails as (
  select lang, level, any_value(n) as n, any_value(k) as k,
         sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.03) + (n - j) * ln(0.97))) as tail
  from counted, unnest(range(0, k + 1)) as u(j) group by lang, level),
tested as (
  select lang, level, k < n * 0.03 and tail <= 0.05 / count(*) over (partition by level) as ok from tails),
certified as (
  select lang, max(level) as level from (select *, bool_and(ok) over (partition by lang order by level) as so_far from tested)
  where so_far group by lang)
select f.doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not coalesce(rejected, false) as kept
from f left join certified on certified.lang = f.lang
       left join judged on judged.doc_id = f.doc_id and judged.level = certified.level
"""


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix.remove(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = """
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
chunks as (
  select doc_id, c, least(1000, length(h) // 2 - 99 - 1000 * c) as n, substring(h, 2000 * c + 1, 2198) as h
  from bytes, unnest(range(0, (length(h) // 2 + 900) // 1000)) as u(c)),
windows as (
  select doc_id, 1000 * c + k as i, md5_number(substring(h, 2 * k + 1, 200)) as s from chunks, unnest(range(0, n)) as u(k)),
later as (
  select doc_id, i from (select *, row_number() over (partition by s order by doc_id, i) as nth from windows) where nth > 1),
starts as (
  select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 100, true)::int as fresh from later),
runs as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from starts),
spans as (select doc_id, min(i) as a, max(i) + 100 as b from runs group by doc_id, run),
around as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as after from spans),
cut as (
  select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last,
         string_agg(substring(h, 2 * after + 1, 2 * (a - after)), '' order by a) as kept
  from around join bytes using (doc_id) group by doc_id)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
       coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from bytes left join cut using (doc_id)
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(table(spark, sf_dir, "documents"), path, pattern)

    def digests(batch):
        vocabulary = bpe.load(path, pattern)[1]
        words = once("decimal", lambda: [str(i) for i in range(len(vocabulary))])
        out = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in batch.column("ids"):
            ids = ids.values.to_pylist()
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join(map(words.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(bpe.decode_ids([ids], vocabulary)[0]).hexdigest())
        return out

    return map_batches(coded, digests, {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})


def op8_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN,
    )
    return packing.pack(parts)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    done = chat.format_trees(chat.chains(rows), top=1)
    told = F.transform(chat.turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.learnt(F.col("formatted"), F.col("loss"))
    return done.select(
        F.nullif("tree", F.lit("")).cast("long").alias("conv_id"),
        F.size(told).cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = """
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
escaped as (
  select conv_id, turn, role, text, replace(role || chr(0) || text, '\\', '\\\\') as t from given),
marked as (
  select *, replace(replace(replace(replace(replace(replace(t, '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'),
    '[/INST]', '[\\/INST]'), '<<SYS>>', '<\\<SYS>>'), '<</SYS>>', '<\\</SYS>>') as e from escaped),
whole as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
         coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
         sum(length(e) - 1 + length('<s>[INST][/INST]</s>')) as formatted
  from marked group by conv_id)
select conv_id, n_turns::bigint as n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars,
       sha256(loss) as loss_sha256, formatted::bigint as formatted_chars
from whole
"""


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with words as (
  select 'd' as side, doc_id as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents
  union all
  select 'i', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))
  from benchmark),
lengths as (select id as doc_id, count(*) as n from words where side = 'd' group by id),
corpus as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from lengths),
wanted as (select distinct id as item_id, term from words where side = 'i'),
tf as (select id as doc_id, term, count(*)::bigint as tf from words where side = 'd' and term in (select term from wanted) group by all),
weights as (
  select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, corpus group by term, big_n),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))))::bigint as score
  from wanted join weights using (term) join tf using (term) join lengths using (doc_id), corpus group by all),
ranked as (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with docs as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
words as (select doc_id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
per_doc as (select doc_id, lang, source, term, count(*) as n from words group by all),
kept as (select lang, term, sum(n)::hugeint as qn from per_doc group by lang, term having count(*) >= 30),
langs as (
  select l.lang, count(term)::hugeint as v, coalesce(sum(qn), 0)::hugeint as total from (select distinct lang from docs) l left join kept k on k.lang = l.lang
  group by l.lang),
counts as (select lang, source, term, sum(n)::hugeint as n from per_doc join kept using (lang, term) group by all),
groups as (
  select g.lang, g.source, coalesce(sum(n), 0)::hugeint as total from (select distinct lang, source from docs) g
  left join counts c on c.lang = g.lang and c.source = g.source group by g.lang, g.source),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) as p,
         1 + (1000000000::hugeint * (k.qn + 5)) // (l.total + 5 * l.v) as q
  from groups g join langs l using (lang) join kept k using (lang)
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source
  left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
  where x.term is null or y.term is not null
  group by a.lang, a.source, b.source),
found as (
  select lang, source, 'pair' as part, item, value from pairs
  union all
  select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
with sound as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from sound a join sound b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) >= 0.98 else false end),
reach as (
  with recursive r(a, b) as (
    select vec_id, vec_id from embeddings
    union
    select r.a, links.b from r join links on links.a = r.b)
  select a as vec_id, min(b) as component_id from r group by a),
counted as (select a as vec_id, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from reach left join counted using (vec_id)
"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_urls": op3_urls,
    "op4_html": op4_html,
    "op5_quality": op5_quality,
    "op6_suffix": op6_suffix,
    "op7_bpe": op7_bpe,
    "op8_iblt": op8_iblt,
    "op9_packing": op9_packing,
    "op10_chat": op10_chat,
    "op11_lexical": op11_lexical,
    "op12_divergence": op12_divergence,
    "op13_embeddings": op13_embeddings,
}
ORACLE: dict[str, str] = {
    "op3_urls": OP3_SQL, "op5_quality": OP5_SQL, "op6_suffix": OP6_SQL, "op10_chat": OP10_SQL, "op11_lexical": OP11_SQL,
    "op12_divergence": OP12_SQL, "op13_embeddings": OP13_SQL,
}
