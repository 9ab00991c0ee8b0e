"""The queries of this subpackage over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, fingerprints, licenses, near_dedup, packing, pii, resampling, simhash, substrings, toxicity, trie, url_filters
from .common import table

#: The dated list of op6: kind, key, date, action, category. Two entries return after a break, one site is allowed below a blocked domain.
LISTED = [
    ("domain", "spam-farm.example.org", "2024-02-01", "block", "spam"), ("domain", "spam-farm.example.org", "2024-06-01", "delist", "spam"),
    ("domain", "spam-farm.example.org", "2024-09-15", "block", "spam"), ("domain", "cheap-pills.example.net", "2023-11-20", "block", "pharmacy"),
    ("domain", "cheap-pills.example.com", "2024-03-10", "block", "pharmacy"), ("domain", "casino-win.example.net", "2024-01-15", "block", "gambling"),
    ("host", "blog.casino-win.example.net", "2024-07-01", "allow", "reviewed"), ("domain", "free-bets.example.net", "2024-04-01", "block", "gambling"),
    ("domain", "adult-x.example.com", "2023-01-01", "block", "adult"), ("domain", "ads-track.example.com", "2023-01-01", "block", "tracking"),
    ("host", "m.ads-track.example.com", "2024-05-05", "delist", "tracking"), ("prefix", "tionsh.example.net/en", "2024-08-01", "block", "mirror"),
    ("prefix", "tionsh.example.com/en", "2024-08-01", "block", "mirror"), ("prefix", "tionsh.example.com/en", "2024-10-01", "delist", "mirror"),
    ("domain", "tionble.example.org", "2024-10-01", "block", "scraped"), ("prefix", "tionble.example.org/de", "2024-11-01", "allow", "reviewed"),
    ("domain", "tionsh.example.net", "2024-01-10", "block", "mirror"), ("prefix", "blog.tionsh.example.net/fr", "2024-01-20", "allow", "reviewed"),
    ("prefix", "blog.tionsh.example.net/de", "2024-03-01", "allow", "reviewed"), ("prefix", "blog.tionsh.example.net/de", "2024-07-01", "block", "mirror"),
    ("host", "blog.ththan.example.net", "2024-02-15", "block", "copied"), ("host", "blog.ththan.example.net", "2024-08-15", "delist", "copied"),
    ("prefix", "thther.example.org/en", "2024-01-05", "block", "generated"), ("host", "blog.tiontion.example.com", "2024-01-01", "allow", "reviewed"),
    ("domain", "tiontion.example.com", "2023-06-01", "block", "generated"), ("host", "m.ththth.example.net", "2024-01-01", "block", "copied"),
    ("host", "m.ththth.example.net", "2024-01-01", "allow", "reviewed"),
]
LISTED_SCHEMA = "kind string, key string, effective string, action string, category string"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_near_duplicates(table(spark, sf_dir, "documents"), percent=85, slots=256, band=8)


SQL_OP1 = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
sh as (select distinct doc_id, array_to_string(words[i : i + 4], ' ') as s from w, unnest(generate_series(1, greatest(len(words) - 4, 1))) as g(i) where len(words) > 0),
n as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, to_id) as (select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join both_ways l on r.to_id = l.a),
comp as (select doc_id, min(to_id) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, comp.component_id, d.doc_id = comp.component_id as kept from documents d left join n using (doc_id) join comp using (doc_id)
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), keep_ids=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_components(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; pages have no fetch date, so page_id names a day of 2024."""
    entries = spark.createDataFrame(LISTED, LISTED_SCHEMA).withColumn("effective", F.to_date("effective"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched_on"))
    out = url_filters.filter_urls(pages, entries)
    return out.select("page_id", "host", out["fetched_on"].cast("string").alias("fetched_on"), "blocked", "entry", "entry_kind", "category", F.col("listed_from").cast("string").alias("listed_from"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


SQL_OP6 = f"""
with entries(kind, key, effective, action, category) as (values {_values(LISTED)}),
spans as (select kind, key, action, category, effective as valid_from, lead(effective) over (partition by kind, key order by effective, action, category) as valid_to from entries),
active as (select * from spans where action <> 'delist' and (valid_to is null or valid_to > valid_from)),
p as (select page_id, url, strftime(date '2024-01-01' + cast(page_id % 366 as integer), '%Y-%m-%d') as fetched_on,
  regexp_replace(lower(regexp_extract(url, '{url_filters.HOST}', 1)), '^www\\.', '') as host,
  '/' || array_to_string(list_filter(string_split(regexp_extract(url, '{url_filters.PATH}', 1), '/'), lambda x: x <> ''), '/') as path from pages),
met as (select p.page_id, a.*, case kind when 'prefix' then 2 when 'host' then 1 else 0 end as rank from p join active a on p.host <> '' and p.fetched_on >= a.valid_from and (a.valid_to is null or p.fetched_on < a.valid_to)
  and case a.kind when 'host' then p.host = a.key when 'domain' then p.host = a.key or ends_with(p.host, '.' || a.key) else p.path <> '/' and starts_with(p.host || p.path || '/', a.key || '/') end),
best as (select * from (select *, row_number() over (partition by page_id order by rank desc, length(key) desc, action desc) as nth from met) where nth = 1)
select p.page_id, p.host, p.fetched_on, coalesce(best.action = 'block', false) as blocked, best.key as entry, best.kind as entry_kind, best.category, best.valid_from as listed_from
from p left join best on p.page_id = best.page_id
"""


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and for each document whose id is divisible by 20 a licence file of its source (id -1 - doc_id): a known text with a
    copyright line of that source, in capitals or as written, so that whole texts meet the list too."""
    docs = table(spark, sf_dir, "documents")
    texts = F.array(*[F.lit(t) for _, t in licenses.KNOWN])
    body = F.element_at(texts, (F.pmod(F.floor(F.col("doc_id") / 20), F.lit(len(licenses.KNOWN))) + 1).cast("int"))
    filed = F.concat(F.lit("Copyright (c) 2024 "), F.coalesce("source", F.lit("")), F.lit("\n\n"), F.when(F.pmod("doc_id", F.lit(40)) == 0, F.upper(body)).otherwise(body))
    both = docs.select("doc_id", "text").unionByName(docs.where("doc_id % 20 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), filed.alias("text")))
    out = licenses.scan_licenses(both, licenses.known_digests(spark))
    return out.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"), "n_notice_lines")


def _canonical_sql(text: str) -> str:
    copyright, marks = licenses.COPYRIGHT_LINE, licenses.MARKS
    out = f"' ' || trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{copyright}', '', 'g'), '{marks}', ' ', 'g')) || ' '"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, ' {old}', ' {new}')"
    return f"trim({out})"


SQL_OP8 = f"""
with texts(license, text) as (values {_values(licenses.KNOWN)}),
known as (select sha256({_canonical_sql("text")}) as digest, min(license) as license from texts group by 1),
body as (select doc_id, source, (select list(text order by nth) from (select row_number() over () as nth, text from texts))[(doc_id // 20) % {len(licenses.KNOWN)} + 1] as t from documents where doc_id % 20 = 0),
files as (select doc_id, text from documents union all select -1 - doc_id, 'Copyright (c) 2024 ' || coalesce(source, '') || chr(10) || chr(10) || case when doc_id % 40 = 0 then upper(t) else t end from body),
marked as (select doc_id, sha256({_canonical_sql("text")}) as digest from files),
lines as (select distinct doc_id, x.line from files, unnest(string_split(text, chr(10))) as x(line)),
met as (select doc_id, string_agg(distinct license, ',' order by license) as notices, count(*) as n from (select doc_id, {_canonical_sql("line")} as plain from lines) join known on plain <> '' and sha256(plain) = digest group by doc_id)
select m.doc_id, m.digest, k.license, coalesce(met.notices, '') as notices, coalesce(met.n, 0) as n_notice_lines
from marked m left join known k using (digest) left join met on m.doc_id = met.doc_id
"""


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with what a logger leaves: of every third (by id) a snapshot without its last turn number (id -1 - conv_id; none of
    one turn), and of every sixth a second log of the whole (id a thousand million higher)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    third = turns.where("conv_id % 3 = 0")
    last = third.groupBy("conv_id").agg(F.max("turn").alias("last"))
    cut = third.join(last, "conv_id").where("turn < last").select((-1 - F.col("conv_id")).alias("conv_id"), "turn", "role", "text")
    again = turns.where("conv_id % 6 = 0").withColumn("conv_id", F.col("conv_id") + 1_000_000_000)
    return chat.format_chats(turns.unionByName(cut).unionByName(again))


SQL_OP9 = """
with logged as (select conv_id, turn, role, text from conversations
  union all select -1 - conv_id, turn, role, text from (select *, max(turn) over (partition by conv_id) as last from conversations where conv_id % 3 = 0) where turn < last
  union all select conv_id + 1000000000, turn, role, text from conversations where conv_id % 6 = 0),
t as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos from logged where conv_id is not null),
one as (select conv_id, pos, coalesce('r' || length(role) || ':' || role, 'n') || coalesce('t' || length(text) || ':' || text, 'n') as s,
  '<|im_start|>' || coalesce(role, 'user') || chr(10) || replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10) as r from t),
p as (select conv_id, pos, count(*) over (partition by conv_id) as n, md5(string_agg(s, '' order by pos) over (partition by conv_id order by pos)) as h from one),
whole as (select h, pos, min(conv_id) as conv_id, count(*) as n_snapshots from p where pos = n group by h, pos),
kept as (select * from whole w where not exists (select 1 from p where p.pos < p.n and p.pos = w.pos and p.h = w.h))
select k.conv_id, max(k.pos) as n_turns, max(k.n_snapshots) as n_snapshots, string_agg(one.r, '' order by one.pos) as rendered from kept k join one on k.conv_id = one.conv_id group by k.conv_id
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


SQL_OP10 = r"""
with w as (select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
win as (select doc_id, r, i, array_to_string(words[i : i + 12], ' ') as x from w, unnest(generate_series(1, len(words) - 12)) as g(i)),
least as (select x, min(doc_id) as first from win group by x),
gone as (select distinct r, i + j as at from win join least using (x), unnest(generate_series(0, 12)) as h(j) where first < doc_id),
word as (select doc_id, r, i, words[i] as word from w, unnest(generate_series(1, len(words))) as g(i)),
kept as (select r, string_agg(word, ' ' order by i) as kept, count(*) as n from word where not exists (select 1 from gone where gone.r = word.r and gone.at = word.i) group by r)
select w.doc_id, len(words) as n_words, len(words) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.kept, '')) as kept_sha256 from w left join kept on w.r = kept.r
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.spliced(trie.sequences(table(spark, sf_dir, "conversations"))))


#: The bytewise table of CRC-32 as a list in a row, and the checksum of a text by it.
CRC_TABLE = "select list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) order by b) as t from (select unnest(range(256)) as b)"


def _crc_sql(text: str, table: str) -> str:
    byte = f"list_transform(range(octet_length(encode({text}))), lambda i: cast('0x' || substr(hex(encode({text})), 2 * i + 1, 2) as bigint))"
    return f"xor(list_reduce(list_concat([4294967295], {byte}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


SQL_OP11 = f"""
with tab as materialized ({CRC_TABLE}),
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) as pos, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as base, {_crc_sql("cast(conv_id as varchar)", "tab.t")} % 9 as h from (select distinct conv_id from t), tab),
made as (select c.conv_id, t.pos, t.role, t.text from c join t on t.conv_id = c.base and t.pos <= h union all select c.conv_id, t.pos, t.role, t.text from c join t on t.conv_id = c.conv_id and t.pos > h),
p as (select conv_id, row_number() over w as d, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over w) as k, octet_length(encode(text)) as b from made window w as (partition by conv_id order by pos)),
path as (select conv_id, 0 as d, '' as k, 0 as b from c union all select * from p),
len as (select conv_id, max(d) as n from path group by conv_id),
node as (select d, k, min(path.conv_id) as conv_id, count(*) as n_convs, max(b) as b, string_agg(case when d = n then path.conv_id end, ',' order by path.conv_id) as ends from path join len using (conv_id) group by d, k),
up as (select node.*, parent.conv_id as parent_conv_id from node left join path q on q.conv_id = node.conv_id and q.d = node.d - 1 left join node parent on parent.d = q.d and parent.k = q.k),
kids as (select parent_conv_id as conv_id, d - 1 as d, count(*) as n from up where d > 0 group by 1, 2),
under as (select q.d, q.k, sum((u.n_convs - 1) * u.b) as saved, count(*) filter (where kids.n is null) as leaves from up u left join kids using (conv_id, d) join path q on q.conv_id = u.conv_id and q.d <= u.d group by q.d, q.k)
select up.conv_id, up.d as depth, up.parent_conv_id, up.n_convs, coalesce(kids.n, 0) as n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from up left join kids on kids.conv_id = up.conv_id and kids.d = up.d join under on under.d = up.d and under.k = up.k
"""


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _words_sql(source: str) -> str:
    return f"regexp_extract_all(translate(coalesce({source}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


SQL_OP12 = f"""
with tab as materialized ({CRC_TABLE}),
docs as (select row_number() over () as r, doc_id, {_words_sql("text")} as words from documents),
word as (select r, x.w, count(*) as n from docs, unnest(words) as x(w) group by 1, 2),
aim as (select x.w, count(*) as n from (select {_words_sql("text")} as words from benchmark), unnest(words) as x(w) group by 1),
code as (select w, {_crc_sql("w", "tab.t")} % 10000 as bucket from (select w from word union select w from aim), tab),
s as (select bucket, sum(n) as s from word join code using (w) group by 1), t as (select bucket, sum(n) as t from aim join code using (w) group by 1),
total as (select cast((select coalesce(sum(s), 0) from s) as double) as a, cast((select coalesce(sum(t), 0) from t) as double) as b),
gain as (select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1.0::double) * (a + 10000) / ((s + 1.0::double) * (b + 10000)))) as bigint) as g from s left join t using (bucket), total),
mean as (select r, sum(n) as n, cast(sum(g * n) as bigint) as g from word join code using (w) join gain using (bucket) group by r),
scored as (select r, doc_id, len(words) as n_words, coalesce(n, 0) as n_features, coalesce((g - ((g % n) + n) % n) // n, 0) as weight,
  cast(('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8)) as bigint) as h from docs left join mean using (r)),
final as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from scored),
placed as (select r, row_number() over (order by score desc, doc_id nulls last) as nth from final where n_words >= 20)
select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score, case when nth <= (select 10 * count(*) // 100 from placed) then nth end as rank from final left join placed using (r)
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.find_near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_pii, op3_packing, op4_toxicity, op5_fingerprints, op6_url_filters, op7_decontamination, op8_license_scans, op9_chat_formatting, op10_substring_dedup, op11_prefix_trie, op12_resampling, op13_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": SQL_OP1, "op6_url_filters": SQL_OP6, "op8_license_scans": SQL_OP8, "op9_chat_formatting": SQL_OP9, "op10_substring_dedup": SQL_OP10, "op11_prefix_trie": SQL_OP11, "op12_resampling": SQL_OP12}
