"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.functions import text as tx
from gridlore.plans.registry import query

_ACCENTS = f"translate(lower(translate(regexp_replace(text, '[\\x{{0300}}-\\x{{036F}}]', '', 'g'), 'İIı', 'iii')), '{tx.ACCENTED}', '{tx.PLAIN}')"


@query("o_str_fold", f"SELECT doc_id, md5(trim(regexp_replace({_ACCENTS}, '[^a-z0-9]+', ' ', 'g'))) AS folded FROM documents")
def str_fold(v):
    return v.table("documents").select("doc_id", F.md5(tx.fold_key(F.col("text"))).alias("folded"))


@query("o_str_ws", "SELECT doc_id, md5(trim(regexp_replace(text, '[\\t-\\r \\x{00A0}]+', ' ', 'g'))) AS collapsed FROM documents")
def str_ws(v):
    return v.table("documents").select("doc_id", F.md5(tx.collapse_space(F.col("text"))).alias("collapsed"))


@query("o_str_lowertr", "SELECT doc_id, md5(lower(translate(text, 'İI', 'iı'))) AS low FROM documents")
def str_lowertr(v):
    return v.table("documents").select("doc_id", F.md5(tx.lower_tr(F.col("text"))).alias("low"))


@query("o_str_uppertr", "SELECT p_partkey, upper(translate(p_name, 'iı', 'İI')) AS up FROM part")
def str_uppertr(v):
    return v.table("part").select("p_partkey", tx.upper_tr(F.col("p_name")).alias("up"))


@query("o_str_apos", "SELECT doc_id, md5(regexp_replace(text, '[''’´`][a-zçğıöşüA-ZÇĞİÖŞÜ]{1,6}\\b', '', 'g')) AS bare FROM documents")
def str_apos(v):
    return v.table("documents").select("doc_id", F.md5(tx.strip_apostrophe_suffix(F.col("text"))).alias("bare"))


@query("o_src_content", "SELECT doc_id, trim(lang) AS lang, trim(source) AS source, md5(text) AS body FROM documents")
def src_content(v):
    from gridlore.sources.web import front_matter

    page = F.concat(F.lit("---\nlang: "), "lang", F.lit("\nsource:  "), "source", F.lit("\n---\n"), "text")
    read = v.table("documents").select("doc_id", front_matter(page).alias("p"))
    return read.select("doc_id", F.col("p.fields")["lang"].alias("lang"), F.col("p.fields")["source"].alias("source"), F.md5("p.body").alias("body"))


@query("o_str_token", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[^0-9A-Za-zÇĞİıÖŞÜçğöşü]+'), lambda w: w <> '')) AS n FROM documents")
def str_token(v):
    return v.table("documents").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n"))


@query("o_str_proper", "SELECT doc_id, regexp_matches(text, '^[A-ZÇĞİÖŞÜ]') AS proper FROM documents")
def str_proper(v):
    return v.table("documents").select("doc_id", tx.proper(F.col("text")).alias("proper"))


@query("o_str_sim", "SELECT a.p_partkey, round(CASE WHEN a.p_name = b.p_name THEN 1.0 ELSE 1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) END, 6) AS score FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def str_sim(v):
    part = v.table("part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    return part.join(after, "p_partkey").select("p_partkey", F.round(tx.similarity(F.col("p_name"), F.col("next")), 6).alias("score"))


@query("o_str_fill", "SELECT n_nationkey, n_name || ' (' || n_regionkey || ') {other}' AS line FROM nation")
def str_fill(v):
    return v.table("nation").select("n_nationkey", tx.fill(F.lit("{name} ({region}) {other}"), name=F.col("n_name"), region=F.col("n_regionkey")).alias("line"))


@query("o_str_siteurl", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^(https?://[^/]+)', 1) ELSE 'https://' || regexp_extract(url, '^https?://([^/]+)', 1) END AS site FROM pages")
def str_siteurl(v):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    given = F.when(F.col("page_id") % 2 == 0, F.regexp_extract("url", "^(https?://[^/]+)", 1)).otherwise(host)
    return v.table("pages").select("page_id", tx.site_url(given, "https://site.example").alias("site"))
