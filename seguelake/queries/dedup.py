"""Queries on unions, set algebra and duplicates."""

from pyspark.sql import functions as F

from seguelake.bindings import MIXES, SLOTS, TRACKS
from seguelake.functions import text
from seguelake.operators import dedup as op
from seguelake.queries import query

c = F.col


@query(
    "union_sources",
    """SELECT source, count(*) AS n, count(body) AS with_text, count(url) AS with_url FROM (SELECT 'documents' AS source, doc_id AS id, text AS body, NULL AS url FROM documents
 UNION ALL SELECT 'benchmark', item_id, text, NULL FROM benchmark UNION ALL SELECT 'pages', page_id, NULL, url FROM pages UNION ALL SELECT 'conversations', conv_id, text, NULL FROM conversations) GROUP BY source""",
)
def _(t):
    sources = {
        "documents": t.documents.select(c("doc_id").alias("id"), c("text").alias("body")),
        "benchmark": t.raw("benchmark").select(c("item_id").alias("id"), c("text").alias("body")),
        "pages": t.raw("pages").select(c("page_id").alias("id"), "url"),
        "conversations": t.raw("conversations").select(c("conv_id").alias("id"), c("text").alias("body")),
    }
    d = op.union_sources(sources)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("body").alias("with_text"), F.count("url").alias("with_url"))


DOCHASH = "CASE WHEN doc_id % 10 <> 0 THEN sha256(text) END"


@query(
    "dedupe_by_content",
    f"""WITH h AS (SELECT doc_id, {DOCHASH} AS h FROM documents), k AS (SELECT h, min(doc_id) AS kept FROM h WHERE h IS NOT NULL GROUP BY h)
 SELECT doc_id AS removed, kept FROM h JOIN k USING (h) WHERE doc_id <> kept""",
)
def _(t):
    content = F.when(c("doc_id") % 10 != 0, F.sha2("text", 256))
    return op.dedupe_by_content(t.documents.select("doc_id", "text"), content, "doc_id")[1]


@query(
    "dedupe_kept",
    f"""WITH h AS (SELECT doc_id, lang, {DOCHASH} AS h FROM documents) SELECT doc_id, lang FROM h WHERE h IS NULL OR doc_id IN (SELECT min(doc_id) FROM h WHERE h IS NOT NULL GROUP BY h)""",
)
def _(t):
    content = F.when(c("doc_id") % 10 != 0, F.sha2("text", 256))
    return op.dedupe_by_content(t.documents, content, "doc_id")[0].select("doc_id", "lang")


@query(
    "merge_duplicates_ranked",
    """WITH k AS (SELECT *, p_name || '|' || p_type AS key FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p_size DESC, p_partkey) AS rn,
 min(p_partkey) OVER (PARTITION BY key) AS place, count(*) OVER (PARTITION BY key) AS copies FROM k) SELECT p_partkey AS track, place, copies FROM r WHERE rn = 1""",
)
def _(t):
    d = t.raw("part").select(c("p_partkey").alias("track"), "p_name", "p_type", "p_size")
    return op.merge_ranked(d, F.concat_ws("|", "p_name", "p_type"), [c("p_size")], "track").select("track", "place", "copies")


@query(
    "set_algebra",
    """WITH a AS (SELECT DISTINCT l_partkey AS x FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40), b AS (SELECT DISTINCT l_partkey AS x FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10)
 SELECT 'minus' AS op, x FROM (SELECT x FROM a EXCEPT SELECT x FROM b) UNION ALL SELECT 'both', x FROM (SELECT x FROM a INTERSECT SELECT x FROM b)""",
)
def _(t):
    a = t.plays.filter((c("flag") == "A") & (c("qty") > 40)).select(c("track").alias("x"))
    b = t.plays.filter((c("flag") == "R") & (c("qty") < 10)).select(c("track").alias("x"))
    minus, both = a.subtract(b), a.intersect(b)
    return minus.select(F.lit("minus").alias("op"), "x").unionByName(both.select(F.lit("both").alias("op"), "x"))


@query(
    "credit_dedup",
    "SELECT l_orderkey AS mix, l_partkey AS track, count(*) AS copies, count(DISTINCT (l_returnflag, l_linestatus)) > 1 AS conflict FROM lineitem GROUP BY 1, 2",
)
def _(t):
    return op.credit_dedup(t.plays, ["mix", "track"], ["flag", "status"]).select("mix", "track", "copies", "conflict")


@query(
    "twin_sequences",
    f"""WITH {SLOTS}, s AS (SELECT mix, string_agg(position || ':' || (track % 5), ',' ORDER BY position) AS seq FROM slots GROUP BY mix)
 SELECT mix, min(mix) OVER (PARTITION BY seq) AS keeper, mix = min(mix) OVER (PARTITION BY seq) AS kept FROM s""",
)
def _(t):
    d = t.slots().withColumn("item", c("track") % 5)
    return op.twin_sequences(d, "mix", "position", "item")
