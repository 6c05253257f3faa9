"""Queries on text keys, titles and durations."""

from pyspark.sql import functions as F

from seguelake.functions import text, titles
from seguelake.queries import query

c = F.col
KEY = "trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))"
VW = ", ".join(f"'{w}'" for w in text.VERSION_WORDS)


@query(
    "text_keys",
    f"""SELECT doc_id, sha256({KEY}) AS words, sha256(replace({KEY}, ' ', '')) AS compact, len(list_distinct(list_filter(string_split({KEY}, ' '), lambda w: length(w) > 2))) AS n_tokens,
 sha256(array_to_string(list_filter(string_split({KEY}, ' '), lambda w: w NOT IN ({VW})), ' ')) AS bare FROM documents""",
)
def _(t):
    d = t.documents.select("doc_id", text.words_key(c("text")).alias("w"))
    return d.select(
        "doc_id",
        F.sha2("w", 256).alias("words"),
        F.sha2(F.replace("w", F.lit(" ")), 256).alias("compact"),
        F.size(text.tokens_of(c("w"), 2)).cast("long").alias("n_tokens"),
        F.sha2(text.without_version(c("w")), 256).alias("bare"),
    )


REGIONS = (("india", ("mumbai",)), ("australia", ("melbourne",)))
TITLED = """t AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' - Cust ' || o_custkey || ' @ Club ' || o_orderstatus WHEN 1 THEN strftime(o_orderdate, '%Y-%m') || ' - Cust ' || o_custkey || ' b2b Guest - Series ' || (o_orderkey % 40)
 WHEN 2 THEN strftime(o_orderdate, '%Y') || ' - Cust ' || o_custkey || ' & Guest @ Hall' WHEN 3 THEN '2001-13-45 - Cust ' || o_custkey || ' - X' WHEN 4 THEN 'Cust ' || o_custkey || ' live at Hall' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' - Someone Else @ Melbourne' END AS title,
 CASE WHEN o_orderkey % 5 <> 0 THEN 'cust' || o_custkey END AS tag FROM orders)"""


def titled(t):
    o = t.raw("orders")
    k, who = c("o_orderkey") % 6, F.concat(F.lit("Cust "), c("o_custkey"))
    d = lambda f: F.date_format("o_orderdate", f)
    title = (
        F.when(k == 0, F.concat(d("yyyy-MM-dd"), F.lit(" - "), who, F.lit(" @ Club "), "o_orderstatus"))
        .when(k == 1, F.concat(d("yyyy-MM"), F.lit(" - "), who, F.lit(" b2b Guest - Series "), c("o_orderkey") % 40))
        .when(k == 2, F.concat(d("yyyy"), F.lit(" - "), who, F.lit(" & Guest @ Hall")))
        .when(k == 3, F.concat(F.lit("2001-13-45 - "), who, F.lit(" - X")))
        .when(k == 4, F.concat(who, F.lit(" live at Hall")))
        .otherwise(F.concat(d("yyyy-MM-dd"), F.lit(" - Someone Else @ Melbourne")))
    )
    tag = F.when(c("o_orderkey") % 5 != 0, F.concat(F.lit("cust"), c("o_custkey")))
    return o.select(c("o_orderkey").alias("id"), title.alias("title"), tag.alias("tag"), "o_orderkey", "o_orderdate")


@query(
    "title_parsers",
    f"""WITH {TITLED} SELECT id, CASE id % 6 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 3 THEN 'invalid' WHEN 4 THEN 'missing' ELSE 'day' END AS precision,
 CASE id % 6 WHEN 4 THEN 'missing_actor' WHEN 1 THEN 'b2b' WHEN 2 THEN 'multi_actor' WHEN 5 THEN CASE WHEN tag IS NULL THEN 'missing_first_tag' ELSE 'tag_not_in_actor' END ELSE CASE WHEN tag IS NULL THEN 'missing_first_tag' ELSE 'solo_like' END END AS kind,
 CASE id % 6 WHEN 5 THEN 'australia' ELSE 'unknown' END AS region, CASE id % 6 WHEN 1 THEN 'b2b' ELSE 'single_billing' END AS billing, CASE WHEN id % 6 IN (0, 5) THEN substr(title, 14, strpos(title, ' @') - 14) WHEN id % 6 = 4 THEN substr(title, 1, strpos(title, ' live') - 1) ELSE '' END AS performer FROM t""",
)
def _(t):
    who = titles.actor(c("title"))
    return titled(t).select(
        "id",
        titles.date_precision(titles.date_prefix(c("title"))).alias("precision"),
        titles.actor_kind(who, c("tag")).alias("kind"),
        titles.labelled(c("title"), REGIONS, "unknown").alias("region"),
        titles.billing(c("title"), F.lit(1)).alias("billing"),
        F.when((c("id") % 6).isin(0, 4, 5), titles.performer(c("title"), ("live at",))).otherwise("").alias("performer"),
    )


@query(
    "written_dates",
    "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_orderkey % 40 AS INTEGER) AS volume, 'artist ' || o_custkey AS artist FROM orders",
)
def _(t):
    o = t.raw("orders")
    d = o.select(
        c("o_orderkey").alias("id"),
        F.concat(F.lit("Recorded "), F.date_format("o_orderdate", "MMM d, yyyy"), F.lit(" Vol. "), c("o_orderkey") % 40).alias("title"),
        F.concat(F.lit("[12] Artist "), c("o_custkey"), F.lit(" - Song")).alias("raw"),
    )
    return d.select("id", titles.written_date(c("title")).alias("day"), titles.volume(c("title")).alias("volume"), titles.artist_title(c("raw"))["artist"].alias("artist"))


# The given texts name no slots or formats, so frequent words of theirs stand for them.
SLOTS_BY = (("opening", ("that", "que")), ("closing", ("with", "pour")), ("peak", ("are", "dans", "und")))
FORMATS_BY = (("b2b", ("of the", "de la")), ("vinyl", ("in the", "de les")))
KINDS_BY = (("radio", ("this",)), ("studio", ("and the", "la de")))


def label_sql(rules, default):
    cases = " ".join(f"WHEN {' OR '.join(f"contains(k, ' {w} ')" for w in phrases)} THEN '{label}'" for label, phrases in rules)
    return f"CASE {cases} ELSE {default} END"


@query(
    "set_text_attributes",
    f"""WITH s AS (SELECT doc_id, n_chars AS n, ' ' || {KEY} || ' ' AS k, string_split({KEY.replace("(text)", "(regexp_extract(text, '^[^@|]*'))")}, ' ') AS ws FROM documents)
 SELECT doc_id, {label_sql(FORMATS_BY, "CASE WHEN list_position(ws, 'on') > 1 THEN 'live' WHEN contains(k, ' on ') THEN '' ELSE 'dj-set' END")} AS format, {label_sql(SLOTS_BY, "NULL")} AS slot, {label_sql(KINDS_BY, "'podcast'")} AS kind,
 CASE doc_id % 3 WHEN 0 THEN lpad(CAST(n % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') || '-' || lpad(CAST(n // 24 % 24 AS VARCHAR), 2, '0') || ':05'
 WHEN 1 THEN lpad(CAST((n % 12 + 1) % 12 AS VARCHAR), 2, '0') || ':00-' || lpad(CAST((n // 12 % 12 + 1) % 12 + 12 AS VARCHAR), 2, '0') || ':00' ELSE '' END AS hours FROM s""",
)
def _(t):
    k, n = c("doc_id") % 3, c("n_chars")
    clocks = F.when(k == 0, F.format_string("%d:%02d-%d.05", n % 24, n % 60, F.floor(n / 24) % 24)).when(k == 1, F.format_string("%dam to %d pm", n % 12 + 1, F.floor(n / 12) % 12 + 1)).otherwise("12-14")
    d = t.documents.select("doc_id", "text", F.concat_ws(" @ ", "text", clocks).alias("title"), clocks.alias("clocks"))
    return d.select(
        "doc_id",
        titles.set_format(c("title"), F.lit(""), FORMATS_BY, live="on").alias("format"),
        titles.labelled(c("text"), SLOTS_BY).alias("slot"),
        titles.labelled(c("text"), KINDS_BY, "podcast").alias("kind"),
        titles.time_range(c("clocks")).alias("hours"),
    )


@query(
    "duration_parsers",
    "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(n_chars AS INTEGER) END AS iso, CAST(n_chars % 6000 AS INTEGER) AS clock, (n_chars // 3600) || ':' || lpad(CAST(n_chars % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') AS written FROM documents",
)
def _(t):
    n = c("n_chars")
    iso = F.when(c("doc_id") % 9 == 0, "PT").otherwise(F.format_string("PT%dH%dM%dS", F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60))
    clock = F.format_string("%d:%02d", F.floor(n % 6000 / 60), n % 6000 % 60)
    d = t.documents.select("doc_id", "n_chars", iso.alias("iso"), clock.alias("clock"))
    return d.select("doc_id", text.seconds_of_iso(c("iso")).alias("iso"), text.seconds_of_clock(c("clock")).alias("clock"), text.clock_of_seconds(c("n_chars")).alias("written"))
