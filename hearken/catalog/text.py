"""Queries over text, addresses, ids and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, images, text
from ..functions.terms import UI_NOISE_TERMS
from ..views import table, with_views
from ..views import candidates as candidates_view

SECRET = "test-secret"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def norm(x: str) -> str:
    """The comparison key in SQL (no compatibility characters occur in the tables)."""
    x = f"regexp_replace(lower(strip_accents({x})), 'https?://\\S+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {norm('text')} AS normalized, lower({collapse('text')}) AS light, translate(text, '{text._vietnamese()[0]}', '{text._vietnamese()[1]}') AS folded, strip_accents(text) AS plain FROM documents")
def tx_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", text.normalize_text("text").alias("normalized"), text.normalize_light("text").alias("light"), text.fold_vietnamese("text").alias("folded"), text.strip_diacritics("text").alias("plain"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def tx_full_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """The vectorized helper for all of Unicode."""
    return table(spark, d, "documents").select("doc_id", text.strip_diacritics_full("text").alias("plain"))


NOISE = ("the", "of the", *UI_NOISE_TERMS)


@query(f"""
    WITH l AS (SELECT doc_id, text, unnest(regexp_split_to_array(text, '[\\r\\n]+')) AS raw, generate_subscripts(regexp_split_to_array(text, '[\\r\\n]+'), 1) AS i FROM documents),
    k AS (SELECT doc_id, i, trim(regexp_replace(raw, '\\s+', ' ', 'g'), ' -') AS line FROM l),
    n AS (SELECT doc_id, i, line, {norm('line')} AS key FROM k),
    f AS (SELECT *, key IN ({", ".join(f"'{x}'" for x in NOISE)}) AS noisy, length(key) >= 3 AS long,
                 row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS rn FROM n WHERE key <> ''),
    g AS (SELECT doc_id, {collapse("string_agg(line, ' ' ORDER BY i) FILTER (NOT noisy AND long AND rn = 1)")} AS cleaned,
                 min(i) FILTER (NOT noisy AND long AND rn > 1) AS dup, min(i) FILTER (noisy) AS noise FROM f GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN coalesce(cleaned, '') <> '' THEN cleaned ELSE trim(text) END AS cleaned,
           array_to_string(list_concat(list_filter(CASE WHEN dup < noise THEN ['duplicate_line_removed', 'ui_noise_removed'] WHEN noise < dup THEN ['ui_noise_removed', 'duplicate_line_removed']
               WHEN dup IS NOT NULL THEN ['duplicate_line_removed'] WHEN noise IS NOT NULL THEN ['ui_noise_removed'] ELSE [] END, lambda x: x IS NOT NULL),
               CASE WHEN length(coalesce(cleaned, '')) < 24 THEN ['too_short'] ELSE [] END), ',') AS flags
    FROM documents d LEFT JOIN g USING (doc_id)""")
def tx_clean_payload(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", text.clean_payload("text", NOISE).alias("c"))
    return c.select("doc_id", "c.cleaned", F.array_join("c.quality_flags", ",").alias("flags"))


@query(f"""
    WITH w AS (SELECT doc_id, list_filter(string_split({collapse('text')}, ' '), lambda x: x <> '') AS ws FROM documents),
    u AS (SELECT doc_id, unnest(ws) AS v, generate_subscripts(ws, 1) AS i FROM w),
    k AS (SELECT doc_id, v, i, {norm('v')} AS key, lower(v) AS low FROM u)
    SELECT doc_id,
        (SELECT string_agg(v, ' ' ORDER BY i) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) AS rn FROM k k2 WHERE k2.doc_id = w.doc_id AND key <> '') WHERE rn = 1) AS by_key,
        (SELECT string_agg(v, ' ' ORDER BY i) FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY i) AS rn FROM k k2 WHERE k2.doc_id = w.doc_id) WHERE rn = 1) AS by_case,
        (SELECT string_agg(v, ' ' ORDER BY i) FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY i) AS rn FROM k k2 WHERE k2.doc_id = w.doc_id) WHERE rn = 1) AS exact
    FROM w""".replace("(SELECT string_agg(v, ' ' ORDER BY i) FROM (SELECT *", "(SELECT string_agg(v, ' ' ORDER BY i) FROM (SELECT v, i"))
def tx_dedupe_words(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of each text in order, by three notions of equality; null where there are none, or no id."""
    ws = F.filter(F.split(text.collapse("text"), " "), lambda x: x != "")
    # within the row, nothing is shuffled; a word's first place has its first spelling too, so exact repeats go before keys are made
    w = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.array_distinct(ws)).alias("ws"))
    joined = lambda x: F.nullif(F.array_join(x, " "), F.lit(""))
    by_key, by_case = (text.first_by_keys("ws", keys("ws")) for keys in (text.normalize_words, text.lower_words))
    return w.select("doc_id", joined(by_key).alias("by_key"), joined(by_case).alias("by_case"), joined("ws").alias("exact"))


@query(f"""WITH k AS (SELECT doc_id, unnest(ws) AS v, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, list_filter(string_split({collapse('text')}, ' '), lambda x: x <> '') AS ws FROM documents)),
    c AS (SELECT doc_id, count(*) AS n_ci, md5(string_agg(v, ' ' ORDER BY i)) AS ci FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(v) ORDER BY i) AS rn FROM k) WHERE rn = 1 GROUP BY 1),
    e AS (SELECT doc_id, count(*) AS n_exact, md5(string_agg(v, ' ' ORDER BY i)) AS exact FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, v ORDER BY i) AS rn FROM k) WHERE rn = 1 GROUP BY 1)
    SELECT doc_id, coalesce(n_ci, 0) AS n_ci, coalesce(ci, md5('')) AS ci, coalesce(n_exact, 0) AS n_exact, coalesce(exact, md5('')) AS exact FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)""")
def tx_dedupe_lists(spark: SparkSession, d: str) -> DataFrame:
    """The words of each text as a list, without repeats by lower case and without exact ones, as digests."""
    w = table(spark, d, "documents").select("doc_id", F.split(text.collapse("text"), " ").alias("ws"))
    digest = lambda c: F.md5(F.array_join(c, " "))
    w = w.withColumns({"_ci": text.dedupe_ci("ws"), "_exact": text.dedupe_exact("ws")})
    return w.select("doc_id", F.size("_ci").cast("long").alias("n_ci"), digest("_ci").alias("ci"), F.size("_exact").cast("long").alias("n_exact"), digest("_exact").alias("exact"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\b0\\d{9,10}\\b', '[PHONE]', 'g'), '\\b\\d{9,12}\\b', '[ID_NUMBER]', 'g'),
    '[\\pL\\pN_.+-]+@[\\pL\\pN_-]+\\.[\\pL\\pN_.]+', '[EMAIL]', 'g') AS masked FROM documents""")
def tx_mask_pii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.mask_pii("text").alias("masked"))


def _pad(x: int) -> str:
    return "unhex('" + "".join(f"{b ^ x:02x}" for b in SECRET.encode().ljust(64, b"\0")) + "')"


@query(f"""SELECT doc_id, sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(CASE WHEN doc_id % 3 = 0 THEN 'scope:' || doc_id ELSE source END)))) AS group_hash,
    substr(sha256(text), 1, 24) AS stable FROM documents""")
def tx_ids(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    gid = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    return t.select("doc_id", ids.hash_group(gid, F.col("doc_id").cast("string"), SECRET).alias("group_hash"), ids.stable_id("text").alias("stable"))


LINKS = """links AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS origin, CASE page_id % 8
    WHEN 0 THEN '/groups/g' || (page_id % 13) || '/posts/' || page_id || '/?comment_id=' || (page_id * 3) || '&ref=x'
    WHEN 1 THEN '/groups/g' || (page_id % 13) || '/permalink/' || page_id || '#top' WHEN 2 THEN '/groups/discover?multi_permalinks=' || page_id || '&b=1&comment_id=9'
    WHEN 3 THEN '/permalink.php?id=7&story_fbid=' || page_id || '&id=8' WHEN 4 THEN '/story.php?x=1' WHEN 5 THEN '/watch/' || page_id WHEN 6 THEN '' ELSE '/a/posts/' || page_id || '?x=1' END AS path, html FROM pages)"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    n, k, g = F.col("page_id").cast("string"), F.col("page_id") % 8, (F.col("page_id") % 13).cast("string")
    path = (
        F.when(k == 0, F.concat(F.lit("/groups/g"), g, F.lit("/posts/"), n, F.lit("/?comment_id="), (F.col("page_id") * 3).cast("string"), F.lit("&ref=x")))
        .when(k == 1, F.concat(F.lit("/groups/g"), g, F.lit("/permalink/"), n, F.lit("#top")))
        .when(k == 2, F.concat(F.lit("/groups/discover?multi_permalinks="), n, F.lit("&b=1&comment_id=9")))
        .when(k == 3, F.concat(F.lit("/permalink.php?id=7&story_fbid="), n, F.lit("&id=8")))
        .when(k == 4, F.lit("/story.php?x=1"))
        .when(k == 5, F.concat(F.lit("/watch/"), n))
        .when(k == 6, F.lit(""))
        .otherwise(F.concat(F.lit("/a/posts/"), n, F.lit("?x=1")))
    )
    return p.select("page_id", F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("origin"), path.alias("path"), "html")


@query(f"""WITH {LINKS}, u AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN path ELSE origin || path END AS href, CASE WHEN page_id % 2 = 0 THEN 'https://www.example.com' ELSE origin END AS o, path FROM links)
    SELECT page_id, CASE WHEN href = '' OR o NOT LIKE '%example.com%' THEN NULL ELSE CASE page_id % 8
        WHEN 0 THEN o || '/groups/g' || (page_id % 13) || '/posts/' || page_id || '/?comment_id=' || (page_id * 3) WHEN 1 THEN o || '/groups/g' || (page_id % 13) || '/permalink/' || page_id
        WHEN 2 THEN o || '/groups/discover?multi_permalinks=' || page_id || '&comment_id=9' WHEN 3 THEN o || '/permalink.php?story_fbid=' || page_id || '&id=8'
        WHEN 7 THEN o || '/a/posts/' || page_id END END AS canonical,
        'fb-post-' || CASE WHEN page_id % 8 IN (0, 1, 2, 3, 7) THEN page_id::VARCHAR ELSE substr(sha256(CASE WHEN split_part(href, '?', 1) <> '' THEN lower(trim(split_part(href, '?', 1))) ELSE href END), 1, 24) END AS post_id,
        CASE WHEN page_id % 8 IN (0, 1) THEN 'g' || (page_id % 13) END AS group_id FROM u""")
def tx_urls(spark: SparkSession, d: str) -> DataFrame:
    href = F.when(F.col("page_id") % 2 == 0, F.col("path")).otherwise(F.concat("origin", "path"))
    u = _links(spark, d).withColumn("href", href)
    return u.select("page_id", ids.canonical_content_url("href", "example.com", "https://www.example.com").alias("canonical"), ids.post_id_from_url("href").alias("post_id"), ids.group_id_from_url("href").alias("group_id"))


@query(f"""SELECT doc_id, 'fb-post-' || substr(sha256(source || '|' || substr(lower({collapse('text')}), 1, 160)), 1, 24) AS content_id,
    'fb-comment-' || CASE WHEN doc_id % 2 = 0 THEN substr(sha256(lower('https://X.example/' || doc_id)), 1, 24)
        ELSE substr(sha256(source || '|' || doc_id || '|' || substr(lower({collapse('text')}), 1, 120)), 1, 24) END AS comment_id FROM documents""")
def tx_content_ids(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://X.example/"), F.col("doc_id").cast("string")))
    return t.select("doc_id", ids.post_id_from_content(F.lit(None).cast("string"), "text", "source").alias("content_id"), ids.comment_id("source", url, "text", "doc_id").alias("comment_id"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'PUBLIC' ELSE 'UNKNOWN' END AS privacy FROM supplier""")
def tx_group_privacy(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    label = F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, " Riêng tư, public").when(F.col("s_suppkey") % 3 == 1, " CÔNG KHAI").otherwise(""))
    return s.select("s_suppkey", ids.group_privacy(label, "UNKNOWN").alias("privacy"))


IMG = "replace(html, '<a href=\"/', '<img alt=\"  Pic of \" src=\"https://cdn.example/')"


@query(f"""WITH t AS (SELECT page_id, list_slice(regexp_extract_all({IMG}, '<img\\b[^>]*>'), 1, 8) AS tags FROM pages),
    u AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM t),
    a AS (SELECT page_id, i, trim(regexp_extract(tag, '\\ssrc\\s*=\\s*"([^"]*)"', 1)) AS src FROM u),
    f AS (SELECT page_id, i, src, row_number() OVER (PARTITION BY page_id, lower(src) ORDER BY i) AS rn FROM a),
    g AS (SELECT page_id, list_slice(list(src ORDER BY i), 1, 3) AS urls FROM f WHERE rn = 1 GROUP BY page_id)
    SELECT p.page_id, array_to_string(urls, ' ') AS urls, CASE WHEN urls IS NOT NULL THEN 'Pic of' END AS alt, CASE WHEN urls IS NOT NULL THEN len(urls) || ' image(s) detected' END AS summary,
        urls IS NOT NULL AS visual FROM pages p LEFT JOIN g USING (page_id)""")
def tx_images(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    html = F.replace("html", F.lit('<a href="/'), F.lit('<img alt="  Pic of " src="https://cdn.example/'))
    x = p.select("page_id", images.image_context(html).alias("i"))
    visual = images.has_visual("i.image_urls", "i.image_alt_text", "i.image_summary")
    return x.select("page_id", F.array_join("i.image_urls", " ").alias("urls"), F.col("i.image_alt_text").alias("alt"), F.col("i.image_summary").alias("summary"), visual.alias("visual"))


@query("""SELECT doc_id, substr(substr(source, 1, 240) || CASE WHEN trim(text) <> '' THEN ' OCR: ' || substr(trim(text), 1, 800) ELSE '' END, 1, 500) AS merged FROM documents""")
def tx_image_text(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, d, "documents").select("doc_id", images.image_text(none, "source", "text").alias("merged"))


@query(f"""SELECT doc_id, coalesce(nullif(trim(regexp_replace({norm("text")}, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'research') AS slug, substr({collapse('text')}, 1, 180) AS preview FROM documents""")
def tx_slug_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.slugify("text").alias("slug"), text.preview("text").alias("preview"))


@query("""SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN epoch_us(ts) END AS micros, CASE WHEN event_id % 10 <> 0 THEN round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6, 1) END AS elapsed FROM events""")
def tx_times(spark: SparkSession, d: str) -> DataFrame:
    """ISO text with Z, with an offset, without either, and broken, read back."""
    e = table(spark, d, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    later = F.date_format(F.col("ts") + F.expr("INTERVAL 7 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    k = F.col("event_id") % 10
    raw = F.when(k == 0, "not a time").when(k < 4, F.concat(iso, F.lit("Z"))).when(k < 7, F.concat(later, F.lit("+07:00"))).otherwise(iso)
    t = e.select("event_id", text.parse_ts(raw).alias("t"))
    return t.select("event_id", F.unix_micros("t").alias("micros"), text.elapsed_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("t")).alias("elapsed"))


@query(with_views("candidates") + " SELECT count(*) AS kept FROM candidates WHERE length(content) >= 10 AND coalesce(source_url, '') <> ''")
def tx_length_gate(spark: SparkSession, d: str) -> DataFrame:
    c = candidates_view(spark, d)
    return c.filter(text.long_enough(F.col("record_type"), F.col("content"), F.col("source_url"))).agg(F.count(F.lit(1)).alias("kept"))
