"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_windows, decontamination, exact_dedup, manifest, mixing, nearest, page_text, quality, sentencepiece_codec, simhash, spelling, warc, word_windows
from .common import table


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_windows.dedup(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_windows.dedup(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its own evidence, its site's rate, the posterior and the decision."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    out = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), columns=["doc_id", "text"])
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "ids", "n_ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), same.alias("lossless"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_page_text": op1_page_text,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_warc": op3_warc,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_nearest": op10_nearest,
    "op11_manifest": op11_manifest,
    "op12_decontamination": op12_decontamination,
    "op13_spelling": op13_spelling,
}

#: A-Z lower-cased, other letters not.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(codes: str) -> str:
    """Unsigned crc32 of a list of bytes, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}))"


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes ``g, lvl, pos, digest, n`` of the trees over ``leaves`` (``g, pos, digest, n``), and each node's siblings ``l, r``."""
    return f"""{name} AS (
            SELECT g, 0 AS lvl, pos, digest, n FROM {leaves}
            UNION ALL SELECT g, lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 16, n),
        {name}_kin AS (
            SELECT a.g, a.lvl, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
            FROM {name} a JOIN {name} b ON a.g = b.g AND a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL)"""


_CODES = "list_transform(string_split({}, ''), lambda x: unicode(x)::BIGINT)"

SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN g USING (payload_digest)""",
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '1' || source END AS g, {_leaf("text")} AS leaf,
                   CASE WHEN {_crc32(_CODES.format("doc_id::VARCHAR"))} % 5 = 0 THEN {_leaf(_LOWER)} END AS tampered FROM documents),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, leaf AS digest FROM d),
        {_tree("low", "leaves")},
        subs AS (SELECT 0 AS g, g AS source, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, digest FROM low WHERE n = 1),
        {_tree("high", "subs")},
        fold AS (
            SELECT doc_id, leaf, g, 0 AS lvl, pos, coalesce(tampered, leaf) AS x, '' AS proof FROM leaves
            UNION ALL SELECT doc_id, leaf, g, f.lvl + 1, f.pos // 16, sha256(k.l || x || k.r), proof || k.l || k.r FROM fold f JOIN low_kin k USING (g, lvl, pos)),
        low_end AS (SELECT doc_id, leaf, g, arg_max(x, lvl) AS x, arg_max(proof, lvl) AS proof FROM fold GROUP BY ALL),
        fold_high AS (
            SELECT doc_id, leaf, s.digest AS subroot, 0 AS lvl, s.pos, x, proof FROM low_end e JOIN subs s ON e.g = s.source
            UNION ALL SELECT doc_id, leaf, subroot, f.lvl + 1, f.pos // 16, sha256(k.l || x || k.r), proof || k.l || k.r FROM fold_high f JOIN high_kin k USING (lvl, pos)),
        high_end AS (SELECT doc_id, leaf, subroot, arg_max(x, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM fold_high GROUP BY ALL)
        SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = digest AS verified
        FROM high_end, high WHERE n = 1""",
    "op12_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        wins AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS key FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
        places AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS key FROM d, (SELECT DISTINCT size FROM wins), unnest(range(1, len(w) - size + 2)) t(i)),
        met AS (SELECT r, i, size, item FROM places JOIN wins USING (size, key)),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM met, unnest(range(i, i + size)) t(p) GROUP BY r),
        its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""",
    "op13_spelling": f"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, run, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
            WHERE length(run) >= 6 GROUP BY ALL),
        bytes AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END)) AS codes FROM runs),
        hashed AS (SELECT run, n, {_crc32("codes")} AS h FROM bytes),
        words AS (
            SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
        less AS (SELECT word, i, left(word, i - 1) || '$' || substr(word, i + 1) AS key, left(word, i - 1) || substr(word, i + 1) AS short FROM words, unnest(range(1, length(word) + 1)) t(i)),
        pairs AS (
            SELECT a.word, b.word AS other FROM less a JOIN less b ON a.key = b.key AND a.word <> b.word
            UNION SELECT l.word, w.word FROM less l JOIN words w ON l.short = w.word
            UNION SELECT w.word, l.word FROM less l JOIN words w ON l.short = w.word),
        near AS (SELECT p.word, count(*) AS n_near, arg_min(p.other, (-o.n, p.other)) AS best, max(o.n) AS best_n FROM pairs p JOIN words o ON p.other = o.word GROUP BY 1),
        forms AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM words w LEFT JOIN near USING (word)),
        up AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT u.word, f.form, k + 1 FROM up u JOIN forms f ON u.root = f.word WHERE f.form IS NOT NULL),
        ends AS (SELECT word, arg_max(root, k) AS root FROM up GROUP BY 1)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)""",
}
