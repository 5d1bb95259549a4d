"""Columns of identifiers and addresses."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import PRIVATE_MARKERS, PUBLIC_MARKERS, RESERVED_GROUPS
from .text import as_col, collapse, contains_any, let


def hmac_sha256(c: Column | str, secret: str) -> Column:
    """Keyed digest in hex (HMAC-SHA256), as two nested SHA-2 calls over padded keys."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.sha2(F.concat(pad(0x36), as_col(c).cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def hash_group(group_id: Column | str, seed: Column | str, secret: str) -> Column:
    """Digest of a group's id, or of ``scope:<seed>`` where it has none."""
    gid = F.nullif(as_col(group_id), F.lit(""))
    return hmac_sha256(F.coalesce(gid, F.concat(F.lit("scope:"), as_col(seed))), secret)


def stable_id(c: Column | str) -> Column:
    return F.substring(F.sha2(as_col(c).cast("binary"), 256), 1, 24)


def _form(c: Column) -> Column:
    """A value as the query of a URL spells it."""
    return F.url_encode(c)


def canonical_content_url(c: Column | str, host: str = "facebook.com", origin: str = "https://www.facebook.com") -> Column:
    """Address of a post without what doesn't identify it; null for other hosts and other kinds of pages.

    Only the permitted keys of each kind are kept, in a fixed order; of repeated keys the last wins; no fragment.
    """
    x = F.trim(F.coalesce(as_col(c), F.lit("")))
    x = F.when(x.startswith("/"), F.concat(F.lit(origin), x)).otherwise(x)

    def build(u: Column) -> Column:
        bare = F.regexp_replace(u, "#.*$", "")
        scheme = F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
        netloc = F.regexp_extract(bare, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?]*)", 1)
        path = F.regexp_extract(bare, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?]*)?([^?]*)", 1)
        query = F.regexp_extract(bare, r"\?(.*)$", 1)
        items = F.filter(F.split(query, "&"), lambda p: p != "")

        def value(key: str) -> Column:
            own = F.filter(items, lambda p: (F.regexp_extract(p, "^([^=]*)", 1) == key))
            last = F.try_element_at(own, F.lit(-1))
            return F.try_url_decode(F.regexp_replace(last, "^[^=]*=?", ""))

        def kept(*keys: str) -> Column:
            parts = F.array(*[F.when(value(k).isNotNull(), F.concat(F.lit(k + "="), _form(value(k)))) for k in keys])
            return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "&")

        def whole(q: Column) -> Column:
            return F.concat(F.lower(scheme), F.lit("://"), netloc, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))

        story = kept("story_fbid", "fbid", "id", "comment_id")
        return (
            F.when((u == "") | u.startswith("#") | ~netloc.contains(host), F.lit(None).cast("string"))
            .when(path.contains("/posts/") | path.contains("/permalink/"), whole(kept("comment_id")))
            .when(path.contains("/groups/") & value("multi_permalinks").isNotNull(), whole(kept("multi_permalinks", "comment_id")))
            .when((path.endswith("/permalink.php") | path.endswith("/story.php")) & (story != ""), whole(story))
        )

    return let(x, build)


def post_id_from_url(c: Column | str, prefix: str = "fb-post-") -> Column:
    """Number in the address by which a post is known, else a digest of the address before its query."""
    u = as_col(c)
    number = F.coalesce(*[F.nullif(F.regexp_extract(u, p, 1), F.lit("")) for p in (r"/posts/(\d+)", r"/permalink/(\d+)", r"multi_permalinks=(\d+)", r"story_fbid=(\d+)")])
    bare = F.lower(F.trim(F.regexp_extract(u, r"^([^?]*)", 1)))
    return F.concat(F.lit(prefix), F.coalesce(number, stable_id(F.when(bare != "", bare).otherwise(u))))


def post_id_from_content(url: Column | str, content: Column | str, seed: Column | str, prefix: str = "fb-post-") -> Column:
    digest = stable_id(F.concat(as_col(seed), F.lit("|"), F.substring(F.lower(collapse(content)), 1, 160)))
    u = F.nullif(as_col(url), F.lit(""))
    return F.when(u.isNotNull(), post_id_from_url(u, prefix)).otherwise(F.concat(F.lit(prefix), digest))


def comment_id(parent: Column | str, url: Column | str, text: Column | str, ordinal: Column | str, prefix: str = "fb-comment-") -> Column:
    u = F.nullif(as_col(url), F.lit(""))
    own = F.concat_ws("|", as_col(parent), as_col(ordinal).cast("string"), F.substring(F.lower(collapse(text)), 1, 120))
    return F.concat(F.lit(prefix), F.when(u.isNotNull(), stable_id(F.lower(u))).otherwise(stable_id(own)))


def group_id_from_url(c: Column | str) -> Column:
    g = F.trim(F.regexp_extract(as_col(c), r"/groups/([^/?#]+)/?", 1))
    return F.when((g != "") & ~g.isin(*RESERVED_GROUPS), g)


def group_privacy(c: Column | str, default: str = "PUBLIC") -> Column:
    x = F.lower(F.coalesce(as_col(c), F.lit("")))
    return F.when(contains_any(x, PRIVATE_MARKERS), "PRIVATE").when(contains_any(x, PUBLIC_MARKERS), "PUBLIC").otherwise(default)
