"""URLs, hosts, e-mail addresses and page text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that list firms but do not belong to one, and hosts whose news is no signal.
AGGREGATORS = [
    "linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "yelp.com", "wikipedia.org", "crunchbase.com", "bloomberg.com", "reuters.com", "forbes.com", "zoominfo.com", "dnb.com",
    "glassdoor.com", "indeed.com", "bbb.org", "sec.gov", "google.com", "fintrx.com", "radientanalytics.com", "aum13f.com", "usnews.com", "opencorporates.com", "manta.com", "corporationwiki.com", "buzzfile.com", "mapquest.com",
    "bizapedia.com", "apollo.io", "rocketreach.co", "signalhire.com", "brokercheck.finra.org", "finra.org", "wealthminder.com", "investor.gov",
]
NO_NEWS = ["linkedin.com", "preqin.com", "advisorfinder.com", "usnews.com", "zoominfo.com", "crunchbase.com", "pitchbook.com", "sec.gov", "instagram.com", "facebook.com", "twitter.com", "x.com", "tiktok.com", "youtube.com", "reddit.com"]
# Local parts of a firm's shared inboxes.
ROLE_LOCALS = ["info", "contact", "contacts", "hello", "admin", "office", "team", "support", "help", "enquiries", "inquiries", "press", "media", "careers", "jobs", "sales", "noreply", "no-reply", "donotreply", "webmaster", "mail", "general"]
# Words that stand beside a name.
NAME_WORDS = ["jr", "sr", "ii", "iii", "iv", "mr", "ms", "mrs", "dr"]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def host(url: Column) -> Column:
    """CON-01: lower-case host of an http(s) URL without www.; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"(?i)^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\.", ""), F.lit(""))


def listed_host(h: Column, hosts: list[str]) -> Column:
    """A listed host or one below it."""
    return F.coalesce(F.exists(F.array(*[F.lit(a) for a in hosts]), lambda a: (h == a) | h.endswith(F.concat(F.lit("."), a))), F.lit(False))


def is_aggregator(h: Column) -> Column:
    """CON-02: a host that lists firms."""
    return listed_host(h, AGGREGATORS)


def is_blocked_domain(h: Column) -> Column:
    """CON-02: a host whose articles the watch leaves out."""
    return listed_host(h, NO_NEWS)


def email_on_domain(email: Column, domain: Column) -> Column:
    """CON-08: the address is at the domain or below it; a leading www. counts on neither side."""
    bare = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"^www\.", "")
    h, d = bare(F.regexp_extract(email, "@([^@]*)$", 1)), bare(domain)
    return F.coalesce((h != "") & (d != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d))), F.lit(False))


def local_part(email: Column) -> Column:
    return F.lower(F.split_part(F.split_part(email, F.lit("@"), F.lit(1)), F.lit("+"), F.lit(1)))


def is_role_address(email: Column, wide: bool = False) -> Column:
    """CON-09: the local part is a role word; wide: its letters begin or end with one."""
    words = F.array(*[F.lit(w) for w in ROLE_LOCALS])
    if not wide:
        return F.array_contains(words, local_part(email))
    letters = F.array(F.regexp_replace(local_part(email), "[^a-z]", ""))  # a variable of a lambda, so that it is not worked out again for each word
    return F.exists(letters, lambda x: F.exists(words, lambda w: x.startswith(w) | x.endswith(w)))


def email_field(email: Column, principal: Column) -> Column:
    """CON-10: the column an address belongs to."""
    return F.when(is_role_address(email) | F.coalesce(F.trim(principal) == "", F.lit(True)), "firm_email").otherwise("principal_email")


def name_tokens(name: Column) -> Column:
    """CON-12: struct(first, last) of 'First Last' or 'LAST, First', in lower case; titles, suffixes and single letters dropped, nulls where nothing is left."""
    turned = F.when(F.contains(name, F.lit(",")), F.concat_ws(" ", F.regexp_extract(name, "(?s)^[^,]*,(.*)$", 1), F.split_part(name, F.lit(","), F.lit(1)))).otherwise(name)
    words = F.filter(F.regexp_extract_all(F.lower(turned), F.lit("([a-z]+)"), F.lit(1)), lambda t: (F.length(t) > 1) & ~t.isin(NAME_WORDS))
    return F.struct(F.try_element_at(words, F.lit(1)).alias("first"), F.try_element_at(words, F.lit(-1)).alias("last"))


def matches_principal(local: Column, first: Column, last: Column) -> Column:
    """CON-13: the surname (over two letters) within the local part's letters, or the first name (over two letters) as all of them."""
    letters = F.regexp_replace(F.lower(local), "[^a-z]", "")
    return F.coalesce((F.length(last) > 2) & F.contains(letters, last), F.lit(False)) | F.coalesce((F.length(first) > 2) & (letters == first), F.lit(False))


def dedupe_key(url: Column) -> Column:
    """WAT-05: SHA-1 of host and path without trailing slash."""
    path = F.regexp_replace(F.regexp_extract(F.trim(url), r"(?i)^https?://[^/?#]+([^?#]*)", 1), "/+$", "")
    return F.sha1(F.concat(F.coalesce(host(url), F.lit("")), F.lower(path)))


def page_text(html: Column) -> Column:
    """CON-23: text of a page: scripts, styles and tags out, white space folded."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


#: Elements that never hold main text, and words in the class or id of a box that mark it as none of it.
NO_TEXT = ["script", "style", "noscript", "template", "svg", "head", "nav", "footer", "aside", "form", "button", "select", "table"]
NO_MAIN = "ad|ads|advert|banner|breadcrumb|comment|comments|cookie|menu|newsletter|promo|related|share|sidebar|social"
BOX = rf"""(?is)<(?:div|section)\b[^>]*\b(?:class|id)\s*=\s*["'][^"']*\b(?:{NO_MAIN})\b[^"']*["'][^>]*>.*?</(?:div|section)>"""
BREAK = r"(?i)</?(?:p|div|section|article|main|header|h[1-6]|li|ul|ol|dl|dt|dd|br|blockquote|pre|body|html)\b[^>]*>"
LINK = r"(?is)<a\b[^>]*>(.*?)</a>"
#: Least words of a block where the page names no main part; most of a block that may stand in links.
LEAST_WORDS, LINK_SHARE = 10, 1 / 3


def without_boilerplate(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in NO_TEXT:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.regexp_replace(out, BOX, " ")


def main_text(html: Column) -> Column:
    """CON-23: the main text of a page, a block a line: without menus, footers, forms, tables, advertisements and scripts; of the article or main part, if the page names one.

    A block whose text stands for more than LINK_SHARE in links is left out, and outside a named part one of fewer than LEAST_WORDS words.
    """
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))
    inner = lambda page, tag: F.nullif(F.regexp_extract(page, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", 1), F.lit(""))

    def kept(page: Column) -> Column:
        named = F.coalesce(inner(page, "article"), inner(page, "main"))
        blocks = F.transform(F.split(F.coalesce(named, page), BREAK), lambda b: F.struct(plain(b).alias("text"), F.aggregate(F.transform(F.regexp_extract_all(b, F.lit(LINK), F.lit(1)), lambda a: F.length(plain(a))), F.lit(0), lambda n, x: n + x).alias("linked")))
        least = F.when(named.isNotNull(), 1).otherwise(LEAST_WORDS)
        return F.filter(blocks, lambda b: (b["text"] != "") & (b["linked"] <= F.length(b["text"]) * LINK_SHARE) & (F.size(F.split(b["text"], " ")) >= least))

    pages = F.transform(F.array(without_boilerplate(html)), kept)
    return F.array_join(F.transform(pages[0], lambda b: b["text"]), "\n")
