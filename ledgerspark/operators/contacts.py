"""Contacts, domains and mentions: jobs over landed pages and search responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import spoken
from ..functions.web import EMAIL, email_field, email_on_domain, host, is_aggregator, is_role_address, local_part, main_text, matches_principal, name_tokens
from .ledger import settled
from .resolve import core_name_phrase


def harvest_emails(pages: DataFrame) -> DataFrame:
    """CON-07: addresses on the page's own domain, distinct without case, the first URL kept."""
    rows = pages.select("page_id", "url", host(F.col("url")).alias("domain"), F.explode(F.regexp_extract_all("html", F.lit(f"({EMAIL})"), F.lit(1))).alias("e"))
    rows = rows.withColumn("email", F.lower(F.regexp_replace("e", "[.,;:]+$", ""))).filter(email_on_domain(F.col("email"), F.col("domain")))
    return rows.groupBy("domain", "email").agg(F.min_by("url", "page_id").alias("url"))


def domain_from_sources(sources: DataFrame) -> DataFrame:
    """CON-03: host of a declared website unless it lists firms (entity_id, seq, website)."""
    h = sources.withColumn("domain", host(F.col("website"))).filter(F.col("domain").isNotNull() & ~is_aggregator(F.col("domain")))
    return h.groupBy("entity_id").agg(F.max_by("domain", "seq").alias("domain"))


def domain_matches_entity(h: Column, tokens: Column) -> Column:
    """CON-04: the host's first label starts with a distinctive token or holds one of five letters or more."""
    label = F.regexp_replace(F.split_part(h, F.lit("."), F.lit(1)), "[^a-z0-9]", "")
    return F.exists(tokens, lambda t: label.startswith(t) | ((F.length(t) >= 5) & F.contains(label, t)))


def resolve_domain(serp: DataFrame) -> DataFrame:
    """CON-05: the first acceptable result of the quoted search, else of the fallback (entity_id, tier, pos, link, tokens)."""
    h = serp.withColumn("domain", host(F.col("link"))).filter(F.col("domain").isNotNull() & ~is_aggregator(F.col("domain")))
    fit = h.filter(domain_matches_entity(F.col("domain"), F.col("tokens")))
    return fit.groupBy("entity_id").agg(F.min_by("domain", F.struct("tier", "pos")).alias("domain"))


JSONLD = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
#: Keys below which people are looked for, in this order.
NESTED = ["@graph", "employee", "founder", "member", "employees"]


def _first_person(j: str) -> str:
    """SQL for struct(path, name, title) of the first person of the JSON text j, nodes before what is nested in them; null without any.

    The frontier holds the nodes of one level with their places; each step goes a level down and keeps the person with the least place. A text has no more
    levels than opening brackets, and steps after the last level have nothing to do.
    """
    nested = ", ".join(f"""try_variant_get(n.v, '$["{k}"]', 'variant')""" for k in NESTED)
    items = f"if(schema_of_variant(n.v) LIKE 'ARRAY%', try_variant_get(n.v, '$', 'array<variant>'), if(schema_of_variant(n.v) LIKE 'OBJECT%', array({nested}), cast(array() as array<variant>)))"
    below = f"transform({items}, (c, k) -> named_struct('path', concat(n.path, array(k)), 'v', c))"
    name = "try_variant_get(n.v, '$.name', 'string')"
    kind = """try_variant_get(n.v, '$["@type"]', 'string') = 'Person' OR array_contains(try_variant_get(n.v, '$["@type"]', 'array<string>'), 'Person')"""
    named = f"coalesce({name}, '') <> '' AND (schema_of_variant(try_variant_get(n.v, '$.name', 'variant')) = 'STRING' OR {name} NOT IN ('0', 'false', '[]', '{{}}'))"
    person = f"named_struct('path', n.path, 'name', {name}, 'title', try_variant_get(n.v, '$.jobTitle', 'string'))"
    found = "array<struct<path:array<int>,name:string,title:string>>"
    return f"""
        aggregate(sequence(1, length({j}) - length(translate({j}, '{{[', '')) + 1),
            named_struct('frontier', filter(array(named_struct('path', cast(array() as array<int>), 'v', try_parse_json({j}))), n -> n.v IS NOT NULL), 'found', cast(array() as {found})),
            (state, level) -> named_struct(
                'frontier', filter(flatten(transform(state.frontier, n -> {below})), n -> n.v IS NOT NULL),
                'found', cast(slice(array_sort(concat(state.found, transform(filter(state.frontier, n -> coalesce(({kind}) AND {named}, false)), n -> {person}))), 1, 1) as {found})),
            state -> get(state.found, 0))"""


def jsonld_person(pages: DataFrame) -> DataFrame:
    """CON-06: first person of a page's JSON-LD blocks: a node itself, or at any depth below @graph, employee, founder, member or employees; malformed blocks are passed over."""
    blocks = pages.select("page_id", F.regexp_extract_all("html", F.lit(JSONLD), F.lit(1)).alias("blocks"))
    first = blocks.select("page_id", F.expr(f"get(filter(transform(blocks, j -> {_first_person('j')}), p -> p IS NOT NULL), 0)").alias("p"))
    return first.filter("p IS NOT NULL").select("page_id", "p.name", "p.title")


def attribute_email(df: DataFrame) -> DataFrame:
    """CON-11: role, principal or unknown (email, principal_name)."""
    names = F.filter(F.regexp_extract_all(F.lower("principal_name"), F.lit("([a-z]+)"), F.lit(1)), lambda t: F.length(t) > 2)
    local = F.array(local_part(F.col("principal_email")))  # a variable of a lambda, so that it is not worked out again for each name
    mine = F.coalesce(F.exists(local, lambda x: F.exists(names, lambda t: F.contains(x, t))), F.lit(False))
    return df.withColumn("attribution", F.when(is_role_address(F.col("principal_email"), wide=True), "role").when(mine, "principal").otherwise("unknown"))


def _harvested(emails: DataFrame) -> DataFrame:
    """Each address of a firm once, without case, where it was first seen (firm, seq, email, url)."""
    own = Window.partitionBy("firm", F.lower("email")).orderBy("seq")
    return emails.withColumn("n", F.row_number().over(own)).filter("n = 1").drop("n")


def _site_local(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def infer_pattern(emails: DataFrame, principals: DataFrame) -> DataFrame:
    """CON-14: a firm's convention from the set of its other people's addresses (firm, seq, email, url; firm, principal_name).

    At least half dotted (rounded down, one at least): f.last if the first of them leads with one letter, else first.last. Otherwise at least half of the letters-only locals of
    at most eight letters: first; else flast. No row without another person's address or with less than two names.
    """
    named = principals.select("firm", name_tokens(F.col("principal_name")).alias("n")).filter("n.first IS NOT NULL")
    peers = _harvested(emails).join(named, "firm").withColumn("local", _site_local(F.col("email"))).filter(~is_role_address(F.col("email")) & ~matches_principal(F.col("local"), F.col("n.first"), F.col("n.last")))
    letters = F.regexp_replace(F.lower("local"), "[^a-z]", "")
    dotted = F.contains("local", F.lit("."))
    n = peers.groupBy("firm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(dotted).alias("dots"), F.min_by(F.when(dotted, F.col("local")), F.when(dotted, F.col("seq"))).alias("first_dotted"),
        F.count_if(letters != "").alias("words"), F.count_if((letters != "") & (F.length(letters) <= 8)).alias("short"), F.min_by("url", "seq").alias("url"),
    )
    half = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) / 2))
    by_dot = F.when(F.length(F.split_part("first_dotted", F.lit("."), F.lit(1))) == 1, "f.last").otherwise("first.last")
    pattern = F.when(F.col("dots") >= half("n"), by_dot).when(F.col("words") == 0, None).when(F.col("short") >= half("words"), "first").otherwise("flast")
    return n.select("firm", pattern.alias("pattern"), "url").filter("pattern IS NOT NULL")


def built_email(pattern: Column, first: Column, last: Column, domain: Column) -> Column:
    f = F.substring(first, 1, 1)
    local = F.when(pattern == "first.last", F.concat(first, F.lit("."), last)).when(pattern == "f.last", F.concat(f, F.lit("."), last)).when(pattern == "first", first).otherwise(F.concat(f, last))
    return F.concat(local, F.lit("@"), domain)


def principal_email_on_site(firms: DataFrame, emails: DataFrame) -> DataFrame:
    """CON-15: the first address seen on the site that is the principal's, before one built from the pattern (firms: firm, principal_name, domain; emails: firm, seq, email, url)."""
    named = firms.withColumn("n", name_tokens(F.col("principal_name")))
    mine = _harvested(emails).join(named, "firm").filter(matches_principal(_site_local(F.col("email")), F.col("n.first"), F.col("n.last")))
    seen = mine.groupBy("firm").agg(F.min_by(F.struct("email", "url"), "seq").alias("seen"))
    joined = named.join(seen, "firm", "left").join(infer_pattern(emails, firms), "firm", "left")
    built = F.when(F.col("pattern").isNotNull(), built_email(F.col("pattern"), F.col("n.first"), F.col("n.last"), F.col("domain")))
    was = F.col("seen").isNotNull()
    return joined.select("firm", F.coalesce("seen.email", built).alias("email"), F.when(was, "single_source").when(built.isNotNull(), "pattern_inferred").alias("status"), F.coalesce("seen.url", "url").alias("url"))


def choose_email_vendor(rows: DataFrame) -> DataFrame:
    """CON-16: the first on-domain row of the lookup by name, else of the domain's rows the first with the surname, else the first at all; an outage is told from no evidence and from another company.

    rows, in the vendor's order: firm, seq, email, score, smtp_status, error, domain, by_name (whether the lookup named the principal), principal_name. A lookup by name needs a name.
    """
    last = F.lower(F.try_element_at(F.split(F.trim(F.regexp_replace("principal_name", r"\s+", " ")), " "), F.lit(-1)))
    has = F.coalesce(last != "", F.lit(False))
    asked = rows.filter(~F.col("by_name") | has)
    good = F.coalesce(F.col("email") != "", F.lit(False)) & email_on_domain(F.col("email"), F.col("domain"))
    strong = F.coalesce(F.col("score") >= 70, F.lit(False)) | F.coalesce(F.lower("smtp_status") == "valid", F.lit(False))
    tier = F.when(F.col("by_name"), 0).when(has & F.contains(F.lower("email"), last), 1).otherwise(2)
    sure = F.when(tier == 0, F.when(strong, "medium").otherwise("low")).when(tier == 1, "medium").otherwise("low")
    hit = F.struct("email", email_field(F.col("email"), F.col("principal_name")).alias("field"), sure.alias("confidence"))
    n = asked.groupBy("firm").agg(F.min_by(hit, F.when(good, F.struct(tier.alias("t"), "seq"))).alias("best"), F.bool_or(F.coalesce("error", F.lit(False))).alias("error"), F.count_if(~F.coalesce("error", F.lit(False))).alias("rows"))
    return n.select("firm", "best.email", "best.field", "best.confidence", F.when(F.col("best").isNotNull(), "found").when(F.col("error"), "outage").when(F.col("rows") > 0, "wrong_company").otherwise("no_evidence").alias("result"))


PHONE = r"(?:\+?1[ .-]?)?\(?([2-9][0-9]{2})\)?[ .-]?([2-9][0-9]{2})[ .-]?([0-9]{4})(?![0-9])"


def find_phone(pages: DataFrame) -> DataFrame:
    """CON-17: the first US number of a host's pages, in E.164; its shape is all that is checked."""
    hit = lambda i: F.regexp_extract("html", r"(?<![0-9])" + PHONE, i)
    rows = pages.select("page_id", host(F.col("url")).alias("domain"), F.concat(F.lit("+1"), hit(1), hit(2), hit(3)).alias("phone")).filter(F.length("phone") == 12)
    return rows.groupBy("domain").agg(F.min_by("phone", "page_id").alias("phone")).withColumn("status", F.lit("format_only"))


def name_from_serp_title(title: Column) -> Column:
    """CON-18: what stands before the first ' - ', else the first ' | ', else the first long dash, if it is one to four words; a title without any of them names nobody."""

    def before(mark: str) -> Column:
        part = F.trim(F.split_part(title, F.lit(mark), F.lit(1)))
        return F.when(F.contains(title, F.lit(mark)) & (part != "") & (F.size(F.split(part, r"\s+")) <= 4), part)

    return F.coalesce(*[before(m) for m in (" - ", " | ", " — ")])


def title_from_serp(title: Column, name: Column) -> Column:
    """CON-18: the second part, if the first holds the first word of the name."""
    parts = F.split(F.replace(title, F.lit(" | "), F.lit(" - ")), " - ")
    first = F.lower(F.regexp_extract(name, r"^\s*(\S+)", 1))
    return F.when((F.size(parts) >= 2) & (first != "") & F.contains(F.lower(F.get(parts, F.lit(0))), first), F.trim(F.get(parts, F.lit(1))))


def fold(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def mentions_entity(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """CON-19: whether a text holds the core phrase of one of its entity's names (entity_id, text_id, text; entity_id, phrase: a name or alias). A phrase may stand within longer words."""
    asked = phrases.select("entity_id", core_name_phrase(F.col("phrase")).alias("phrase")).filter("phrase <> ''").groupBy("entity_id").agg(F.collect_set("phrase").alias("phrases"))  # an entity's few names
    pairs = texts.select("entity_id", "text_id", spoken(F.col("text")).alias("body")).join(asked, "entity_id", "left")
    said = F.exists("phrases", lambda p: F.contains("body", p))
    return pairs.select("entity_id", "text_id", F.coalesce(said, F.lit(False)).alias("mentioned"))


def pick_dated_signal(news: DataFrame) -> DataFrame:
    """CON-20: the first article that mentions the entity, dated index articles before news (entity_id, tier, pos, mentioned, title, day)."""
    fit = news.filter(F.col("mentioned") & (F.col("day").isNotNull() | (F.col("tier") > 0)))
    return fit.groupBy("entity_id").agg(F.min_by(F.struct("title", "day"), F.struct("tier", "pos")).alias("a")).select("entity_id", F.lit("recent_news").alias("field_name"), "a.*")


def wave1_gate(ledger: DataFrame) -> DataFrame:
    """CON-21: a decision maker and any channel."""
    live = settled("enrichment")
    has = lambda *f: F.bool_or(live & F.coalesce(F.col("field_name").isin(*f), F.lit(False)))
    return ledger.groupBy("entity_id").agg((has("principal_name") & has("principal_email", "principal_phone", "firm_email")).alias("promotable"))


def check_citation_index(facts: DataFrame, docs: DataFrame, allowed: list[str]) -> DataFrame:
    """CON-22: facts of allowed fields whose index is a document of theirs; the URL comes along."""
    return facts.filter(F.col("field").isin(allowed)).join(docs.select("entity_id", "idx", "url"), ["entity_id", "idx"])


def extract_text(pages: DataFrame, most: int = 5_000_000, least: int = 200, main: Callable[[Column], Column] = main_text) -> DataFrame:
    """CON-23: main text of pages; pages over the size guard and texts under the least length are refused, by rule of the feature. main is the seam for another extractor."""
    rows = pages.withColumn("text", F.when(F.length("html") <= most, main(F.col("html"))))
    return rows.select("page_id", F.when(F.length("text") >= least, F.col("text")).alias("text"), F.when(F.col("html").isNull(), "too_short").when(F.col("text").isNull(), "too_large").when(F.length("text") < least, "too_short").otherwise("ok").alias("result"))


def pick_profile_url(serp: DataFrame, path: str) -> DataFrame:
    """CON-24: the first result whose link has the profile path (entity_id, pos, link)."""
    return serp.filter(F.contains(F.lower("link"), F.lit(path))).groupBy("entity_id").agg(F.min_by("link", "pos").alias("link"))


def fill_unsettled(ledger: DataFrame, tiers: DataFrame) -> DataFrame:
    """CON-25: per open field the claim of the first usable tier; an unusable one only where no tier had a usable one (entity_id, field_name, tier, answer, usable)."""
    done = ledger.filter(settled("enrichment") & F.col("field_name").isNotNull()).select("entity_id", "field_name").distinct()
    own = Window.partitionBy("entity_id", "field_name").orderBy(F.desc("usable"), "tier", "answer")
    return tiers.join(done, ["entity_id", "field_name"], "left_anti").withColumn("n", F.row_number().over(own)).filter("n = 1").drop("n")
