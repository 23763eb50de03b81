"""Facts and claims that follow from source rows alone. A source row here has typed columns next to its class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, WORD, once, squeeze, strip
from .cells import provenance_rank
from .ledger import status_rank, uuid5_url
from .resolve import core_name_phrase, holdings_quarter, person_names_match

SETTLED_CLASSES = ["13f_filing", "5500_filing", "adv_index", "conference_sighting", "domain_check"]
REGISTRY = ["adv_index", "13f_filing", "5500_filing", "conference_sighting", "domain_check", "adv_name", "fec_employer"]
TRIGGER_PERCENT = 25.0
MISSING = "\u0000"  # stands for a null class in a set
ALIVE = ["could_not_verify", "removed_failed_validation", "superseded"]


def latest_per_class(sources: DataFrame) -> DataFrame:
    """FX-01: latest row per entity and class."""
    own = Window.partitionBy("entity_id", "source_class").orderBy(F.desc("retrieved_at"), F.desc("seq"))
    return sources.withColumn("__n", F.row_number().over(own)).filter("__n = 1").drop("__n")


def facts_5500(sources: DataFrame) -> DataFrame:
    """FX-02: plan year and participants of the latest 5500."""
    return latest_per_class(sources.filter("source_class = '5500_filing'")).select("entity_id", F.col("filed_year").alias("plan_year"), "participant_count")


def facts_adv_index(sources: DataFrame) -> DataFrame:
    """FX-02: presence, clients and number in the adviser index, of its latest row (payload: JSON text)."""
    p = F.from_json("payload", "struct<present:boolean,client_count:long,crd:string>")
    last = latest_per_class(sources.filter("source_class = 'adv_index'")).withColumn("p", p)
    return last.select("entity_id", F.coalesce("p.present", F.lit(False)).alias("adv_present"), F.col("p.client_count").alias("adv_client_count"), F.col("p.crd").alias("adv_crd"))


def facts_domain(sources: DataFrame) -> DataFrame:
    """FX-02: the domain and whether it takes mail, of the latest check (payload: JSON text)."""
    last = latest_per_class(sources.filter("source_class = 'domain_check'")).withColumn("p", F.from_json("payload", "struct<domain:string,mx_present:boolean>"))
    return last.select("entity_id", "p.domain", F.col("p.mx_present").alias("domain_mx_present"))


def facts_13f(sources: DataFrame) -> DataFrame:
    """FX-03: value, quarter and change in percent, null without a prior value."""
    last = latest_per_class(sources.filter("source_class = '13f_filing'"))
    return last.select("entity_id", "value_usd", holdings_quarter(F.col("filed_year"), F.col("filed_qtr")).alias("quarter"), _delta(F.col("value_usd"), F.col("prior_value_usd")).alias("qoq_delta_pct"))


def _delta(value: Column, prior: Column) -> Column:
    """Change in percent; halves go up. Both sides of the division are whole numbers, so a tie is seen as one."""
    return F.floor((value - prior) * 10_000 / F.nullif(F.abs(prior), F.lit(0)) + 0.5) / 100


def facts_conference(sources: DataFrame) -> DataFrame:
    """FX-04: sightings in row order."""
    rows = sources.filter("source_class = 'conference_sighting'")
    return rows.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("retrieved_at").alias("date"), "value_usd"))).alias("sightings"))


def facts_adv_name(sources: DataFrame) -> DataFrame:
    """FX-05: latest value and first known state of the adviser rows."""
    rows = sources.filter("source_class = 'adv_name'")
    return rows.groupBy("entity_id").agg(F.max_by("value_usd", F.struct("retrieved_at", "seq")).alias("latest_value"), F.min_by("state", F.when(F.col("state").isNotNull(), F.col("seq"))).alias("first_state"))


def facts_fec(sources: DataFrame) -> DataFrame:
    """FX-06: extremes over all rows, states sorted."""
    rows = sources.filter("source_class = 'fec_employer'")
    return rows.groupBy("entity_id").agg(F.max("participant_count").alias("contributors"), F.min("retrieved_at").cast("date").cast("string").alias("first_date"), F.max("retrieved_at").cast("date").cast("string").alias("last_date"), F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"))


def injected_facts(sources: DataFrame) -> DataFrame:
    """FX-07: one value per entity, later classes of the registry first, and the number of classes."""
    last = latest_per_class(sources)
    pick = F.coalesce(*[F.max(F.when(F.col("source_class") == c, F.col("value_usd"))) for c in reversed(REGISTRY)])
    return last.groupBy("entity_id").agg(pick.alias("value_usd"), F.count_distinct("source_class").alias("source_class_count"))


def unverified_leads(leads: DataFrame, cap: int = 10) -> DataFrame:
    """FX-08: distinct seeds (kind, value) of classes that settle nothing, first seen first, cap per entity as the brief shows no more."""
    rows = leads.filter(~F.col("source_class").isin(SETTLED_CLASSES)).groupBy("entity_id", "kind", "value").agg(F.min("seq").alias("seq"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy("seq", "kind", "value"))).filter(F.col("place") <= cap)


def pre_answer_claims(sources: DataFrame) -> DataFrame:
    """FX-09: questions that the sources answer already (entity_id, question_id, answer, source_class)."""
    last = latest_per_class(sources)

    def rule(cls: str, question: str, answer: Column, where: str = "true") -> DataFrame:
        return last.filter((F.col("source_class") == cls) & F.expr(where)).select("entity_id", F.lit(question).alias("question_id"), answer.alias("answer"), "source_class")

    value = F.concat(F.lit("13F value $"), F.format_number("value_usd", 0), F.lit(" ("), F.coalesce(holdings_quarter(F.col("filed_year"), F.col("filed_qtr")), F.lit("unknown quarter")), F.lit(")"))
    parts = [
        rule("adv_index", "G1.Q4", F.concat(F.when(F.col("participant_count") <= 1, "SFO").otherwise("MFO"), F.lit(" (ADV client_count="), F.col("participant_count").cast("string"), F.lit(")")), "participant_count IS NOT NULL"),
        rule("adv_name", "G1.Q4", F.concat(F.lit("MFO (ADV-registered, "), F.col("participant_count").cast("string"), F.lit(" HNW clients)")), "participant_count >= 15"),
        rule("13f_filing", "G3.Q1", value, "value_usd IS NOT NULL"),
        rule("5500_filing", "G1.Q6", F.concat(F.lit("Active per Form 5500 filing for plan year "), F.coalesce(F.col("filed_year").cast("string"), F.lit("unknown")))),
        rule("conference_sighting", "G3.Q2", F.concat(F.lit("Conference sighting on "), F.col("retrieved_at").cast("date").cast("string"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def claim(df: DataFrame, field: str, answer: Column, method: str) -> DataFrame:
    return df.select("entity_id", F.lit(field).alias("field_name"), answer.cast("string").alias("answer"), F.lit(method).alias("extraction_method"))


def _last(source_class: str, *columns: str) -> Column:
    """The named columns of an entity's latest row of a class, as FX-01 has it; an aggregate, so that one pass gives it for several classes."""
    return F.max_by(F.struct(*columns), F.when(F.col("source_class") == source_class, F.struct("retrieved_at", "seq")))


def _told(field: str, answer: Column, method: str, where: Column) -> Column:
    return F.when(where, F.struct(F.lit(field).alias("field_name"), answer.cast("string").alias("answer"), F.lit(method).alias("extraction_method")))


def _aum(f13: Column, adv: Column) -> list[Column]:
    """Claims of the latest 13F and adviser rows of an entity, null where there is none."""
    held, quarter = f13["value_usd"].isNotNull(), holdings_quarter(f13["filed_year"], f13["filed_qtr"])
    raum = f13.isNull() & adv["value_usd"].isNotNull()
    return [
        _told("aum_usd", f13["value_usd"], "derived_13f", held), _told("aum_basis", F.lit("13f_floor"), "derived_13f", held), _told("aum_as_of", quarter, "derived_13f", quarter.isNotNull()),
        _told("aum_usd", adv["value_usd"], "adv_raum", raum), _told("aum_basis", F.lit("adv_raum"), "adv_raum", raum), _told("aum_as_of", F.to_date(adv["retrieved_at"]), "adv_raum", raum & adv["retrieved_at"].isNotNull()),
    ]


def aum_claims(sources: DataFrame) -> DataFrame:
    """DER-01: assets from the latest 13F with basis and quarter; from the adviser rows, with the day they were retrieved, only for entities without one."""
    rows = sources.filter(F.col("source_class").isin("13f_filing", "adv_name")).groupBy("entity_id").agg(_last("13f_filing", "value_usd", "filed_year", "filed_qtr").alias("f13"), _last("adv_name", "value_usd", "retrieved_at").alias("adv"))
    return rows.select("entity_id", F.inline(F.array_compact(F.array(*_aum(F.col("f13"), F.col("adv"))))))


def why_now_from_delta(sources: DataFrame) -> DataFrame:
    """DER-02: a fall or rise of a quarter of the value."""
    return facts_13f(sources).withColumn("trigger", _trigger(F.col("qoq_delta_pct"))).filter("trigger IS NOT NULL").select("entity_id", "trigger", "qoq_delta_pct")


def _trigger(delta: Column) -> Column:
    return F.when(delta <= -TRIGGER_PERCENT, "concentration_pain").when(delta >= TRIGGER_PERCENT, "fresh_liquidity")


def headcount_claim(sources: DataFrame) -> DataFrame:
    """DER-03: participants of the latest 5500."""
    return claim(facts_5500(sources).filter("participant_count IS NOT NULL"), "headcount", F.col("participant_count"), "derived_5500")


def access_window(sources: DataFrame, today: str) -> DataFrame:
    """DER-04: one claim per sighting after today."""
    rows = sources.filter("source_class = 'conference_sighting'").withColumn("day", F.to_date("retrieved_at")).filter(F.col("day") > F.to_date(F.lit(today)))
    return rows.select("entity_id", "seq", F.col("day").cast("string").alias("day"))


def principal_from_people(people: DataFrame) -> DataFrame:
    """DER-05: the first named person of a source row (seq, place, name, full_name, title, occupation, role, source_class); rows of the structured classes have none."""
    if "source_class" in people.columns:
        people = people.filter(~F.col("source_class").isin(SETTLED_CLASSES))
    named = people.withColumn("who", F.coalesce(F.nullif("name", F.lit("")), F.nullif("full_name", F.lit("")))).filter("who IS NOT NULL")
    more = [c for c in ("source_class",) if c in people.columns]
    title = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("title", "occupation", "role") if c in people.columns])
    first = named.groupBy("seq").agg(F.min_by(F.struct("entity_id", F.col("who").alias("principal_name"), title.alias("title"), *more), F.struct("place")).alias("p"))
    return first.select("seq", "p.*")


def discovery_class_claims(sources: DataFrame) -> DataFrame:
    """DER-06: a flag for each class of an entity."""
    return sources.select("entity_id", F.concat(F.lit("discovery_class_"), "source_class").alias("field_name")).distinct()


def public_list_overlap(entities: DataFrame, listed: DataFrame) -> DataFrame:
    """DER-07: names and aliases that stand on the list (record_id, names array; name)."""
    name = lambda c: F.upper(strip(c))
    rows = entities.select("record_id", F.explode("names").alias("n")).select("record_id", name(F.col("n")).alias("name")).distinct()
    return rows.join(listed.select(name(F.col("name")).alias("name")).distinct(), "name", "left_semi").groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("overlap"))


# Seniority groups, most senior first.
ROLES = [["chief executive", "ceo"], ["managing partner"], ["managing member"], ["founder", "co-founder"], ["president"], ["chief investment officer", "cio"], ["managing director"], ["principal"], ["partner"], ["chief operating officer", "coo"], ["chief financial officer", "cfo"]]


def role_rank(title: Column) -> Column:
    """DER-08: place of the first group named in the title, else the number of groups."""
    out = F.when(title.rlike(rf"(?i)\b({'|'.join(ROLES[0])})\b"), 0)
    for i, group in enumerate(ROLES[1:], 1):
        out = out.when(title.rlike(rf"(?i)\b({'|'.join(group)})\b"), i)
    return out.otherwise(len(ROLES))


PROJECTABLE = ["confirmed", "single_source", "verified"]


def winner_order() -> list[Column]:
    return [status_rank(F.col("status")), F.desc_nulls_last("retrieved_at"), F.asc("claim_id")]


def _given(value: Column) -> Column:
    """The value without white space around it, null if nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def project_people_pair(ledger: DataFrame, keep: list[str] = ()) -> DataFrame:
    """DER-09: of the researched names (their distilled value) the one whose title on the same page is the most senior; a name without title still counts.

    The page's title is its best projectable answer, distilled or not: entity_id, principal_name, principal_title, claim_id, title_id and title_distilled. Columns of the ledger that are to be kept
    go along, those of the title's claim as title_....
    """
    fit = ledger.filter(F.col("status").isin(PROJECTABLE)).withColumn("value", _given(F.col("subject_value")))
    titles = fit.filter("question_id = 'G2.Q3' AND source_url <> ''").withColumn("n", F.row_number().over(Window.partitionBy("entity_id", "source_url").orderBy(*winner_order()))).filter("n = 1")
    titles = titles.select("entity_id", "source_url", F.coalesce("value", _given(F.col("answer"))).alias("title"), F.col("claim_id").alias("title_id"), F.col("value").isNotNull().alias("title_distilled"), *[F.col(c).alias(f"title_{c}") for c in keep])
    names = fit.filter("question_id = 'G2.Q1' AND value IS NOT NULL").join(titles, ["entity_id", "source_url"], "left")
    best = names.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy(role_rank(F.coalesce("title", F.lit(""))), *winner_order()))).filter("n = 1")
    return best.select("entity_id", F.col("subject_value").alias("principal_name"), F.col("title").alias("principal_title"), "claim_id", "title_id", "title_distilled", *keep, *[f"title_{c}" for c in keep])


# The field that a question fills.
PROJECTION = {"G2.Q1": "principal_name", "G2.Q3": "principal_title", "G3.Q1": "recent_investments", "G3.Q2": "important_insight"}
PROSE = ["important_insight", "recent_investments"]
STRUCTURED = "^derived_(13f|5500|conference)"
PROFILE = "linkedin.com/in/"
LONGEST_TITLE = 80


def is_negative_answer(text: Column) -> Column:
    """DER-11: a leading token or phrase of absence. Marks part tokens, letters of any script do not."""
    plain = squeeze(F.lower(F.regexp_replace(text, f"[^{WORD}{SPACE}]+", " ")))
    return plain.rlike(r"^(no|none|not|never|unable|insufficient)( |$)|^there (is|are) no( |$)")


def title_matches_firm(title: Column, firm: Column) -> Column:
    """DER-12: the title reads as the firm: one core phrase is or holds the other; an empty phrase is neither."""
    t, f = core_name_phrase(title), core_name_phrase(firm)
    return F.coalesce((t != "") & (f != "") & (F.contains(f, t) | F.contains(t, f)), F.lit(False))


def is_malformed_title(title: Column) -> Column:
    """DER-12: blank, over LONGEST_TITLE characters, or a negation."""
    t = _given(F.coalesce(title, F.lit("")))
    return t.isNull() | (F.length(t) > LONGEST_TITLE) | is_negative_answer(t)


def is_plausible_title(title: Column, person: Column, firm: Column) -> Column:
    """DER-12: well formed, and neither the person nor the firm."""
    t = F.coalesce(_given(title), F.lit(""))
    return ~is_malformed_title(title) & ~person_names_match(t, person) & ~title_matches_firm(t, firm)


def structured_fields(claims: DataFrame) -> DataFrame:
    """Fields that a live structured derivation has settled (entity_id, field)."""
    live = F.col("field_name").isNotNull() & F.col("extraction_method").rlike(STRUCTURED) & ~F.coalesce(F.col("status").isin(ALIVE), F.lit(False))
    return claims.filter(live).select("entity_id", F.col("field_name").alias("field")).distinct()


def project_questions(ledger: DataFrame, firms: DataFrame, settled: DataFrame | None = None, keep: list[str] = ()) -> DataFrame:
    """DER-10: researched answers as field claims (entity_id, field, answer, claim_id, question_id), only where nothing structured settled the field (firms: entity_id, firm).

    Name and title come as the pair of DER-09. Every other question gives its winner, if that is projectable: its distilled value, a profile URL only if it is a person's; without one
    the prose of the two prose fields, unless it is negative, or a title that stands all checks. A distilled title need only be well formed.
    """
    pair = project_people_pair(ledger, keep).join(firms, "entity_id", "left")
    title = F.col("principal_title")
    fit = F.when(F.col("title_distilled"), ~is_malformed_title(title)).otherwise(is_plausible_title(title, F.col("principal_name"), F.col("firm")))
    told = lambda field, answer, claim, question, of: F.struct(F.lit(field).alias("field"), answer.alias("answer"), F.col(claim).alias("claim_id"), F.lit(question).alias("question_id"), *[F.col(of + c).alias(c) for c in keep])
    both = F.array(told("principal_name", F.col("principal_name"), "claim_id", "G2.Q1", ""), F.when(title.isNotNull() & fit, told("principal_title", title, "title_id", "G2.Q3", "title_")))
    paired = pair.select("entity_id", F.inline(F.array_compact(both)))

    asked = ledger.filter(F.col("question_id").isin([*PROJECTION, "G2.Q2"]))
    best = asked.withColumn("n", F.row_number().over(Window.partitionBy("entity_id", "question_id").orderBy(*winner_order()))).filter("n = 1").filter(F.col("status").isin(PROJECTABLE))
    said = ledger.filter((F.col("question_id") == "G2.Q1") & _given(F.col("subject_value")).isNotNull()).groupBy("entity_id").agg(F.min_by(_given(F.col("subject_value")), F.struct("created_at", "seq")).alias("person"))
    rows = best.join(said, "entity_id", "left").join(firms, "entity_id", "left").join(pair.select("entity_id", F.lit(True).alias("paired")), "entity_id", "left")
    value, text = _given(F.col("subject_value")), _given(F.col("answer"))
    field = F.coalesce(*[F.when(F.col("question_id") == q, F.lit(f)) for q, f in PROJECTION.items()], F.when(F.contains(F.lower("subject_value"), F.lit(PROFILE)), F.lit("principal_linkedin")))
    rows = rows.withColumn("field", field).filter("field IS NOT NULL AND NOT (question_id IN ('G2.Q1', 'G2.Q3') AND coalesce(paired, false))")
    as_title = F.when(value.isNotNull(), F.when(~is_malformed_title(value), value)).otherwise(F.when(is_plausible_title(text, F.col("person"), F.col("firm")), text))
    other = F.when(value.isNotNull(), F.col("subject_value")).otherwise(F.when(F.col("field").isin(PROSE) & ~is_negative_answer(F.coalesce(text, F.lit(""))), text))
    rest = rows.withColumn("out", F.when(F.col("field") == "principal_title", as_title).otherwise(other)).filter("out IS NOT NULL").select("entity_id", "field", F.col("out").alias("answer"), "claim_id", "question_id", *keep)

    done = structured_fields(ledger)
    done = done if settled is None else done.unionByName(settled).distinct()
    return paired.unionByName(rest).join(done, ["entity_id", "field"], "left_anti")


def select_principal(claims: DataFrame) -> DataFrame:
    """DER-14: name of the best provenance, first seen on ties."""
    live = claims.filter((F.col("field_name") == "principal_name") & (F.trim("answer") != "") & ~F.col("status").isin(ALIVE))
    return live.groupBy("entity_id").agg(F.min_by(F.struct("answer", "claim_id"), F.struct(provenance_rank(F.col("extraction_method")).alias("r"), "created_at", "seq")).alias("c")).select("entity_id", F.col("c.answer").alias("principal_name"), F.col("c.claim_id").alias("claim_id"))


def reconcile_titles(claims: DataFrame, order: list[str]) -> DataFrame:
    """DER-13: titles that are no title of the winning name are superseded, never deleted.

    claims: entity_id, field_name, answer, extraction_method, status, owner (whose title a derived one is), firm, and the columns of their order. The winner is the name of the best
    provenance, first seen on ties, whatever its status. A title goes if it is the winner's name or the firm's, or if it is derived and its owner isn't the winner; without a winner only the firm is looked at.
    """
    named = (F.col("field_name") == "principal_name") & _given(F.col("answer")).isNotNull()
    place = F.when(named, F.struct(provenance_rank(F.col("extraction_method")).alias("r"), *order))
    rows = once(claims.withColumn("winner", F.min_by("answer", place).over(Window.partitionBy("entity_id"))))
    derived = F.coalesce(F.col("extraction_method").startswith("derived_"), F.lit(False))
    wrong = person_names_match(F.col("answer"), F.col("winner")) | title_matches_firm(F.coalesce("answer", F.lit("")), F.col("firm")) | (F.col("winner").isNotNull() & derived & ~person_names_match(F.col("owner"), F.col("winner")))
    status = F.when((F.col("field_name") == "principal_title") & F.coalesce(wrong, F.lit(False)), "superseded").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("winner")


def wave_minus_1(sources: DataFrame, today: str, people: DataFrame, entities: DataFrame, listed: DataFrame, research: DataFrame) -> DataFrame:
    """DER-15: all claims that sources, lists and earlier research alone give, with stable ids (entity_id, claim_id, field_name, answer, extraction_method, source_class, status).

    people: as for DER-05, with source_class; entities: record_id, firm, names; listed: name; research: a ledger with subject_value. An id is drawn from entity, field, class, method and answer,
    so the same sources give the same claims again.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    columns = ["entity_id", "field_name", "answer", "extraction_method", "source_class", "owner", "part", "at", "shown"]

    def part(df: DataFrame, source_class: Column, nth: int, at: str | None = None, owner: str | None = None, shown: Column | None = None) -> DataFrame:
        null = F.lit(None).cast("string")
        full = df.withColumns({"source_class": source_class, "owner": F.col(owner) if owner else null, "part": F.lit(nth), "at": F.col(at).cast("long") if at else F.lit(0).cast("long"), "shown": shown if shown is not None else text("answer")})
        return full.select(*columns)

    sighted = F.lit("conference_sighting")
    who = principal_from_people(people)
    derived_from = F.concat(F.lit("derived_"), "source_class").alias("extraction_method")
    fields = [F.struct(F.lit("principal_name").alias("field_name"), F.col("principal_name").alias("answer"), F.lit(None).cast("string").alias("of")), F.when(_given(F.col("title")).isNotNull(), F.struct(F.lit("principal_title").alias("field_name"), F.col("title").alias("answer"), F.col("principal_name").alias("of")))]
    people_claims = who.select("entity_id", "seq", "source_class", derived_from, F.inline(F.array_compact(F.array(*fields))))
    # one row an entity: its latest rows of three classes, and the classes that it has
    last = sources.groupBy("entity_id").agg(
        _last("13f_filing", "value_usd", "prior_value_usd", "filed_year", "filed_qtr").alias("f13"), _last("adv_name", "value_usd", "retrieved_at").alias("adv"), _last("5500_filing", "participant_count").alias("plan"), F.collect_set(F.coalesce("source_class", F.lit(MISSING))).alias("classes"),
    )
    trigger, count = _trigger(_delta(F.col("f13.value_usd"), F.col("f13.prior_value_usd"))), F.col("plan.participant_count")
    by_class = [
        *[(F.when(F.lit(k > 2), "adv_name").otherwise("13f_filing"), 0, c) for k, c in enumerate(_aum(F.col("f13"), F.col("adv")))],
        (F.lit("13f_filing"), 1, _told("important_insight", trigger, "derived_13f_qoq", trigger.isNotNull())), (F.lit("5500_filing"), 2, _told("headcount", count, "derived_5500", count.isNotNull())),
    ]
    of = lambda cls, nth, c: F.when(c.isNotNull(), F.struct(c["field_name"].alias("field_name"), c["answer"].alias("answer"), c["extraction_method"].alias("extraction_method"), cls.alias("source_class"), F.lit(nth).alias("part"), F.coalesce(c["answer"], F.lit("None")).alias("shown")))
    flag = lambda x: F.struct(F.concat(F.lit("discovery_class_"), x).alias("field_name"), F.lit("true").alias("answer"), F.lit("derived_entity_sources").alias("extraction_method"), x.alias("source_class"), F.lit(5).alias("part"), F.lit("True").alias("shown"))
    flags = F.transform("classes", lambda x: flag(F.nullif(x, F.lit(MISSING))))
    latest_claims = last.select("entity_id", F.inline(F.concat(F.array_compact(F.array(*[of(*x) for x in by_class])), flags)))
    latest_claims = latest_claims.withColumns({"owner": F.lit(None).cast("string"), "at": F.lit(0).cast("long")}).select(*columns)
    overlap = public_list_overlap(entities, listed).select(F.col("record_id").alias("entity_id"), F.lit("public_list_overlap").alias("field_name"), F.col("overlap").alias("answer"), F.lit("derived_public_list_match").alias("extraction_method"))
    listing = F.concat(F.lit("['"), F.replace("answer", F.lit("|"), F.lit("', '")), F.lit("']"))
    parts = [
        latest_claims,
        part(claim(access_window(sources, today), "important_insight", F.lit("access_window"), "derived_conference"), sighted, 3),
        part(people_claims, F.col("source_class"), 4, "seq", "of"),
        part(overlap, F.lit("public_list"), 6, shown=listing),
    ]
    derived = reduce(DataFrame.unionByName, parts)
    settled = structured_fields(derived.withColumn("status", F.lit("confirmed")))
    firms = entities.select(F.col("record_id").alias("entity_id"), "firm")
    projected = project_questions(research, firms, settled, ["source_class"])
    projected = projected.withColumns({"field_name": F.col("field"), "extraction_method": F.concat(F.lit("projected_"), "question_id")})
    every = derived.unionByName(part(projected, F.col("source_class"), 7)).withColumn("status", F.lit("confirmed")).join(firms, "entity_id", "left")
    out = reconcile_titles(every, ["part", "at"])
    minted = uuid5_url(F.concat_ws("|", text("entity_id"), text("field_name"), text("source_class"), text("extraction_method"), F.col("shown")))
    return out.withColumn("claim_id", minted).select("entity_id", "claim_id", "field_name", "answer", "extraction_method", "source_class", "status")
