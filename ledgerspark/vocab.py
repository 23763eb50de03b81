"""Closed vocabularies of the ledger. They must equal those of the data that is read."""

# Status of a claim -> its rank when one claim is chosen for a question (least first).
STATUS_RANK = {"verified": 0, "confirmed": 1, "single_source": 2, "pattern_inferred": 3, "format_only": 4, "could_not_verify": 5, "contradicted": 6, "superseded": 7, "removed_failed_validation": 8}
STATUS_WEIGHT = {"verified": 3, "confirmed": 2, "single_source": 2, "format_only": 1, "pattern_inferred": 1}

# question -> (lane, gate, what happens when nobody knows)
QUESTIONS = {
    "G1.Q1": ("identity_and_type", "HARD", "reject"),
    "G1.Q2": ("identity_and_type", "HARD", "ship_with_label"),
    "G1.Q3": ("identity_and_type", "HARD", "reject"),
    "G1.Q4": ("identity_and_type", "SOFT", "ship_with_label"),
    "G1.Q5": ("identity_and_type", "HARD", "deprioritize"),
    "G1.Q6": ("identity_and_type", "HARD", "deprioritize"),
    "G2.Q1": ("people", "HARD", "deprioritize"),
    "G2.Q2": ("people", "SOFT", "ship_with_label"),
    "G2.Q3": ("people", "SOFT", "ship_with_label"),
    "G3.Q1": ("activity_signals", "SOFT", "ship_with_label"),
    "G3.Q2": ("activity_signals", "SOFT", "ship_with_label"),
}
HARD = sorted(q for q, (_, gate, _) in QUESTIONS.items() if gate == "HARD")
LANES = ["identity_and_type", "people", "activity_signals"]

# Source classes that can confirm another class; any other class cannot.
CONFIRMING = ["adv_index", "13f_filing", "5500_filing", "conference_sighting", "domain_check", "edgar_filing", "fec_employer", "ppp_loans", "web_page", "news_article", "linkedin_profile", "site_scrape", "derived_13f", "derived_5500", "snov", "hunter"]

MULTI_VALUED = ["principal_name", "principal_title"]
HIGH_VALUE = ["principal_name", "principal_email", "principal_phone", "aum_usd", "important_insight"]
COLUMN_ORDER = [
    "entity_id", "canonical_name", "domain", "type_final", "aum_usd", "aum_basis", "aum_as_of", "headcount", "principal_name", "principal_title", "principal_email", "principal_phone",
    "principal_linkedin", "corporate_linkedin", "secondary_contact_name", "secondary_contact_email", "secondary_contact_phone", "important_insight", "recent_investments", "recent_fund_commitments",
    "recent_key_hires", "recent_news", "investing_mandates", "investing_thesis", "sector_focus", "stage_focus", "geography_focus", "check_size_range", "direct_vs_fund", "do_not_pitch", "fit_tags", "background", "public_list_overlap",
]
SIGNAL_FIELDS = ["important_insight", "recent_investments", "recent_fund_commitments"]
DECISION_MAKER = ["principal_name", "G2.Q1"]
CHANNEL = ["principal_email", "principal_phone", "G2.Q2"]
DATED_SIGNAL = ["recent_investments", "important_insight", "G3.Q1", "G3.Q2"]
STALE_DAYS = 180
