"""Record, rejection and dictionary sheets."""

from pyspark.sql import functions as F

from ledgerspark.operators import cells


def ledger(spark):
    rows = [
        (1, "a", 1, "principal_name", "Matt Roe", "single_source", "site_scrape", "projected_G2.Q1"), (2, "b", 1, "principal_name", "Ann Doe", "confirmed", "fec_employer", "derived_fec_employer"),
        (3, "c", 1, "aum_usd", "5", "removed_failed_validation", "13f_filing", "derived_13f"), (4, "d", 1, "type_final", "SFO", "verified", "site_scrape", None), (5, "e", 1, "zeta", "z", "verified", "snov", None),
    ]
    return spark.createDataFrame(rows, "seq int, claim_id string, entity_id int, field_name string, answer string, status string, source_class string, extraction_method string").withColumn("created_at", F.col("seq"))


def test_records_say_who_and_describe_what_was_shipped(spark):
    who = spark.createDataFrame([(1, "Acme", "MFO", None, "ship"), (2, "Beta", "SFO", "13f_filing", "ship_with_caveats")], "entity_id int, canonical_name string, type_final string, discovery_class_primary string, outcome string")
    out = cells.records_pivot(ledger(spark), ["principal_name", "type_final", "zeta", "alpha"], who)
    assert out.columns[:6] == ["entity_id", "canonical_name", "type_final", "lead_origin_source_class", "outcome", "aum_usd"]
    assert out.columns[-2:] == ["alpha", "zeta"] and out.columns.count("type_final") == 1
    one, two = out.orderBy("entity_id").collect()
    assert (one.type_final, one.lead_origin_source_class, one.principal_name, one.principal_name_status, one.principal_name_source_class) == ("MFO", "unknown", "Matt Roe", "single_source", "site_scrape")
    assert (one.aum_usd, one.aum_usd_status, one.aum_usd_source_class, one.zeta) == (None, "removed_failed_validation", "13f_filing", "z")
    assert (two.lead_origin_source_class, two.outcome, two.principal_name_status, two.aum_usd_status, two.zeta) == ("13f_filing", "ship_with_caveats", "could_not_verify", "could_not_verify", None)


def test_provenance_has_what_confirmed(spark):
    rows = cells.provenance_rows(ledger(spark).withColumn("confirming_class", F.lit("snov")), spark.createDataFrame([(1,)], "entity_id int")).collect()
    assert rows[0].asDict().keys() == set(cells.PROVENANCE) and len(rows) == 5
    assert {(r.confirming_class, r.verified_at) for r in rows} == {("snov", None)}


def test_report_ends_in_cap_and_counts(spark):
    chosen = spark.createDataFrame([(1, "a", False, 2), (2, "a", False, 5), (3, None, False, 1), (4, "a", True, 9)], "entity_id int, discovery_class_primary string, excluded boolean, actionability_score int")
    assert {tuple(r) for r in cells.class_report(chosen, 2).collect()} == {("class", "a", 2, 3.5), ("class", "unknown", 1, 1.0), ("selected", "a", 2, None), ("selected", "unknown", 1, None), ("cap", "quota cap per class", 2, None)}
    assert {tuple(r) for r in cells.class_report(chosen.limit(0)).collect()} == {("cap", "quota cap per class", 15, None)}


def test_rejections_and_quota(spark):
    chosen = spark.createDataFrame([(4, True), (5, False)], "entity_id int, excluded boolean")
    said = spark.createDataFrame([(9, "wave0", "V5_firm_is_fo:G1.Q3", "2024-01-01")], "entity_id int, stage string, reason_code string, created_at string")
    assert {tuple(r) for r in cells.rejected_rows(said, chosen).collect()} == {(9, "wave0", "V5_firm_is_fo:G1.Q3", "2024-01-01"), (4, "quota", cells.BY_QUOTA, None)}


def test_dictionary_explains_fields_and_statuses(spark):
    rows = cells.data_dictionary(spark).collect()
    assert [r.section for r in rows] == ["field"] * 8 + ["status"] * 6
    assert "removed_failed_validation" in {r.name for r in rows} and "contradicted" not in {r.name for r in rows}
