"""Queries of sources, sinks and streams. Landed responses and feeds are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import provenance as P
from ..sources import readers as R
from ..sources import sinks as S
from ..sources import stored as ST
from ..sources.scratch import scratch_path
from ..streaming import stream as T
from ..vocab import HIGH_VALUE
from . import registry
from .demo_views import VIEWS
from .q_cells import CELLS, PICK
from .registry import query

HV = ", ".join(f"('{f}')" for f in HIGH_VALUE)


@query("src01_read_discovery", "v_entity", sql="SELECT seq, name_raw AS entity_name_raw, discovery_class, hq_state AS state FROM v_entity")
def src01(e):
    path = scratch_path(e.sparkSession, "feed")
    e.select("seq", F.col("name_raw").alias("entity_name_raw"), "discovery_class", F.col("hq_state").alias("state")).write.json(path)
    return R.read_discovery(e.sparkSession, path).select("seq", "entity_name_raw", "discovery_class", "state")


@query("src02_read_wrapped_csv", "v_entity", sql="SELECT CAST(record_id AS STRING) AS record_id, trim(name_raw) AS name, entity_type AS kind FROM v_entity")
def src02(e):
    path = scratch_path(e.sparkSession, "wrapped")
    inner = F.to_csv(F.struct(F.col("record_id").cast("string").alias("record_id"), F.trim("name_raw").alias("name"), F.col("entity_type").alias("kind")), {"escape": '"', "quoteAll": "true"})
    e.select(F.concat(F.lit('"'), F.regexp_replace(inner, '"', '""'), F.lit('"')).alias("value")).write.text(path)
    return R.read_wrapped_csv(e.sparkSession, path, "record_id string, name string, kind string")


CELL = "CASE record_id % 5 WHEN 0 THEN 'Not Found' WHEN 1 THEN '$1,234' WHEN 2 THEN ' n/a' WHEN 3 THEN 'a; b;;c ' ELSE '77' END"


@query("src03_clean_csv_cells", "v_entity", sql="""
SELECT record_id, CASE record_id % 5 WHEN 1 THEN '$1,234' WHEN 3 THEN 'a; b;;c' WHEN 4 THEN '77' END AS text, CASE record_id % 5 WHEN 1 THEN 1234 WHEN 4 THEN 77 END AS amount, CASE record_id % 5 WHEN 1 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 1 END AS items FROM v_entity""")
def src03(e):
    c = F.expr(CELL)
    return e.select("record_id", R.clean_cell(c).alias("text"), R.money_cell(c).alias("amount"), F.when(R.clean_cell(c).isNotNull(), F.size(R.list_cell(c))).alias("items"))


@query("src04_flatten_iapd", "v_entity", sql="""
SELECT record_id, name_raw AS name, record_id % 2 = 0 AS registered, record_id % 3 = 0 AS active, record_id % 5 = 0 AS disclosures, 'City' AS city, hq_state AS state FROM v_entity""")
def src04(e):
    address = F.to_json(F.struct(F.struct(F.lit("City").alias("city"), F.col("hq_state").alias("state")).alias("officeAddress")))
    source = F.struct(F.col("name_raw").alias("firm_name"), F.when(F.col("record_id") % 2 == 0, "801-1").otherwise("802-1").alias("firm_ia_full_sec_number"), F.when(F.col("record_id") % 3 == 0, "ACTIVE").otherwise("INACTIVE").alias("firm_ia_scope"), F.when(F.col("record_id") % 5 == 0, "Y").otherwise("N").alias("firm_ia_disclosure_fl"), address.alias("firm_ia_address_details"))
    return R.flatten_iapd(e.select("record_id", F.to_json(F.struct(F.struct(F.array(F.struct(source.alias("_source"))).alias("hits")).alias("hits"))).alias("body")))


@query("src05_flatten_filing_hits", "v_entity", sql="""
SELECT record_id, '0001-24-' || CAST(record_id AS STRING) AS accession, '000' || CAST(record_id AS STRING) AS cik, name_raw AS name, '2024-01-01' AS filed, 'https://www.sec.gov/Archives/edgar/data/' || CAST(record_id AS STRING) || '/000124' || CAST(record_id AS STRING) AS url FROM v_entity WHERE record_id > 0""")
def src05(e):
    n = F.col("record_id").cast("string")
    source = F.struct(F.array(F.concat(F.lit("000"), n)).alias("ciks"), F.array("name_raw").alias("display_names"), F.lit("2024-01-01").alias("file_date"))
    hit = F.struct(F.concat(F.lit("0001-24-"), n, F.lit(":doc.xml")).alias("_id"), source.alias("_source"))
    return R.flatten_filing_hits(e.filter("record_id > 0").select("record_id", F.to_json(F.struct(F.struct(F.array(hit).alias("hits")).alias("hits"))).alias("body")))


@query("src06_flatten_news_and_serp", "v_page", sql="""
SELECT page_id, 0 AS place, 'news' AS kind, url AS link FROM v_page UNION ALL SELECT page_id, unnest([0, 1]), 'serp', url FROM v_page""")
def src06(p):
    item = F.struct(F.lit("t").alias("title"), F.col("url"), F.col("url").alias("link"))
    news = R.flatten_news(p.select("page_id", F.to_json(F.struct(F.array(item).alias("articles"))).alias("body")))
    serp = R.flatten_serp(p.select("page_id", F.to_json(F.struct(F.array(item, item).alias("organic"))).alias("body")))
    return news.select("page_id", "place", F.lit("news").alias("kind"), F.col("url").alias("link")).unionByName(serp.select("page_id", "place", F.lit("serp").alias("kind"), "link"))


@query("src07_flatten_envelopes", "v_entity", sql="""
SELECT record_id, 'fam.com' AS _query, CASE record_id % 3 WHEN 0 THEN 'a@fam.com' WHEN 1 THEN 'b@fam.com' END AS email FROM v_entity UNION ALL SELECT record_id, 'fam.com', 'c@fam.com' FROM v_entity WHERE record_id % 3 = 1""")
def src07(e):
    result = F.expr("""CASE record_id % 3 WHEN 0 THEN '{"email": "a@fam.com"}' WHEN 1 THEN '[{"email": "b@fam.com"}, {"email": "c@fam.com"}]' ELSE 'null' END""")
    return R.flatten_envelopes(e.select("record_id", F.concat(F.lit('{"echo": {"domain": "fam.com"}, "result": '), result, F.lit("}")).alias("body"))).select("record_id", "_query", "email")


@query("src08_flatten_nonprofit", "v_entity", sql="SELECT record_id, 'e' || CAST(record_id AS STRING) AS ein, name_raw AS name, hq_state AS state FROM v_entity")
def src08(e):
    org = F.struct(F.concat(F.lit("e"), F.col("record_id").cast("string")).alias("ein"), F.col("name_raw").alias("name"), F.col("hq_state").alias("state"))
    return R.flatten_nonprofit(e.select("record_id", F.to_json(F.struct(F.array(org).alias("organizations"))).alias("body"))).select("record_id", "ein", "name", "state")


@query("src09_flatten_profile", "v_entity", sql="SELECT record_id, 'Jane Doe' AS name, CASE WHEN record_id % 2 = 0 THEN 'CEO' END AS title, CASE WHEN record_id % 2 = 0 THEN 'Jane Doe - CEO - Fam | Hi' ELSE 'Jane Doe | Hi' END AS line FROM v_entity")
def src09(e):
    positions = F.expr("""CASE WHEN record_id % 2 = 0 THEN '[{"title": "CEO", "company": "Fam"}]' ELSE '[]' END""")
    return R.flatten_profile(e.select("record_id", F.concat(F.lit('{"firstName": "Jane", "lastName": "Doe", "headline": "Hi", "positions": '), positions, F.lit("}")).alias("body"))).select("record_id", "name", "title", "line")


@query("snk01_write_sheets", "v_cand", sql=f"WITH {PICK} SELECT entity_id, discovery_class_primary, rank, excluded, actionability_score FROM sel WHERE NOT excluded")
def snk01(cands):
    path = scratch_path(cands.sparkSession, "sheets")
    chosen = C.select_quota(cands)
    S.write_sheets({"records": chosen.filter("NOT excluded"), "rejected": chosen.filter("excluded"), "class_report": C.class_report(chosen), "dictionary": C.data_dictionary(cands.sparkSession)}, path)
    return cands.sparkSession.read.parquet(f"{path}/records")


@query("snk02_run_manifest", "v_cand", sql=f"""
WITH {PICK}, p AS (SELECT discovery_class_primary AS c, count(*) FILTER (NOT excluded) AS n, count(*) FILTER (excluded) AS x FROM sel GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS selected, CAST(sum(x) AS BIGINT) AS excluded, string_agg(c || '=' || CAST(n AS STRING), ',' ORDER BY c || '=' || CAST(n AS STRING)) FILTER (n > 0) AS per_class, CAST(12.5 AS DOUBLE) AS budget FROM p""")
def snk02(cands):
    return S.run_manifest(C.select_quota(cands), 12.5)


@query("snk03_write_provenance_json", "v_ledger", sql=f"""
WITH {CELLS}, g AS (SELECT entity_id, field_name FROM v_ledger WHERE field_name IS NOT NULL UNION SELECT entity_id, f FROM v_ledger CROSS JOIN (VALUES {HV}) AS h(f))
SELECT g.entity_id, string_agg(g.field_name || '=' || coalesce(value, ''), ';' ORDER BY g.field_name) AS fields FROM g LEFT JOIN c ON c.entity_id = g.entity_id AND c.field_name = g.field_name GROUP BY 1""")
def snk03(ledger):
    path = scratch_path(ledger.sparkSession, "provenance")
    S.write_provenance_json(P.field_records(P.field_grid(ledger), C.resolve_cells(ledger), C.alternatives(ledger)), path)
    back = ledger.sparkSession.read.schema("entity_id long, fields map<string,struct<value:string>>").json(path)
    shown = F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"]["value"], F.lit(""))))
    return back.select("entity_id", F.array_join(shown, ";").alias("fields"))


@query("snk04_mirror_run_log", "v_run", sql="""
WITH r AS (SELECT run_id, min(called_at) AS started_at FROM v_run GROUP BY 1 ORDER BY started_at DESC, run_id LIMIT 10) SELECT run_id, entity_id, 'N' || CAST(entity_id AS STRING) AS canonical_name, count(*) AS n FROM v_run WHERE run_id IN (SELECT run_id FROM r) GROUP BY 1, 2, 3""")
def snk04(runs):
    r = runs.groupBy("run_id").agg(F.min("called_at").alias("started_at"))
    prov = runs.select("run_id", "entity_id", F.to_json(F.struct(F.concat(F.lit("N"), F.col("entity_id").cast("string")).alias("canonical_name"))).alias("record"))
    path = scratch_path(runs.sparkSession, "mirror")
    for _ in range(2):  # written twice, the rows are there once
        newest, rows = S.mirror_run_log(r, prov, 10)
        ST.write_mirror({"runs": newest, "provenance": rows}, path)
    return runs.sparkSession.read.parquet(f"{path}/provenance").groupBy("run_id", "entity_id", "canonical_name").agg(F.count(F.lit(1)).alias("n"))


def events(spark, sf_dir, name):
    """A view of the events table as a stream of its files."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(table.schema)
    if table.inputFiles() and table.inputFiles()[0].endswith("/events.parquet"):  # one file: a stream reads folders
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        stream = reader.parquet(f"{sf_dir}/events.parquet")
    stream.createOrReplaceTempView("ledgerspark_stream_events")
    return spark.sql(VIEWS[name].replace("FROM events", "FROM ledgerspark_stream_events"))


def streaming(name, view, sql=None):
    def mark(f):
        registry._QUERIES[name] = lambda spark, sf_dir: f(events(spark, sf_dir, view))
        if sql:
            registry._SQL[name] = registry.oracle(sql)
        return f

    return mark


SEEN = "2024-01-31 00:00:00"
TITLE = "CASE seq % 4 WHEN 0 THEN 'News of Site Capital today' WHEN 1 THEN 'The Coury Firm Group buys' WHEN 2 THEN 'Nothing here' ELSE 'Turtle Creek Wealth grows' END"
NAMED = "CASE seq % 4 WHEN 0 THEN 'site' WHEN 1 THEN 'coury firm' WHEN 2 THEN 'absent' ELSE 'turtle creek wealth' END"


@streaming("str01_stream_accept", "v_ledger", sql=f"""
SELECT DISTINCT entity_id AS record_id, source_url AS url FROM v_ledger WHERE seq % 9 > 0 AND seq % 4 <> 2 AND created_at >= TIMESTAMP '{SEEN}' - INTERVAL 20 DAY""")
def str01(ledger):
    seen = F.when(F.col("seq") % 9 > 0, F.col("created_at")).alias("observed_at")
    a = ledger.select("seq", F.col("entity_id").alias("record_id"), F.expr(TITLE).alias("title"), F.col("source_url").alias("url"), seen, F.expr(NAMED).alias("phrase"), F.when(F.col("seq") % 4 == 3, 3).otherwise(2).alias("n_tokens"))
    return T.stream_accept(a, SEEN, 20).select("record_id", "url")


@streaming("str02_stream_ledger_image", "v_ledger", sql="SELECT entity_id, field_name, claim_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY created_at DESC, seq DESC) AS n FROM v_ledger) WHERE n = 1")
def str02(ledger):
    return T.stream_ledger_image(ledger.select("entity_id", "field_name", "claim_id", "created_at", "seq")).select("entity_id", "field_name", "claim_id")


def timed(ledger):
    return ledger.select(F.col("field_name").alias("kind"), F.col("created_at").alias("at"))


@streaming("str03_stream_signal_counts", "v_ledger", sql="""
SELECT strftime(created_at, '%Y-%m-%d') AS day, field_name AS kind, count(*) AS signals FROM v_ledger GROUP BY 1, 2""")
def str03(ledger):
    return T.stream_signal_counts(timed(ledger)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind", "signals")


@streaming("str03_sliding_counts", "v_ledger", sql="""
WITH w AS (SELECT strftime(CAST(created_at AS DATE) - CAST(unnest([0, 1]) AS INT), '%Y-%m-%d') AS day, field_name AS kind FROM v_ledger) SELECT day, kind, count(*) AS signals, CAST(0 AS BIGINT) AS stale FROM w GROUP BY 1, 2""")
def str03_sliding(ledger):
    return T.stream_signal_counts(timed(ledger), "2 days", "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind", "signals", "stale")


@streaming("str03_sessions", "v_ledger", sql="""
WITH o AS (SELECT field_name AS kind, created_at AS t, CASE WHEN created_at <= lag(created_at) OVER (PARTITION BY field_name ORDER BY created_at) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM v_ledger WHERE created_at IS NOT NULL),
s AS (SELECT *, sum(opens) OVER (PARTITION BY kind ORDER BY t, opens DESC ROWS UNBOUNDED PRECEDING) AS nth FROM o)
SELECT kind, epoch_us(min(t)) // 1000000 AS start, epoch_us(max(t)) // 1000000 + 1800 AS finish, count(*) AS signals FROM s GROUP BY kind, nth""")
def str03_sessions(ledger):
    return T.stream_sessions(timed(ledger)).select("kind", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("finish"), "signals")


@streaming("str04_stream_progress", "v_run", sql="SELECT run_id, count(*) AS calls, count(*) FILTER (ok) AS ok, CAST(sum(duration_ms) AS BIGINT) AS spent_ms FROM v_run GROUP BY run_id")
def str04(runs):
    return T.stream_progress(runs)
