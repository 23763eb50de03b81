"""Readers of discovery feeds and wrapped CSV, and flatteners of landed API responses: one row per hit, nothing fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEED = "seq long, entity_name_raw string, discovery_class string, discovery_source_id string, discovery_url string, retrieved_at timestamp, state string, signals string"
EMPTY = ["", "not found", "n/a", "na", "none", "unknown", "-"]


def read_discovery(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: JSON lines; file name and the feed's own ordinal give the order of first appearance."""
    return spark.read.schema(FEED).json(path).select("*", F.col("_metadata.file_name").alias("file_name"))


def stream_discovery(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01 as a stream of arriving files."""
    return spark.readStream.schema(FEED).json(path)


def read_wrapped_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-02: every line is one quoted CSV field that holds a CSV row; the header line is left out by its text."""
    options = {"escape": '"'}
    inner = F.from_csv(F.regexp_replace("value", "^﻿", ""), "s string", options)["s"]
    header = ",".join(part.split()[0] for part in schema.split(", "))
    rows = spark.read.text(path).select(inner.alias("line")).filter(F.col("line").isNotNull() & (F.col("line") != header))
    return rows.select(F.from_csv("line", schema, options).alias("r")).select("r.*")


def clean_cell(cell: Column) -> Column:
    """SRC-03: empty markers are null."""
    text = F.trim(cell)
    return F.when(~F.lower(text).isin(EMPTY), text)


def money_cell(cell: Column) -> Column:
    return F.regexp_replace(clean_cell(cell), r"[$,\s]", "").try_cast("long")


def list_cell(cell: Column) -> Column:
    return F.filter(F.transform(F.split(clean_cell(cell), ";"), lambda x: F.trim(x)), lambda x: x != "")


ADDRESS = "struct<city:string,state:string>"
IAPD = f"struct<hits:struct<hits:array<struct<_source:struct<firm_name:string,firm_ia_full_sec_number:string,firm_ia_scope:string,firm_ia_disclosure_fl:string,firm_ia_address_details:string>>>>>"


def flatten_iapd(df: DataFrame, body: str = "body") -> DataFrame:
    """SRC-04: adviser-registry hits; a number that starts with 801 is registered, the address is JSON within JSON."""
    hit = df.select("*", F.explode(F.from_json(body, IAPD)["hits"]["hits"]).alias("h")).withColumn("s", F.col("h._source"))
    place = F.from_json(F.col("s.firm_ia_address_details"), "struct<officeAddress:struct<city:string,state:string>>")["officeAddress"]
    return hit.select(*[c for c in df.columns if c != body], F.col("s.firm_name").alias("name"), F.col("s.firm_ia_full_sec_number").startswith("801").alias("registered"), (F.upper("s.firm_ia_scope") == "ACTIVE").alias("active"), (F.col("s.firm_ia_disclosure_fl") == "Y").alias("disclosures"), place["city"].alias("city"), place["state"].alias("state"))


FILINGS = "struct<hits:struct<hits:array<struct<_id:string,_source:struct<ciks:array<string>,display_names:array<string>,file_date:string>>>>>"


def flatten_filing_hits(df: DataFrame, body: str = "body") -> DataFrame:
    """SRC-05: filing hits; accession from the id, address of the archive from both."""
    hit = df.select("*", F.explode(F.from_json(body, FILINGS)["hits"]["hits"]).alias("h"))
    accession = F.split_part(F.col("h._id"), F.lit(":"), F.lit(1))
    cik = F.try_element_at("h._source.ciks", F.lit(1))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.ltrim(F.regexp_replace(cik, "^0+", "")), F.lit("/"), F.regexp_replace(accession, "-", ""))
    return hit.select(*[c for c in df.columns if c != body], accession.alias("accession"), cik.alias("cik"), F.try_element_at("h._source.display_names", F.lit(1)).alias("name"), F.col("h._source.file_date").alias("filed"), url.alias("url"))


def flatten_items(df: DataFrame, path: str, fields: list[str], most: int, body: str = "body") -> DataFrame:
    """SRC-06, SRC-08: an array of flat objects below a path, the first `most` of a response, as the tool shows no more."""
    kind = "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>"
    items = F.slice(F.from_json(F.get_json_object(body, path), kind), 1, most)
    return df.select(*[c for c in df.columns if c != body], F.posexplode(items).alias("place", "i")).select(*[c for c in df.columns if c != body], "place", "i.*")


def flatten_news(df: DataFrame) -> DataFrame:
    return flatten_items(df, "$.articles", ["title", "url", "seendate", "domain"], 25)


def flatten_serp(df: DataFrame) -> DataFrame:
    return flatten_items(df, "$.organic", ["title", "link", "snippet", "date"], 10)


def flatten_nonprofit(df: DataFrame) -> DataFrame:
    return flatten_items(df, "$.organizations", ["ein", "name", "city", "state", "ntee_code"], 100)


def flatten_envelopes(df: DataFrame, body: str = "body") -> DataFrame:
    """SRC-07: {echo, result}: result is an object, a list or nothing; the echo stays as _query."""
    result = F.get_json_object(body, "$.result")
    items = F.when(result.startswith("["), F.from_json(result, "array<struct<email:string,smtp_status:string>>")).when(result.startswith("{"), F.array(F.from_json(result, "struct<email:string,smtp_status:string>")))
    echo = F.coalesce(F.get_json_object(body, "$.echo.domain"), F.get_json_object(body, "$.echo.name"), F.get_json_object(body, "$.echo"))
    keys = [c for c in df.columns if c != body]
    return df.select(*keys, echo.alias("_query"), F.explode_outer(items).alias("i")).select(*keys, "_query", "i.*")


PROFILE = "struct<name:string,firstName:string,lastName:string,headline:string,positions:array<struct<title:string,company:string>>>"


def flatten_profile(df: DataFrame, body: str = "body") -> DataFrame:
    """SRC-09: a person's name, current title and company, and a one-line text of what is known."""
    p = F.from_json(body, PROFILE)
    name = F.coalesce(F.nullif(p["name"], F.lit("")), F.nullif(F.concat_ws(" ", p["firstName"], p["lastName"]), F.lit("")))
    now = F.try_element_at(p["positions"], F.lit(1))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    text = F.concat_ws(" - ", name, blank(now["title"]), blank(now["company"]))
    return df.select(*[c for c in df.columns if c != body], name.alias("name"), now["title"].alias("title"), now["company"].alias("company"), F.concat_ws(" | ", text, blank(p["headline"])).alias("line"))
