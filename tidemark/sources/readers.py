"""Sources and sinks: driver tables, dated JSON lines, feeds, Kafka envelopes, and Parquet for every store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.temporal import FEED_FORMATS, parse_time
from tidemark.functions.text import stable_id, wiki_value

# Schemas of the line formats, tag precedence, tiers of known hosts.
SEC_FACTS = "entity string, cik string, attribute string, value double, unit string, valid_from string, valid_to string, filed string, form string, fy int, fp string, accn string, tag string, restatement boolean, source string, url string"
TENURES = "entity string, cik string, attribute string, value string, person_qid string, item_qid string, valid_from string, valid_to string, start_precision string, end_precision string, rank string, references int, retrieved string, source string, url string"
REVISIONS = "entity string, revid long, timestamp string, comment string, facts map<string,string>, changed map<string,string>, url string, source string"
FEEDS = "source string, title string, summary string, published string, url string"
CHATS = "messages array<struct<role:string,content:string>>"
BENCHMARK = "qid string, question string, category string, entity string, attribute string, expected_answer array<string>, expected_outdated array<string>, gold_docs array<string>, docs array<struct<doc_id:string,text:string,source:string,date:string,tier:int,valid_from:string,valid_to:string,entity:string,derived_from:string,relevance:double>>, should_abstain boolean, has_conflict boolean, as_of string, notes string"
ENVELOPE = "topic string, key string, ts string, payload struct<source_id:string,text:string,doc_id:string,published:string,entity:string,url:string,tier:int>"
TAG_PRIORITY = {"Revenues": 0, "RevenueFromContractWithCustomerExcludingAssessedTax": 1}
HOST_TIERS = {"sec.gov": 1, "ecb.europa.eu": 1, "who.int": 1, "nasa.gov": 1, "arxiv.org": 2, "export.arxiv.org": 2, "wikidata.org": 2, "en.wikipedia.org": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sec_facts(spark: SparkSession, path: str) -> DataFrame:
    """Annual facts as assertions: preferred tags only, in order of (filed, valid_from)."""
    rows = prefer_tags(spark.read.schema(SEC_FACTS).json(path))
    return rows.withColumns({"recorded_at": parse_time(F.col("filed")), "valid_from": parse_time(F.col("valid_from")), "valid_to": parse_time(F.col("valid_to")), "source_id": F.coalesce("source", F.lit("sec.gov"))})


def tag_rank(tag: Column) -> Column:
    return reduce(lambda out, t: F.when(tag == t, TAG_PRIORITY[t]).otherwise(out), TAG_PRIORITY, F.lit(99))


def prefer_tags(rows: DataFrame) -> DataFrame:
    """Of one filing's rows for a fact and period, those of the tag that ranks first (ties stay)."""
    from pyspark.sql import Window

    by = Window.partitionBy("entity", "attribute", "valid_from", "valid_to", "accn").orderBy("_rank")
    return rows.withColumn("_rank", tag_rank(F.col("tag"))).withColumn("_r", F.rank().over(by)).where("_r = 1").drop("_rank", "_r")


def restatements(rows: DataFrame) -> DataFrame:
    """Flag values that differ from the one filed before for the same period."""
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("entity", "attribute", "valid_from", "valid_to").orderBy("filed", "accn"))
    return rows.withColumn("restatement", before.isNotNull() & (before != F.col("value")))


def tenures(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(TENURES).json(path).dropDuplicates(["cik", "value", "valid_from", "valid_to"])
    return rows.withColumns({c: parse_time(F.col(c)) for c in ("valid_from", "valid_to", "retrieved")})


def wiki_revisions(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """CEO values of revisions in time order, only where the value changed and no timeline is known yet."""
    from pyspark.sql import Window

    rows = spark.read.schema(REVISIONS).json(path).withColumn("at", parse_time(F.col("timestamp")))
    rows = rows.select("entity", F.lit("ceo").alias("attribute"), wiki_value(F.lit("ceo"), F.try_element_at("facts", F.lit("ceo"))).alias("value"), "at", "revid").where("value <> ''")
    before = F.lag("value").over(Window.partitionBy("entity").orderBy("at", "revid"))
    rows = rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("value"))).drop("_before")
    return rows if known is None else rows.join(known.select("entity", "attribute").distinct(), ["entity", "attribute"], "left_anti")


def tenure_facts(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Tenures as assertions (entity, attribute, value, valid_from, valid_to, recorded_at, source_id), cut at every boundary.

    companies(cik, entity) gives the name under which a company's facts are kept, joined on CIK; a tenure without
    one keeps its own.
    """
    from tidemark.operators.bitemporal import tenure_segments

    names = companies.where("cik is not null").groupBy("cik").agg(F.min("entity").alias("_entity"))
    named = rows.join(names, "cik", "left").withColumn("entity", F.coalesce("_entity", "entity")).drop("_entity")
    read = named.groupBy("entity").agg(F.max("retrieved").alias("recorded_at"), F.max("source").alias("source_id"))
    return tenure_segments(named).join(read, "entity").withColumn("attribute", F.lit("ceo"))


def load_all(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(assertions, documents) of a folder with sec_facts.jsonl, ceo_tenures.jsonl, wiki_revisions.jsonl, feeds.jsonl.

    Earlier sources come first: revisions count only for facts that neither filings nor tenures have.  Assertions
    are numbered (`seq`) by source, then time; a file that is not there is an empty source.
    """
    columns = ["entity", "attribute", "value", "valid_from", "valid_to", "recorded_at", "source_id"]
    there = lambda name: f"{folder}/{name}.jsonl"
    jvm = spark._jvm.org.apache.hadoop.fs
    exists = lambda path: jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(path))
    none = spark.createDataFrame([], "entity string, attribute string, value string, valid_from timestamp, valid_to timestamp, recorded_at timestamp, source_id string")
    sec = sec_facts(spark, there("sec_facts")) if exists(there("sec_facts")) else None
    filed = sec.withColumn("value", F.concat_ws(" ", F.col("value").cast("decimal(38,2)").cast("string"), "unit")).select(columns) if sec is not None else none
    companies = sec.select("cik", "entity").distinct() if sec is not None else spark.createDataFrame([], "cik string, entity string")
    held = tenure_facts(tenures(spark, there("ceo_tenures")), companies).select(columns) if exists(there("ceo_tenures")) else none
    first = filed.unionByName(held)
    wiki = none
    if exists(there("wiki_revisions")):
        rows = wiki_revisions(spark, there("wiki_revisions"), first)
        wiki = rows.select("entity", "attribute", "value", F.col("at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.col("at").alias("recorded_at"), F.lit("en.wikipedia.org").alias("source_id"))
    parts = [part.withColumn("_source", F.lit(i)) for i, part in enumerate((filed, held, wiki))]
    facts = reduce(DataFrame.unionByName, parts)
    from pyspark.sql import Window

    order = Window.partitionBy("entity", "attribute").orderBy("_source", "recorded_at", "valid_from", "value")
    facts = facts.withColumn("seq", F.row_number().over(order).cast("long")).drop("_source")
    documents = feeds(spark, there("feeds")) if exists(there("feeds")) else spark.createDataFrame([], "doc_id string, source string, text string, date timestamp, tier int, url string")
    return facts, documents


def host_tier(url: Column) -> Column:
    host = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), r"^www\.", "")
    return reduce(lambda out, h: F.when(host == h, HOST_TIERS[h]).otherwise(out), HOST_TIERS, F.lit(3))


def feed_documents(items: DataFrame, least: int = 40) -> DataFrame:
    """Feed items as dated documents; texts under `least` characters are left out."""
    text = F.trim(F.concat_ws(". ", "title", F.nullif(F.col("summary"), F.lit(""))))
    out = items.withColumns({"text": text, "date": parse_time(F.col("published"), (*FEED_FORMATS, "yyyy-MM-dd")), "tier": host_tier(F.col("url")), "doc_id": stable_id(F.col("source"), F.col("title"))})
    return out.where(F.length("text") >= least).select("doc_id", "source", "text", "date", "tier", "url")


def feeds(spark: SparkSession, path: str) -> DataFrame:
    return feed_documents(spark.read.schema(FEEDS).json(path))


def feed_items(xml: DataFrame, limit: int = 25) -> DataFrame:
    """Items of raw RSS or Atom documents (source, xml): the first `limit` of each."""
    entry = r"(?is)<(?:item|entry)[ >].*?</(?:item|entry)>"
    field = lambda *names: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("item", rf"(?is)<(?:{'|'.join(names)})[^>]*>(.*?)</(?:{'|'.join(names)})>", 1), r"(?s)<!\[CDATA\[|\]\]>", ""), r"(?s)<[^>]*>", " "))
    rows = xml.select("source", F.explode(F.slice(F.regexp_extract_all("xml", F.lit(entry), F.lit(0)), 1, limit)).alias("item"))
    link = F.coalesce(F.nullif(field("link"), F.lit("")), F.regexp_extract("item", r"""(?i)<link[^>]*href=["']([^"']+)""", 1))
    return rows.select("source", field("title").alias("title"), field("description", "summary", "content").alias("summary"), field("pubDate", "published", "updated").alias("published"), link.alias("url"))


def benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Items and their documents (one for each doc_id)."""
    items = spark.read.schema(BENCHMARK).json(path, multiLine=True)
    return items, items.select(F.explode("docs").alias("d")).select("d.*").dropDuplicates(["doc_id"])


def benchmark_stats(items: DataFrame) -> DataFrame:
    """Items by category, and a row ALL."""
    return items.rollup("category").agg(F.count("*").alias("n")).withColumn("category", F.coalesce("category", F.lit("ALL")))


def wiki_text(value: Column) -> Column:
    """Infobox markup as plain text: references and templates out, list items by semicolons, amounts and link texts kept."""
    # What is replaced, in this order.
    steps = (
        (r"(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/>", ""), (r"(?i)<br\s*/?>", "; "), (r"(?i)\{\{\s*(?:small|nowrap|nobr)\s*\|([^{}]*)\}\}", "$1"),
        (r"(?i)\{\{\s*(US\$|USD|INR|JPY|EUR|€|£)[^|}]*\|\s*([^|}]+)[^}]*\}\}", "$1 $2"), (r"(?i)\{\{\s*(?:ubl|unbulleted list|plainlist|plain list|flatlist|hlist)\s*\|?", ""),
        (r"\{\{[^{}]*\}\}", " "), (r"\}\}", " "), (r"\[\[([^\]|]*\|)?([^\]]*)\]\]", "$2"), (r"\|", "; "), (r"\n?\*", "; "), (r"''+", ""), (r"<[^>]+>", " "), (r"\s+", " "),
        (r"^[ .,;|]+|[ .,;|]+$", ""),
    )
    return reduce(lambda v, step: F.regexp_replace(v, *step), steps, value)


def chats(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(CHATS).json(path).withColumn("conv_id", F.xxhash64(F.to_json("messages")))
    return rows.select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def envelope(value: Column) -> Column:
    """A bus message's JSON as a struct; null where it is malformed."""
    return F.from_json(value.cast("string"), ENVELOPE)


def message(topic: Column, key: Column, ts: Column, payload: Column) -> Column:
    """The JSON of a bus message, as `envelope` reads it."""
    return F.to_json(F.struct(topic.alias("topic"), key.alias("key"), ts.cast("string").alias("ts"), payload.alias("payload")))


def kafka_sink(messages: DataFrame, servers: str, topic: str, checkpoint: str, **security):
    """A started stream of messages(key, value) to a topic (needs Spark's Kafka package)."""
    options = {k: v for k, v in kafka_options(servers, topic, **security).items() if k.startswith("kafka.")} | {"topic": topic, "checkpointLocation": checkpoint}
    return messages.select(F.col("key").cast("string"), F.col("value").cast("string")).writeStream.format("kafka").options(**options).start()


def kafka_options(servers: str, topic: str, user: str | None = None, password: str | None = None) -> dict[str, str]:
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}
    if user:
        out |= {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": f'org.apache.kafka.common.security.plain.PlainLoginModule required username="{user}" password="{password}";'}
    return out


def kafka_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Messages of a topic (needs Spark's Kafka package); malformed ones have a null payload and their raw value for a dead-letter sink."""
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select(F.col("value").cast("string").alias("raw"), envelope(F.col("value")).alias("m")).select("raw", "m.*")


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
