"""From polls to versions of facts, by three queries chained through tables.

polls -> `changed` (texts that differ from the last of their source) -> `facts` (claims of these texts) -> `versions`
(changes of the bitemporal fold); polls that are malformed go to `dead`.  Every table is written by Spark's
file sink, whose log names the files of each (query, batch) that counts: a batch that is run again after a crash
changes nothing, and the next query reads committed files only.  Polls that repeat are told by the detector, facts
that repeat by the fold, so a source that sends a message twice does no harm either.  Facts may come late: the fold
takes them in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import claims as C
from tidemark.operators.bitemporal import change_feed
from tidemark.streaming.detector import detect
from tidemark.streaming.fold import CHANGES, fold_stream, use_keyed_state, versions_of

POLL = "source_id string, at timestamp, seq long, text string, etag string, last_modified string, published timestamp, entity string, url string"
CHANGED = "source_id string, at timestamp, seq long, changed boolean, reason string, polls long, changes long, added array<string>, modified array<string>, removed array<string>, text string, published timestamp, entity string"
FACT = "entity string, attribute string, seq long, value string, valid_from timestamp, valid_to timestamp, recorded_at timestamp, source_id string, evidence_ids array<string>, confidence double"
WELL_FORMED = "source_id is not null and at is not null and seq is not null and text is not null"
STAGES = ("changed", "dead", "facts", "versions")


def claims_as_facts(changed: DataFrame) -> DataFrame:
    """Facts of texts(source_id, at, seq, text, published, entity): usable claims, valid from the date they name, else from publication, else from the poll.

    A fact's seq is a hash of where it stands, so reading the same poll again gives the same fact.
    """
    docs = changed.select(F.concat_ws("#", "source_id", "seq").alias("doc_id"), "text", F.coalesce("entity", F.lit("")).alias("subject"), "source_id", "at", "published", "seq")
    found = C.usable(C.extract(docs.withColumnRenamed("seq", "_seq"), carry=("source_id", "at", "published", "_seq")))
    start = F.coalesce(F.try_to_timestamp("valid_from"), "published", "at")
    return found.select(
        F.trim("subject").alias("entity"), "attribute", F.xxhash64("source_id", "at", "_seq", "claim_id").alias("seq"), "value", start.alias("valid_from"), F.try_to_timestamp("valid_to").alias("valid_to"),
        F.col("at").alias("recorded_at"), "source_id", F.array("doc_id").alias("evidence_ids"), F.lit(0.5).alias("confidence"),
    )


class Topology:
    """The queries over a folder that all executors share.

    `polls` makes a stream of `POLL` rows (from files, Kafka or any other source); `make_facts` turns changed texts into facts.
    """

    def __init__(self, spark: SparkSession, folder: str, polls: Callable[[], DataFrame], mode: str = "reference", late: str | None = None, make_facts: Callable[[DataFrame], DataFrame] = claims_as_facts) -> None:
        self.spark, self.folder, self.polls, self.mode, self.late, self.make_facts = spark, folder.rstrip("/"), polls, mode, late, make_facts
        use_keyed_state(spark)
        for name in STAGES:  # a stream can't read a folder that isn't there
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.readStream.schema(schema).parquet(self.path(name))

    def output(self, name: str) -> DataFrame:
        """The rows that a query emits."""
        if name == "dead":
            return self.polls().where(f"not coalesce({WELL_FORMED}, false)")
        if name == "changed":
            good = self.polls().where(WELL_FORMED).withColumn("claims", F.lit(None).cast("map<string,string>"))
            return detect(good, carry=("text", "published", "entity")).where("changed")
        if name == "facts":
            return self.make_facts(self._read("changed", CHANGED))
        return fold_stream(self._read("facts", FACT), self.mode, self.late)

    def start(self, name: str, every: str | None = None) -> StreamingQuery:
        """Start one query: until all there is has been read, or every so often."""
        writer = self.output(name).writeStream.queryName(f"{name}-{abs(hash(self.folder))}").format("parquet").option("path", self.path(name)).option("checkpointLocation", self.path(f"checkpoints/{name}"))
        return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()

    def run(self) -> None:
        """One pass of all queries, each over what the one before has committed."""
        for name in STAGES:
            self.start(name).awaitTermination()

    def table(self, name: str) -> DataFrame:
        """What a query has committed."""
        schema = {"changed": CHANGED, "facts": FACT, "versions": CHANGES, "dead": f"{POLL}, error string"}[name]
        return self.spark.read.schema(schema).parquet(self.path(name))

    def versions(self) -> DataFrame:
        return versions_of(self.table("versions"))

    def feed(self, limit: int = 100, kind: str | None = None) -> DataFrame:
        """The latest changes of facts."""
        events = self.versions().select("entity", "attribute", F.col("change_kind").alias("kind"), F.col("previous_value").alias("old_value"), F.col("value").alias("new_value"), F.col("recorded_at").alias("detected_at"))
        return change_feed(events, limit, kind)
