"""Answering sets of questions over a store of versions and a table of chunks.

Questions are a table, and so is everything found for them.  A round is one plan for all questions still open:
their sub-queries meet postings and vectors, candidates get signals and are fused, the best `k` texts of each
question are its evidence, and what that lacks names its next sub-queries.  Questions that lack nothing, gain no
new sub-query or have used up their rounds leave the table with the evidence of that round; the rest go on.
Then the claims of all evidence are routed, judged and put together as answers, a row for each question.  The
driver holds the plans alone: how many jobs run depends on the rounds, not on how many questions there are.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.functions.evidence import number
from tidemark.functions.temporal import freshness, overlap_score
from tidemark.functions.text import human_amount
from tidemark.operators import assess as A
from tidemark.operators import bitemporal as B
from tidemark.operators import claims as C
from tidemark.operators import graph as G
from tidemark.operators import retrieval as R
from tidemark.operators.scoring import Model, rerank
from tidemark.operators.staging import new_path, staged
from tidemark.plans.planner import gap_queries, planned

MODES = ("lexical", "dense", "hybrid", "temporal", "full")


@dataclass
class Config:
    """mode: BM25 alone, vectors alone, both, both with time and source signals, and with the store of versions.

    `signals` are further ranking signals, columns over the candidates by name, with their weights; `embed` gives
    the vectors of texts; `shown` is how many conflicts and versions an answer lists (it says how many there are).
    `reranker` scores a question with each of its first `rerank_depth` texts and decides which are evidence; `nli`
    takes part in the entailment of claims.
    """

    k: int = 8
    candidate_k: int = 50
    max_iterations: int = 3
    domain: str = "corporate"
    mode: str = "full"
    shown: int = 20
    signals: dict[str, tuple[float, Callable[[DataFrame], Column]]] = field(default_factory=dict)
    embed: Callable[[Column], Column] = R.hashed_vector
    reranker: Model | None = None
    rerank_depth: int = 50
    nli: Model | None = None


@dataclass
class Answer:
    question: str
    answer: str
    abstained: bool
    reason: str = ""
    support_level: str = "INSUFFICIENT"
    score: float = 0.0
    coverage: float = 0.0
    claims: list[dict] = field(default_factory=list)
    citations: list[dict] = field(default_factory=list)
    timeline: list[dict] = field(default_factory=list)
    conflicts: list[dict] = field(default_factory=list)
    comparison: list[dict] = field(default_factory=list)
    n_versions: int = 0
    n_conflicts: int = 0
    trace: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str, ensure_ascii=False)

    def to_speech(self) -> str:
        """For reading aloud: no citation marks, the support level in words."""
        said = {"CONFLICTED": "Sources disagree on this.", "INSUFFICIENT": "The evidence for this is insufficient."}.get(self.support_level, "")
        if self.support_level == "HIGH":
            n = len({c["source"] for c in self.citations})
            said = f"{n} independent source{'s' * (n != 1)} support this."
        return re.sub(r"\s*\[E\d+\]", "", " ".join(filter(None, (self.answer, said)))).strip()

    def to_markdown(self) -> str:
        lines = [f"**{self.question}**", "", self.answer, "", f"Support: {self.support_level} ({self.score:.2f})", "", "## Evidence"]
        lines += [f"- [{i}] {' < '.join(c['path'])} ({c['source']}, {c['date']})" for i, c in enumerate(self.citations, 1)]
        return "\n".join(lines)


#: A row for each question; `Answer` has the same fields for one of them.
ANSWERS = (
    "question string, answer string, abstained boolean, reason string, support_level string, score double, coverage double, "
    "claims array<struct<claim_id string, text string, value string, own_doc string, valid_to timestamp, verdict string, entailment double, n_independent long, n_evidence long, checkable boolean, backing array<string>>>, "
    "citations array<struct<doc_id string, source string, date string, marker string, path array<string>>>, "
    "timeline array<struct<value string, valid_from timestamp, valid_to timestamp, change_kind string>>, "
    "conflicts array<struct<entity string, attribute string, value_a string, value_b string, source_id_a string, source_id_b string, valid_from_a timestamp, valid_from_b timestamp, valid_to_a timestamp, valid_to_b timestamp, conflict_type string, severity double, preferred string>>, "
    "comparison array<struct<entity string, value string, valid_from timestamp, valid_to timestamp>>, n_versions long, n_conflicts long, trace array<string>"
)
# The shares that tiers of sources have as a ranking signal; any other tier has the last.
TIER_SIGNAL = {1: 1.0, 2: 0.75, 3: 0.45, None: 0.15}
NOT_ON_RECORD = "The record holds what was true and when; it cannot settle this kind of question."
UNSETTLED = "The evidence does not settle this question."
_LOOKUP = (*B.KEY, "asked_at", "year_only")


def _shaped(rows: DataFrame) -> DataFrame:
    """query_id and all columns of an answer; what the rows lack is empty."""
    spark = rows.sparkSession
    out = ["query_id"]
    for f in spark.createDataFrame([], ANSWERS).schema:
        kind = f.dataType.simpleString()
        none = F.array().cast(kind) if kind.startswith("array") else F.lit({"string": "", "boolean": False}.get(kind, 0)).cast(kind)
        out.append((F.coalesce(F.col(f.name).cast(kind), none) if f.name in rows.columns else none).alias(f.name))
    return rows.select(*out)


def _best(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each question."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def _in_order(columns: list[Column | str], *by: str) -> Column:
    """The rows of a group as an array of structs, ordered by `by`."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*by).alias("_by"), F.struct(*columns).alias("_row")))), lambda s: s["_row"])


class Engine:
    """versions: the bitemporal table; chunks(doc_id, text, source, date, tier, valid_from, valid_to, entity); aliases(alias, entity).

    Postings and vectors of the chunks are staged once, when the first question needs them.
    """

    def __init__(self, versions: DataFrame, chunks: DataFrame, ref: datetime, config: Config | None = None, aliases: DataFrame | None = None) -> None:
        self.versions, self.chunks, self.ref, self.config, self.aliases = versions, chunks, ref, config or Config(), aliases
        self.spark = chunks.sparkSession
        self._named = chunks.withColumn("doc_id", F.col("doc_id").cast("string"))

    @cached_property
    def _postings(self) -> R.TextIndex:
        index = R.TextIndex(self.spark, new_path(self.spark, "postings"))
        index.add(self._named.select("doc_id", "text"))
        return index

    @cached_property
    def _vectors(self) -> DataFrame:
        made = self._named.select("doc_id", F.xxhash64("doc_id").alias("vec_id"), self.config.embed(F.col("text")).alias("embedding"))
        return staged(made, "vectors")

    # ---- names and the store

    def _resolved(self, asked: DataFrame) -> DataFrame:
        """asked(name, ...) with `entity`, the store's entity: by alias, else by distinctive words; a name without one stays."""
        names = asked.select(F.col("name").alias("_asked")).distinct()
        if self.aliases is not None:
            known = self.aliases.select(F.lower("alias").alias("_alias"), F.col("entity").alias("_entity")).dropDuplicates(["_alias"])
            names = names.join(known, F.lower("_asked") == F.col("_alias"), "left").select("_asked", F.coalesce("_entity", "_asked").alias("name"))
        else:
            names = names.withColumn("name", F.col("_asked"))
        found = B.canonical(names.select("name"), B.entities(self.versions)).distinct()
        return asked.join(names.join(found, "name").select(F.col("_asked").alias("name"), "entity"), "name")

    def entities_of(self, names: list[str]) -> list[str]:
        """The store's entities for names as asked."""
        if not names:
            return []
        asked = self.spark.createDataFrame(list(enumerate(names)), "place int, name string")
        return [r.entity for r in self._resolved(asked).orderBy("place").collect()]

    def _heads(self, asked: DataFrame) -> DataFrame:
        """The version that holds at the time asked about for each of asked(entity, attribute, asked_at, year_only), once each.

        A bare year means the fiscal year that ends in it, where the store has one (`fiscal_from`, `fiscal_to`).
        """
        lookups = asked.select(*_LOOKUP).distinct()
        own = self.versions.join(lookups.select(*B.KEY).distinct(), list(B.KEY), "left_semi")
        fiscal = B.fiscal_anchors(own).select(*B.KEY, "fiscal_year", F.col("anchor").alias("_anchor"), F.col("valid_from").alias("fiscal_from"), F.col("valid_to").alias("fiscal_to"))
        lookups = lookups.withColumn("fiscal_year", F.when(F.col("year_only"), F.year("asked_at"))).join(fiscal, [*B.KEY, "fiscal_year"], "left").withColumn("_at", F.coalesce("_anchor", "asked_at")).drop("fiscal_year", "_anchor")
        found = B.as_of(own.join(lookups, list(B.KEY)), F.col("_at"), by=_LOOKUP).drop("_at")
        rest = lookups.join(found.select(*_LOOKUP), list(_LOOKUP), "left_anti").where("fiscal_from is not null").select(*_LOOKUP, "fiscal_from", "fiscal_to")
        return found.unionByName(rest, allowMissingColumns=True)

    # ---- rounds

    def _dense(self, texts: DataFrame) -> DataFrame:
        """(query_id, doc_id, score): the nearest chunks of texts(query_id, text).

        Vectors are compared with every chunk's, so texts of equal vectors are searched for once, as one query.
        """
        asked = staged(texts.select("query_id", self.config.embed(F.col("text")).alias("q")), "asked-vectors")
        once = staged(asked.groupBy("q").agg(F.min("query_id").alias("_one"), F.collect_list("query_id").alias("_all")), "vectors-asked")
        near = R.vector_top(self._vectors.select("vec_id", "embedding"), once.select(F.col("_one").alias("query_id"), "q"), self.config.candidate_k).where("score > 0")
        named = near.withColumnRenamed("query_id", "_one").join(self._vectors.select("vec_id", "doc_id"), "vec_id")
        return once.select("_one", F.explode("_all").alias("query_id")).join(named, "_one").select("query_id", "doc_id", "score")

    def _found(self, asked: DataFrame) -> DataFrame:
        """(query_id, doc_id, score, overlap): the candidates of all sub-queries of asked, each with the best of its scores."""
        config = self.config
        sub = asked.select("query_id", "entity", "intent", "anchor", "start", "end", "halflife_days", F.explode("queries").alias("_text")).withColumn("_sub", F.xxhash64("_text"))
        texts = sub.select(F.col("_sub").alias("query_id"), F.col("_text").alias("text")).distinct()
        none = texts.select("query_id", F.lit("").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
        sparse = dense = none
        if config.mode != "dense":
            sparse = self._postings.top(texts, config.candidate_k).select("query_id", "doc_id", "score")
        if config.mode != "lexical":
            dense = self._dense(texts)
        hits = R.union_candidates(dense, sparse).withColumnRenamed("query_id", "_sub")
        about = sub.withColumnsRenamed({"entity": "_entity", "start": "_start", "end": "_end"})
        rows = about.join(hits, "_sub").join(self._named, "doc_id")
        weights = {"dense": 1.0, "sparse": 1.0}
        if config.mode in ("temporal", "full"):
            t = F.col("anchor")
            fresh = F.when(F.col("intent") == "CURRENT", freshness(F.col("date"), t, F.col("halflife_days"))).otherwise(0.5)
            fit = lambda intent: overlap_score(F.col("valid_from"), F.col("valid_to"), intent, t, F.coalesce("_start", t), F.coalesce("_end", t))
            overlap = reduce(lambda rest, i: F.when(F.col("intent") == i, fit(i)).otherwise(rest), ("CURRENT", "HISTORICAL", "AS_OF", "RANGE", "CHANGE"), F.lit(0.5))
            authority = reduce(lambda rest, x: F.when(F.col("tier") == x[0], x[1]).otherwise(rest), [x for x in TIER_SIGNAL.items() if x[0]], F.lit(TIER_SIGNAL[None]))
            named = F.contains(F.lower(F.concat_ws(" ", "entity", "text")), F.lower("_entity"))
            entity = F.when(F.col("_entity") == "", 0.5).when(named, 1.0).otherwise(0.0)
            rows = rows.withColumns({"freshness": fresh, "temporal": overlap, "authority": authority, "entity_match": entity})
            weights |= {name if name != "entity" else "entity_match": w for name, w in R.FUSION_WEIGHTS.items()}
        for name, (weight, signal) in config.signals.items():
            rows, weights[name] = rows.withColumn(name, signal(rows)), weight
        overlap = F.col("temporal") if "temporal" in rows.columns else F.lit(1.0)
        rows = rows.withColumn("overlap", overlap).withColumn("query_id", F.struct("query_id", "_sub"))
        fused = R.weighted_fuse(rows, weights).withColumn("query_id", F.col("query_id.query_id"))
        return fused.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.max("overlap").alias("overlap"))

    def _evidence(self, asked: DataFrame, found: DataFrame) -> DataFrame:
        """The k best of what was found for each question."""
        config = self.config
        if config.reranker is not None:
            first = asked.select("query_id", F.try_element_at("queries", F.lit(1)).alias("query"))
            pairs = _best(found, config.rerank_depth, F.desc("score"), "doc_id").join(first, "query_id").join(self._named.select("doc_id", "text"), "doc_id")
            best = rerank(pairs.select("query_id", "doc_id", "query", "text", "score"), config.reranker, config.k, config.rerank_depth)
            found = best.select("query_id", "doc_id", "score").join(found.select("query_id", "doc_id", "overlap"), ["query_id", "doc_id"])
        return _best(found, config.k, F.desc("score"), "doc_id").join(self._named, "doc_id")

    def retrieved(self, asked: DataFrame) -> DataFrame:
        """The k best chunks of each question of asked(query_id, queries, entity, intent, anchor, start, end, halflife_days), with score and overlap.

        Each sub-query has dense and sparse candidates; texts that several questions ask are looked up once.
        """
        return self._evidence(asked, self._found(asked))

    def retrieve(self, p: Row, queries: list[str]) -> DataFrame:
        """The k best chunks over the sub-queries of one planned question."""
        row = (0, queries, p.entity, p.time.intent, p.time.anchor, p.time.start, p.time.end, float(p.halflife_days))
        return self.retrieved(self.spark.createDataFrame([row], "query_id int, queries array<string>, entity string, intent string, anchor timestamp, start timestamp, end timestamp, halflife_days double"))

    def _settled(self, evidence: DataFrame, heads: DataFrame) -> DataFrame:
        """Evidence without documents of replaced versions and with those behind the heads, where the store names its evidence."""
        if "evidence_ids" not in self.versions.columns:
            return evidence
        kept = B.settle_evidence(evidence, self.versions, heads, self._named).join(evidence.select("query_id", "doc_id", "overlap"), ["query_id", "doc_id"], "left")
        return kept.withColumn("overlap", F.coalesce("overlap", F.lit(1.0))).join(self._named, "doc_id")

    def _searched(self, asked: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(questions with score, label, n_independent and trace; their evidence), staged, after all rounds."""
        config, done, kept, found = self.config, [], [], None
        is_open, last = asked.withColumn("_new", F.col("queries")), max(1, config.max_iterations)
        for step in range(1, last + 1):
            # a sub-query's candidates do not change, so a round looks up those that it adds
            more = self._found(is_open.withColumn("queries", F.col("_new")))
            if found is not None:
                earlier = found.join(is_open.select("query_id"), "query_id", "left_semi")
                more = earlier.unionByName(more).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.max("overlap").alias("overlap"))
            found = staged(more, "found")
            evidence = staged(self._settled(self._evidence(is_open, found), heads), "evidence")
            about = evidence.join(is_open.select("query_id", "anchor", "halflife_days"), "query_id")
            rows = about.select("query_id", F.coalesce("source", "doc_id").alias("source"), "date", "text", F.lit(None).cast("string").alias("value"), (F.col("overlap") >= 0.5).alias("fresh"), "anchor", "halflife_days")
            scored = C.score_evidence(rows, F.col("anchor"), config.domain, F.col("halflife_days")).select("query_id", "score", "label", "n_independent")
            split = A.temporal_split(evidence, F.col("overlap")).select("query_id", "n_fresh")
            state = is_open.drop("score", "label", "n_independent", "n_fresh").join(scored, "query_id", "left").join(split, "query_id", "left")
            state = state.withColumn("has_evidence", F.col("score").isNotNull()).fillna(0, ["score", "n_independent", "n_fresh"])
            state = state.withColumns({"n_history": F.col("n_versions"), "n_changes": F.greatest(F.col("n_versions") - 1, F.lit(0)), "needs_both": F.col("intent").isin("CHANGE", "RANGE")})
            state = A.gaps(state)
            said = F.concat(F.size("queries").cast("string"), F.lit(" queries; gaps: "), F.when(F.size("gaps") == 0, "none").otherwise(F.array_join("gaps", ", ")))
            more = F.array_except(gap_queries(F.col("gaps"), F.col("entity"), F.col("attribute"), F.year("anchor").cast("string")), F.col("queries"))
            state = state.withColumns({"trace": F.concat("trace", F.array(said)), "_more": more})
            ends = F.col("sufficient") | (F.size("_more") == 0) | (F.col("rounds") <= step) | F.lit(step == last)
            state = staged(state.withColumns({"ended": ends, "queries": F.concat("queries", F.array_sort("_more")), "_new": F.array_sort("_more")}).drop("_more", "gaps", "sufficient", "n_history", "n_changes", "needs_both"), "round")
            done.append(state.where("ended").drop("ended", "_new"))
            kept.append(evidence.join(done[-1].select("query_id"), "query_id", "left_semi"))
            is_open = state.where("not ended").drop("ended", "has_evidence")
            if step == last or is_open.isEmpty():
                break
        return reduce(DataFrame.unionByName, done), staged(reduce(DataFrame.unionByName, kept), "evidence")

    def _judged(self, searched: DataFrame, evidence: DataFrame) -> DataFrame:
        """query_id with its verdicts and the sentences that may be said: claims of its evidence that bear on it, each held against other documents."""
        about = searched.select("query_id", "question", F.col("store_entity").alias("about"), "attribute", "anchor")
        texts = evidence.join(about.select("query_id", "about", "anchor"), "query_id")
        found = C.extract(texts.select("doc_id", "text", "about", F.col("about").alias("subject")).distinct(), carry=("about",))
        found = texts.select("query_id", "doc_id", "about").join(found, ["doc_id", "about"]).drop("about")
        own = staged(A.focused(found, about.select("query_id", "question", F.col("about").alias("entity"), "attribute")), "claims")
        # a claim that names no dates holds for its document's period
        period = texts.select("query_id", "doc_id", F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"))
        bare = F.col("valid_from").isNull() & F.col("valid_to").isNull()
        dated = own.withColumns({c: F.try_to_timestamp(c) for c in ("valid_from", "valid_to")}).join(period, ["query_id", "doc_id"])
        dated = dated.withColumns({"valid_from": F.when(bare, F.col("_from")).otherwise(F.col("valid_from")), "valid_to": F.when(bare, F.col("_to")).otherwise(F.col("valid_to"))})
        key = ["query_id", "claim_id"]
        routed = A.route(dated, texts).join(own.select(*key, F.col("doc_id").alias("_own")), key).where("doc_id <> _own")
        pairs = routed.select(*key, "doc_id", "source", F.col("etext").alias("text"), "valid_to")
        # with a single document there is nothing else to hold a claim against: it then stands on its own text
        alone = own.join(pairs.select(*key).distinct(), key, "left_anti").select(*key, "doc_id").join(texts.select("query_id", "doc_id", "source", "text", "valid_to"), ["query_id", "doc_id"])
        pairs = staged(pairs.unionByName(alone.select(pairs.columns)), "claim-evidence")
        # evidence is stale when it ended before the time that its own question asks about
        ended = pairs.join(about.select("query_id", "anchor"), "query_id").withColumn("valid_to", F.when(F.col("valid_to") < F.col("anchor"), F.col("valid_to")))
        whole = lambda df: df.withColumn("claim_id", F.struct(*key)).drop("query_id")
        verdicts = C.verify(whole(own), whole(ended), F.lit("9999-12-31").cast("timestamp"), nli=self.config.nli).select("claim_id.*", "verdict", "entailment", "n_independent", "n_evidence", "checkable")
        backing = pairs.groupBy(*key).agg(F.array_sort(F.collect_set("doc_id")).alias("backing"))
        judged = own.select(*key, "text", "value", F.col("doc_id").alias("own_doc"), F.try_to_timestamp("valid_to").alias("valid_to")).join(verdicts, key).join(backing, key, "left")
        judged = judged.withColumn("backing", F.array_union(F.array("own_doc"), F.coalesce("backing", F.array().cast("array<string>"))))
        judged = staged(judged, "verdicts")
        shown = ["claim_id", "text", "value", "own_doc", "valid_to", "verdict", "entailment", "n_independent", "n_evidence", "checkable", "backing"]
        per = judged.groupBy("query_id").agg(
            _in_order(shown, "claim_id").alias("claims"), F.count("*").alias("n_claims"), F.count_if(F.col("verdict") == "SUPPORTED").alias("n_supported"), F.count_if(F.col("verdict") == "TEMPORAL_MISMATCH").alias("n_stale"),
        )
        said = A.rewrite(judged.withColumn("refuting", F.expr("slice(backing, 2, 1)"))).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("claim_id", "sentence"))), lambda s: s["sentence"]).alias("sentences"))
        return per.join(said, "query_id", "left")

    def _traced(self, evidence: DataFrame) -> DataFrame:
        """Evidence with the path of documents that each was derived from, itself first, where the chunks name it (`derived_from`)."""
        if "derived_from" not in self._named.columns:
            return evidence.withColumn("path", F.array("doc_id"))
        edges = self._named.where("derived_from is not null").select(F.col("doc_id").alias("src"), F.col("derived_from").cast("string").alias("dst"), F.lit("DERIVED_FROM").alias("etype"))
        ways = G.paths(edges).withColumnRenamed("id", "doc_id")
        return evidence.join(ways, "doc_id", "left").withColumn("path", F.coalesce("path", F.array("doc_id")))

    def _records(self, heads: DataFrame) -> DataFrame:
        """For each fact key of the heads: its versions counted, the last of them, and its serious conflicts."""
        shown, key = self.config.shown, list(B.KEY)
        own = self.versions.join(heads.select(*key).distinct(), key, "left_semi")
        late = own.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("valid_from"), F.desc("seq")))).where(F.col("_place") <= shown).withColumn("_place", -F.col("_place"))
        history = late.groupBy(*key).agg(_in_order([F.col("value").cast("string").alias("value"), "valid_from", "valid_to", "change_kind"], "_place").alias("timeline"))
        serious = B.classify_conflicts(B.conflicts(own), self.config.domain).where("severity >= 0.5")
        serious = serious.withColumns({"_place": F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("severity"), "seq_a", "seq_b")), "n_conflicts": F.count("*").over(Window.partitionBy(*key))}).where(F.col("_place") <= shown)
        columns = [*key, *[f"{c}_{s}" for c in ("value", "source_id", "valid_from", "valid_to") for s in "ab"], "conflict_type", "severity", "preferred"]
        names = [f.split()[0] for f in ANSWERS.split("conflicts array<struct<")[1].split(">>")[0].split(", ")]
        pairs = serious.groupBy(*key).agg(F.max("n_conflicts").alias("n_conflicts"), _in_order([c for c in names if c in columns], "_place").alias("conflicts"))
        return history.join(pairs, key, "left")

    def _looped(self, plans: DataFrame) -> DataFrame:
        """Answers of all planned questions that evidence can settle."""
        full = self.config.mode == "full"
        t = lambda c: F.col(f"time.{c}").alias(c)
        asked = plans.select("query_id", "question", "entity", "attribute", "halflife_days", "min_sources", "queries", F.least("rounds", F.lit(self.config.max_iterations)).alias("rounds"), t("intent"), t("anchor"), t("start"), t("end"), t("year_only"))
        if full:
            named = self._resolved(asked.select("query_id", F.col("entity").alias("name")).where("name <> ''")).select("query_id", F.col("entity").alias("store_entity"))
            asked = asked.join(named, "query_id", "left").withColumn("store_entity", F.coalesce("store_entity", "entity"))
            looked = asked.where("store_entity <> '' and attribute <> ''").select("query_id", F.col("store_entity").alias("entity"), "attribute", F.col("anchor").alias("asked_at"), "year_only")
            heads = staged(looked.join(self._heads(looked), list(_LOOKUP)), "heads")
        else:
            asked = asked.withColumn("store_entity", F.col("entity"))
            heads = staged(asked.select("query_id", F.lit("").alias("entity"), "attribute").limit(0).join(self.versions, list(B.KEY)).withColumns({"fiscal_from": F.lit(None).cast("timestamp"), "fiscal_to": F.lit(None).cast("timestamp"), "asked_at": F.lit(None).cast("timestamp")}), "heads")
        fiscal = heads.where("fiscal_from is not null").select("query_id", F.format_string("FISCAL_YEAR %d -> %s..%s", F.year("asked_at"), F.date_format("fiscal_from", "yyyy-MM-dd"), F.date_format("fiscal_to", "yyyy-MM-dd")).alias("_fiscal"))
        heads = heads.where("value is not null")
        counts = self.versions.join(heads.select(*B.KEY).distinct(), list(B.KEY), "left_semi").groupBy(*B.KEY).agg(F.count("*").alias("n_versions"))
        held = heads.join(counts, list(B.KEY)).select("query_id", "n_versions", F.lit(True).alias("on_record"))
        asked = asked.join(held, "query_id", "left").join(fiscal, "query_id", "left").withColumn("trace", F.when(F.col("_fiscal").isNull(), F.array().cast("array<string>")).otherwise(F.array("_fiscal"))).drop("_fiscal", "year_only")
        asked = staged(asked.fillna(0, ["n_versions"]).fillna(False, ["on_record"]), "asked")
        searched, evidence = self._searched(asked, heads)
        fields = ["doc_id", "source", F.col("date").cast("string").alias("date"), "path"]
        marked = lambda c, i: F.struct(c["doc_id"].alias("doc_id"), c["source"].alias("source"), c["date"].alias("date"), F.concat(F.lit("E"), (i + 1).cast("string")).alias("marker"), c["path"].alias("path"))
        cited = self._traced(evidence).groupBy("query_id").agg(F.transform(_in_order(fields, "doc_id"), marked).alias("citations"))
        line = F.concat("entity", F.lit(": "), "attribute", F.lit(" is "), "value", F.lit(" (from "), F.coalesce(F.date_format("valid_from", "yyyy-MM-dd"), F.lit("the start")), F.lit(", "), F.coalesce("source_id", F.lit("")), F.lit(")."))
        known = heads.join(self._records(heads), list(B.KEY), "left").select("query_id", line.alias("_line"), "timeline", "conflicts", "n_conflicts")
        rows = searched.join(self._judged(searched, evidence), "query_id", "left").join(known, "query_id", "left").join(cited, "query_id", "left").fillna(0, ["n_claims", "n_supported", "n_stale", "n_conflicts"])
        rows = rows.withColumns({"coverage": F.col("n_supported") / F.greatest("n_claims", F.lit(1)), "has_store_value": F.col("on_record")})
        rows = rows.withColumn("reason", C.should_abstain(rows))
        refused = F.col("reason").isNotNull() & ~F.col("on_record")
        none = F.array().cast("array<string>")
        answer = F.when(refused, UNSETTLED).when(F.col("on_record"), F.col("_line")).otherwise(F.array_join(F.slice(F.coalesce("sentences", none), 1, 3), " "))
        label = F.when(refused, "INSUFFICIENT").when(F.size(F.coalesce("conflicts", F.array())) > 0, "CONFLICTED").otherwise(F.coalesce("label", F.lit("MODERATE")))
        rows = rows.withColumns({"answer": answer, "abstained": refused, "support_level": label, "reason": F.when(refused, F.col("reason"))})
        return _shaped(rows.withColumns({c: F.when(~refused, F.col(c)) for c in ("coverage", "claims", "citations", "timeline", "conflicts", "n_versions", "n_conflicts")}))

    def _compared(self, plans: DataFrame) -> DataFrame:
        """One value for each entity that a question names, their spread, and whether their periods are the same."""
        asked = plans.select("query_id", "question", "attribute", F.col("time.anchor").alias("asked_at"), F.col("time.year_only").alias("year_only"), F.posexplode_outer("names").alias("place", "name"))
        sides = self._resolved(asked.where("name is not null"))
        at = sides.join(self._heads(sides), list(_LOOKUP), "left")
        fiscal = F.when(F.col("fiscal_from").isNotNull(), F.format_string("FISCAL_YEAR %d -> %s..%s", F.year("asked_at"), F.date_format("fiscal_from", "yyyy-MM-dd"), F.date_format("fiscal_to", "yyyy-MM-dd")))
        at = staged(at.select("query_id", "place", "entity", "value", number(F.col("value")).alias("n"), "valid_from", "valid_to", "source_id", fiscal.alias("_fiscal")), "compared")
        usd = lambda v: F.when(F.upper(v).endswith("USD"), "USD").otherwise("")
        known = at.where("n is not null").withColumn("shown", F.trim(human_amount(F.col("n"), usd(F.col("value")))))
        spread = A.compared_amounts(known)
        listed = ["entity", "value", "shown", "valid_from", "valid_to", "source_id"]
        per = at.groupBy("query_id").agg(F.count("*").alias("n_asked"), F.array_compact(F.transform(_in_order(["_fiscal"], "place"), lambda s: s["_fiscal"])).alias("trace"), F.array_join(F.array_distinct(F.transform(F.filter(_in_order(["n", "entity"], "place"), lambda s: s["n"].isNull()), lambda s: s["entity"])), ", ").alias("missing"))
        found = known.groupBy("query_id").agg(_in_order(listed, "place").alias("known"), F.min_by(usd(F.col("value")), "place").alias("_unit"))
        rows = plans.select("query_id", "question").join(per, "query_id", "left").join(found, "query_id", "left").join(spread, "query_id", "left")
        rows = rows.withColumn("gap_shown", F.trim(human_amount(F.col("gap"), F.col("_unit"))))
        none = F.col("n_asked").isNull()
        lacking = none | (F.coalesce(F.size("known"), F.lit(0)) < 2) | (F.col("missing") != "")
        values = F.array_join(F.transform("known", lambda r, i: F.concat(r["entity"], F.lit(": "), r["shown"], F.lit(" [E"), (i + 1).cast("string"), F.lit("]"))), "; ")
        factor = F.when(F.coalesce("ratio", F.lit(0.0)) == 0, ".").otherwise(F.concat(F.lit(" (a factor of "), F.format_string("%.2f", F.col("ratio")), F.lit(").")))
        day = lambda c, other: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(other))
        periods = F.array_join(F.transform("known", lambda r: F.concat(r["entity"], F.lit(" "), day(r["valid_from"], "the start"), F.lit(" to "), day(r["valid_to"], "open"))), ", ")
        apart = F.when(F.col("aligned"), "").otherwise(F.concat(F.lit(" The periods are not aligned: "), periods, F.lit(".")))
        text = F.concat(values, F.lit(". "), "highest", F.lit(" is higher than "), "lowest", F.lit(" by "), "gap_shown", factor, F.lit(" The difference is not reported by either source; it is computed here."), apart)
        refusal = F.concat(F.lit("A comparison needs a value on record for each side; there is none for "), F.when(F.col("missing") == "", "the others").otherwise(F.col("missing")), F.lit("."))
        given = lambda c: F.when(~lacking, c)
        return _shaped(
            rows.withColumns(
                {
                    "answer": F.when(none, "No entities to compare are named.").when(lacking, refusal).otherwise(text), "abstained": lacking, "reason": F.when(lacking, "nothing to compare"),
                    "support_level": F.when(lacking, "INSUFFICIENT").otherwise("MODERATE"), "comparison": given(F.transform("known", lambda r: F.struct(r["entity"].alias("entity"), r["value"].alias("value"), r["valid_from"].alias("valid_from"), r["valid_to"].alias("valid_to")))),
                    "citations": given(F.transform("known", lambda r, i: F.struct(r["entity"].alias("doc_id"), r["source_id"].alias("source"), r["valid_from"].cast("string").alias("date"), F.concat(F.lit("E"), (i + 1).cast("string")).alias("marker"), F.array(r["entity"]).alias("path")))),
                }
            )
        )

    # ---- answers

    def answers(self, questions: DataFrame) -> DataFrame:
        """A row for each of questions(query_id, question[, history]): query_id and the fields of `Answer`.

        query_id tells questions apart and must not repeat; a null question is empty.  An empty table gives no rows.
        """
        plans = staged(planned(questions, F.lit(self.ref)), "plans")
        kinds = {r.kind for r in plans.select("kind").distinct().collect()}
        refused = plans.where(F.col("kind").isin("FORECAST", "CAUSAL")).select("query_id", "question", F.lit(NOT_ON_RECORD).alias("answer"), F.lit(True).alias("abstained"), F.lower("kind").alias("reason"), F.lit("INSUFFICIENT").alias("support_level"))
        parts = [_shaped(refused)]
        if "COMPARISON" in kinds:
            parts.append(self._compared(plans.where("kind = 'COMPARISON'")))
        if kinds - {"COMPARISON", "FORECAST", "CAUSAL"}:
            parts.append(self._looped(plans.where("kind not in ('COMPARISON', 'FORECAST', 'CAUSAL')")))
        return reduce(DataFrame.unionByName, parts)

    def answer(self, question: str, history: list[str] | None = None) -> Answer:
        """The answer to one question: that of a set of one."""
        one = self.spark.createDataFrame([(0, question, list(history or []))], "query_id int, question string, history array<string>")
        row = self.answers(one).first().asDict(recursive=True)
        row.pop("query_id")
        return Answer(**row)

    def with_facts(self, versions: DataFrame, chunks: DataFrame) -> Engine:
        """An engine over the store with further documents and a store of versions that takes them in."""
        return Engine(versions, self.chunks.unionByName(chunks.select(self.chunks.columns)), self.ref, self.config, self.aliases)

    def freshness_lag(self, question: str, versions: DataFrame, chunks: DataFrame) -> dict:
        """The answer before and after new facts, and the seconds it takes to take them in and answer again."""
        before, start = self.answer(question), time.time()
        after = self.with_facts(versions, chunks).answer(question)
        return {"answer_before": before.answer, "answer_after": after.answer, "changed": before.answer != after.answer, "seconds": time.time() - start}
