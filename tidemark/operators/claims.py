"""Claims: extraction from text, verification against evidence, contradictions, support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import evidence as E
from tidemark.functions import text as X
from tidemark.operators.intervals import overlapping
from tidemark.operators.scoring import Model, scored_pairs

# Names, dates, states.
NAME = r"([A-Z][\w'’-]+(?:\s+[A-Z][\w'’-]+){0,2})"
PERSON = (rf"\b(?:is|as|named|appointed|becomes?|succeeded by)\s+{NAME}", rf"{NAME}\s+(?:was|is|has been|will be)\s+(?:appointed|named|becoming)", rf"{NAME}\s+becomes?\b")
NOT_NAMES = "The A An In On At For And But It He She They This That Its His Her Chief CEO CTO CFO Executive Officer President Chairman Director Board Company Group Inc Ltd Corp Limited Holdings".split()
STATES = ("construction started", "begun construction", "started construction", "under construction", "construction", "operational", "commissioned", "completed", "approved", "planning phase", "planned", "cancelled", "suspended", "delayed", "launched")
DATE = r"(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}|\d{4}-\d{2}-\d{2}|\b(?:19|20)\d{2}\b)"
SINCE = rf"(?i)\b(?:since|effective|starting|as of|from)\s+({DATE})"
UNTIL = rf"(?i)\b(?:until|through|up to|ended?)\s+({DATE})"
PERSON_ATTRIBUTES = ("ceo", "cto", "cfo")
CLAUSE = r";\s*|,\s+(?:and|but|while|whereas)\s+|\s+--\s+"


def leading_subject(sentence: Column) -> Column:
    """The capitalised phrase that opens a sentence, within its first six words."""
    first = F.trim(F.regexp_replace(F.regexp_extract(sentence, r"\A\s*(?:\S++\s++){0,5}\S*", 0), r"\s+", " "))
    phrase = F.regexp_extract(first, r"(?:^| )(\p{Lu}\S*(?: (?:\p{Lu}\S*|(?i:of|and|&)(?= |$)))*)", 1)
    return F.trim(F.regexp_replace(phrase, r"(?<![^ ])[,.:;]+|[,.:;]+(?![^ ])", ""))


def claim_value(text: Column, attribute: Column, numeric: Column | None = None, unit: Column | None = None) -> Column:
    """A person, a state or a figure (that of `numeric` and `unit`, where they are known), as the attribute calls for; empty without one."""
    numeric, unit = E.number(text) if numeric is None else numeric, E.unit(text) if unit is None else unit
    person = F.lit("")
    for pattern in reversed(PERSON):
        name = F.regexp_extract(text, pattern, 1)
        good = (name != "") & ~F.element_at(F.split(name, r"\s+"), 1).isin(NOT_NAMES)
        person = F.when(good, name).otherwise(person)
    stated, state = F.trim(F.regexp_extract(text, r"(?i)\bstatus\s+(?:is|=|:)\s*([a-z ]+)", 1)), F.lit("")
    for word in reversed(STATES):
        state = F.when(F.contains(F.lower(text), F.lit(word)), word).otherwise(state)
    figure = F.coalesce(F.concat(X.short_number(numeric), unit), F.lit(""))
    return F.when(attribute.isin(*PERSON_ATTRIBUTES), person).when(attribute == "status", F.when(stated != "", stated).otherwise(state)).otherwise(figure)


def extract(docs: DataFrame, mode: str = "words", carry: tuple[str, ...] = ()) -> DataFrame:
    """Claims of docs(doc_id, text[, subject]): sentences of three words and more, one claim each for its clauses.

    Columns in `carry` stay with a document's claims.

    Subject is the capitalised phrase that opens the clause, else the hint; hedged and opinion clauses are marked.
    """
    hint = F.col("subject") if "subject" in docs.columns else F.lit("")
    rows = docs.select("doc_id", *carry, hint.alias("hint"), F.explode(X.sentences(F.coalesce("text", F.lit("")))).alias("s")).select("doc_id", *carry, "hint", "s.*")
    plain = F.regexp_replace("sentence", r",\s+which\s+[^,]+,\s*", " ")
    rows = rows.select("doc_id", *carry, "hint", "start", F.posexplode(F.split(plain, CLAUSE)).alias("clause", "text"))
    rows = rows.where(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= 3)
    rows = rows.withColumns({"attribute": E.attribute(F.col("text"), mode), "numeric": E.number(F.col("text")), "unit": E.unit(F.col("text")), "lead": leading_subject(F.col("text"))})
    pronoun = F.col("lead").rlike(r"(?i)^(it|its|they|their|he|she|his|her|the company|the firm|this)$")
    rows = rows.withColumn("subject", F.when((F.col("lead") == "") | pronoun, F.col("hint")).otherwise(F.col("lead")))
    rows = rows.withColumns({"value": claim_value(F.col("text"), F.col("attribute"), F.col("numeric"), F.col("unit")), "hedged": E.hedged(F.col("text")), "checkable": E.checkable(F.col("text")), "valid_from": F.nullif(F.regexp_extract("text", SINCE, 1), F.lit("")), "valid_to": F.nullif(F.regexp_extract("text", UNTIL, 1), F.lit(""))})
    return rows.select("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), "start", "clause").alias("claim_id"), "text", "subject", "attribute", "value", "numeric", "unit", "hedged", "checkable", "valid_from", "valid_to", "start", *carry)


def usable(claims: DataFrame) -> DataFrame:
    return claims.where((F.col("subject") != "") & (F.col("attribute") != "") & (F.col("value") != "") & ~F.col("hedged"))


def state_of(claims: DataFrame) -> DataFrame:
    """(subject, attribute, value): the last usable claim of each fact."""
    return usable(claims).groupBy(F.trim("subject").alias("subject"), "attribute").agg(F.max_by("value", F.struct("doc_id", "start")).alias("value"))


def verify(claims: DataFrame, evidence: DataFrame, anchor: Column | None = None, entail: float = 0.55, support: float = 0.6, nli: Model | None = None) -> DataFrame:
    """Verdicts of claims(claim_id, text, numeric, attribute, value, checkable) over evidence(claim_id, doc_id, source, text, valid_to).

    Evidence is routed beforehand (an equi-join on claim_id), so no claim meets all documents.  With a model `nli` (logits
    of entailment), entailment is the mean of the shared words and the model's probability: neither alone decides.
    Contradictions need shared words either way.
    """
    e = evidence.select("claim_id", "doc_id", F.coalesce("source", F.col("doc_id").cast("string")).alias("source"), F.col("text").alias("etext"), F.col("valid_to").alias("evalid_to"))
    pair = claims.select("claim_id", "text", "numeric", "attribute", "value", "checkable").join(e, "claim_id", "left")
    lex = E.coverage(E.content_tokens(F.col("text")), E.content_tokens(F.col("etext")))
    pair = pair.withColumn("lex", F.coalesce(lex, F.lit(0.0)))
    pair = pair.withColumn("entail", F.col("lex")) if nli is None else _with_model(pair, nli)
    other = claim_value(F.col("etext"), F.col("attribute"))
    names = X.distinct_tokens(F.col("value")), X.distinct_tokens(other)
    person = F.col("attribute").isin(*PERSON_ATTRIBUTES) & (E.attribute(F.col("etext")) == F.col("attribute")) & (F.size(names[0]) > 0) & (F.size(names[1]) > 0) & ~F.arrays_overlap(*names)
    against = (E.differ(F.col("numeric"), E.number(F.col("etext"))) & (F.col("lex") >= 0.4)) | E.polarity_conflict(F.col("text"), F.col("etext"), F.col("lex")) | (person & (F.col("lex") >= 0.4))
    against = F.coalesce(against, F.lit(False))
    old = F.coalesce(F.col("evalid_to") < anchor, F.lit(False)) if anchor is not None else F.lit(False)
    pair = pair.withColumns({"refutes": against, "backs": ~against & (F.col("entail") >= entail) & ~old, "stale": ~against & (F.col("entail") >= entail) & old})
    some = lambda c: F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)) == 1
    per = pair.groupBy("claim_id").agg(
        F.first("checkable").alias("checkable"), F.count("doc_id").alias("n_evidence"), F.max("entail").alias("entailment"), some("backs").alias("backed"), some("refutes").alias("refuted"), some("stale").alias("outdated"),
        F.count_distinct(F.when(F.col("backs"), F.col("source"))).alias("n_independent"),
    )
    verdict = (
        F.when(~F.col("checkable") | (F.col("n_evidence") == 0), "INSUFFICIENT")
        .when(F.col("backed") & F.col("refuted"), "CONFLICTED")
        .when(F.col("refuted"), "REFUTED")
        .when(~F.col("backed") & F.col("outdated"), "TEMPORAL_MISMATCH")
        .when(F.col("backed") & (F.col("entailment") >= support) & (F.col("n_independent") >= 1), "SUPPORTED")
        .otherwise("INSUFFICIENT")
    )
    return per.select("claim_id", verdict.alias("verdict"), "entailment", "n_independent", "n_evidence", "checkable")


def _with_model(pair: DataFrame, nli: Model) -> DataFrame:
    scored = scored_pairs(pair, "text", "etext", nli, "_logit")
    return scored.withColumn("entail", F.when(F.col("_logit").isNull(), F.col("lex")).otherwise(0.5 * F.col("lex") + 0.5 / (1 + F.exp(-F.col("_logit"))))).drop("_logit")


def verdict_measures(verdicts: DataFrame) -> DataFrame:
    """Coverage and rates over checkable claims."""
    share = lambda *names: F.coalesce(F.avg(F.when(F.col("checkable"), F.col("verdict").isin(*names).cast("double"))), F.lit(0.0))
    return verdicts.agg(
        F.count("*").alias("n_claims"), F.count_if("checkable").alias("n_checkable"), share("SUPPORTED").alias("coverage"), share("INSUFFICIENT", "REFUTED").alias("unsupported_rate"), share("CONFLICTED").alias("conflict_rate"), share("TEMPORAL_MISMATCH").alias("stale_rate")
    )


def compare(pairs: DataFrame) -> DataFrame:
    """Conflict type and severity of claim pairs with columns *_a and *_b (subject, attribute, value, numeric, text)."""
    c = lambda name: (F.col(f"{name}_a"), F.col(f"{name}_b"))
    (va, vb), (na, nb), (ta, tb) = c("value"), c("numeric"), c("text")
    x, y, context = X.norm_value(va), X.norm_value(vb), F.concat_ws(" ", ta, tb)
    none = (va == "") | (vb == "") | (c("attribute")[0] != c("attribute")[1])
    none |= (c("subject")[0] != "") & (c("subject")[1] != "") & ~X.same_subject(*c("subject"))
    none |= E.number(va).isNull() & E.number(vb).isNull() & (F.contains(x, y) | F.contains(y, x))
    none |= ~F.coalesce(E.values_differ(va, vb), F.lit(False))
    high, low = F.greatest(F.abs(na), F.abs(nb)), F.least(F.abs(na), F.abs(nb))
    both = na.isNotNull() & nb.isNotNull()
    close = both & ((high - low) / F.greatest(high, F.lit(1e-9)) <= 0.05) & context.rlike(E.ROUNDING)
    kind = F.when(none, "NONE").when(close, "GRANULARITY").when(both & context.rlike(E.SCOPE), "UNRESOLVED_SCOPE").otherwise("FACTUAL")
    severity = F.when(kind == "NONE", 0.0).when(kind == "GRANULARITY", 0.05).when(kind == "UNRESOLVED_SCOPE", 0.4).otherwise(1.0)
    return pairs.withColumns({"conflict_type": kind, "severity": severity})


def contradictions(claims: DataFrame) -> DataFrame:
    """Pairs of usable claims of one subject and attribute, at overlapping times, that contradict each other, with type and severity.

    Claims of equal values make no pairs with each other; only the first claim of each value and period takes part.
    """
    stamp = lambda c: F.try_to_timestamp(c).alias(c)
    rows = usable(claims).select(F.lower(F.trim("subject")).alias("_who"), F.col("attribute").alias("_what"), X.norm_value(F.col("value")).alias("norm"), stamp("valid_from"), stamp("valid_to"), "claim_id", "subject", "attribute", "value", "numeric", "text")
    one = rows.groupBy("_who", "_what", "norm", "valid_from", "valid_to").agg(*[F.min_by(c, "claim_id").alias(c) for c in ("subject", "attribute", "value", "numeric", "text")], F.min("claim_id").alias("claim_id"))
    return compare(overlapping(one, ("_who", "_what"), tie="claim_id").where("norm_a <> norm_b")).where("severity > 0").drop("_who", "_what")


def score_evidence(evidence: DataFrame, ref: Column, domain: str = "government", halflife: float = 240.0) -> DataFrame:
    """Seven factors, score and label for each query of evidence(query_id, source, date, text, value, fresh)."""
    from tidemark.functions.temporal import freshness

    counted = evidence.groupBy("query_id", "value").agg(F.count("*").alias("n")).where("value is not null").groupBy("query_id").agg((F.max("n") / F.sum("n")).alias("agreement"))
    per = evidence.groupBy("query_id").agg(
        F.max(E.authority(F.col("source"), domain)).alias("authority"), F.max(freshness(F.col("date"), ref, F.lit(halflife))).alias("recency"), F.count_distinct("source").alias("n_independent"),
        F.max(E.directness(F.col("text"))).alias("directness"), F.max(E.specificity(F.col("text"))).alias("specificity"), F.avg(F.col("fresh").cast("double")).alias("validity"),
    ).join(counted, "query_id", "left").withColumn("agreement", F.coalesce("agreement", F.lit(1.0)))
    per = per.withColumn("independence", E.independence(F.col("n_independent")))
    scored = per.withColumn("score", E.evidence_score({k: F.col(k) for k in E.FACTOR_WEIGHTS}, F.col("n_independent")))
    return scored.withColumn("label", E.support_label(F.col("score"), F.col("n_independent"), F.col("agreement") < 0.6))


def should_abstain(df: DataFrame) -> Column:
    """Reason to refuse, null to answer: columns n_independent, score, coverage, n_supported, n_stale, has_store_value."""
    return (
        F.when(F.col("n_independent") < 1, "no independent source")
        .when(F.col("score") < 0.3, "evidence too weak")
        .when((F.col("n_supported") == 0) & (F.col("has_store_value") | (F.col("n_stale") > 0)), F.lit(None))
        .when(F.col("n_supported") == 0, "no statement could be verified")
        .when((F.col("n_supported") < 2) & (F.col("coverage") < 0.4), "too few statements verified")
    )

