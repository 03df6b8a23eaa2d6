"""Secret scan with multipart credential linking, on DataFrame functions alone.

Strong findings (`assign`, `access`, `hex`) are reported wherever they stand.  Weak candidates say little
alone and are reported only where complementary parts stand within `scope` characters of each other in a
document: an `ident` (user or client names) next to a secret, an `opaque` token next to an identifier, an
`endpoint` next to both.  The interval join is a pass over each document's candidates in order of start:
running maxima of ends before and minima of starts after tell how near the nearest part of each role is,
so no pairs are made and a document with many candidates costs no more than sorting them.

Java's regular expressions give no offsets; the lengths of matches and of what `split` leaves between them,
summed in order, are the offsets in code points.  All work on a text's matches is sorting and running sums, so
it grows in proportion to them, however many one text has.  Texts are scanned once, the lengths are staged with
a row number of their own, and only rows that have any go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import documents_of, staged, unused

# Patterns and shortest lengths of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

IDENT = r"""(?i:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[A-Z0-9+/_=-]*+[a-z])(?=[a-z0-9+/_=-]*+[A-Z])[A-Za-z0-9+/_=-]{16,}+"
ENDPOINT = r"""(?i:https?|s?ftp|ssh|amqps?|jdbc:[a-z]+|mysql|postgres(?:ql)?|mongodb|redis)://[^\s"'<>]{4,}"""

KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
BASE = KINDS[:3]
_SECRET, _NAME = ("assign", "hex", "opaque"), ("access", "ident")
_MATCHES = "array<struct<rank:int,gap:int,size:int,good:boolean>>"
_BLOCK = 1024


def _matches(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """Lengths of the leftmost non-overlapping matches and of what stands before each; of `assign`, is its value long enough?"""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else whole
    parts = F.arrays_zip(whole.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("gap"))
    one = lambda x: F.struct(F.lit(KINDS.index(kind)).alias("rank"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("size"), (F.length(x["v"]) >= least).alias("good"))
    found = F.transform(F.filter(parts, lambda x: x["m"].isNotNull()), one)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_MATCHES))


def candidates(docs: DataFrame, keep: list[str], row: str = "row", found: str = "found") -> DataFrame:
    """The columns `keep`, a number for each row and its matches, staged; parts that can't be linked aren't looked for."""
    none, text = F.array().cast(_MATCHES), F.coalesce(docs["text"].cast("string"), F.lit(""))
    names = {k: unused(f"{k}_", docs) for k in KINDS}
    name = lambda k: F.col(names[k])
    some = lambda k: F.exists(name(k), lambda x: x["good"])
    rows = docs.withColumns(
        {
            names["assign"]: _matches(text, ASSIGN, "assign", ASSIGN_LEAST),
            names["access"]: F.when(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS, "access")).otherwise(none),
            names["hex"]: _matches(text, HEX, "hex"),
            names["ident"]: _matches(text, IDENT, "ident"),
        }
    )
    named, text = some("access") | some("ident"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.withColumn(names["opaque"], F.when(named, _matches(text, OPAQUE, "opaque")).otherwise(none))
    secret = some("assign") | some("hex") | some("opaque")
    rows = rows.withColumn(names["endpoint"], F.when(named & secret, _matches(text, ENDPOINT, "endpoint")).otherwise(none))
    every = F.concat(*map(name, KINDS))
    return staged(rows.select(F.monotonically_increasing_id().alias(row), *[rows[c] for c in keep], F.when(F.size(every) > 0, every).alias(found)), "candidates")


def link(found: DataFrame, scope: int = 200) -> DataFrame:
    """(row, found) to (row, spans): the base spans and the weak ones that link, in order, each with `upto`, the furthest end before it."""
    each = found.select("row", F.posexplode("found").alias("nth", "m")).select("row", "nth", "m.*")
    of_kind = Window.partitionBy("row", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(of_kind).cast("int"))
    each = each.where("good").select("row", "rank", (F.col("end") - F.col("size")).alias("start"), "end")
    order = Window.partitionBy("row").orderBy("start", "rank", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # what follows, read backwards: frames that only grow cost one step a row
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)

    def gap(kinds: tuple[str, ...]) -> Column:
        """Characters to the nearest span of these kinds, below 0 for an overlap; null without one."""
        of = F.col("rank").isin([KINDS.index(k) for k in kinds])
        back = F.col("start") - F.max(F.when(of, F.col("end"))).over(before)
        return F.least(back, F.min(F.when(of, F.col("start"))).over(after) - F.col("end"))

    each = each.withColumns({"to_base": gap(BASE), "to_secret": gap(_SECRET), "to_name": gap(_NAME)})
    free = F.coalesce(F.col("to_base") >= 0, F.lit(True))
    near = lambda c: F.coalesce(F.col(c) <= scope, F.lit(False))
    kind = lambda k: F.col("rank") == KINDS.index(k)
    linked = (kind("ident") & near("to_secret")) | (kind("opaque") & near("to_name")) | (kind("endpoint") & near("to_secret") & near("to_name"))
    reported = each.where((F.col("rank") < len(BASE)) | (free & linked)).withColumn("upto", F.coalesce(F.max("end").over(before), F.lit(0)))
    return reported.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "upto"))).alias("spans"))


def _shown(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Findings of every row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Spans are kind:start:end in code points, by start, then kind in the order of `KINDS`.  A null text is empty;
    a text without findings has counts of 0 and empty spans; repeated rows are repeated; a null doc_id stays;
    other columns are ignored; an empty table gives no rows.
    """
    rows = candidates(documents_of(docs), ["doc_id"])
    got = rows.select("row", "doc_id").join(link(rows.where("found is not null"), scope), "row", "left")
    got = got.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,end:int,upto:int>>")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == KINDS.index(k))).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return got.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_shown(base), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, scope: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """The input rows, each finding in `text` replaced by `mark` (overlapping findings by one); n_chars, where there is one, follows.

    Rows are staged once with what was found in them; those without findings pass unchanged and unshuffled.  A
    null text stays null, rows may repeat or share a doc_id or have none, and other columns stay as they are.
    """
    row, found = unused("row", docs), unused("found", docs)
    rows = candidates(docs, docs.columns, row, found)
    some = staged(link(rows.where(F.col(found).isNotNull()).select(F.col(row).alias("row"), F.col(found).alias("found")), scope), "spans")
    spans, blocks = unused("spans", docs), unused("blocks", docs)
    hit = rows.where(F.col(found).isNotNull()).join(some.select(F.col("row").alias(row), F.col("spans").alias(spans)), row)
    hit = hit.withColumn(blocks, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)))

    def cut(a: Column, b: Column) -> Column:
        """Code points a to b, taken from the blocks that hold them."""
        first = F.floor(a / _BLOCK).cast("int")
        held = F.array_join(F.slice(F.col(blocks), first + 1, F.floor(b / _BLOCK).cast("int") - first + 1), "")
        return F.substring(held, a - first * _BLOCK + 1, b - a)

    shown = F.filter(F.col(spans), lambda s: s["start"] >= s["upto"])
    pieces = F.transform(shown, lambda s: F.concat(cut(s["upto"], s["start"]), F.lit(mark)))
    last = F.array_max(F.transform(F.col(spans), lambda s: s["end"]))
    hit = hit.withColumn("text", F.concat(F.array_join(pieces, ""), cut(last, F.length("text"))))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    clean = rows.where(F.col(found).isNull())
    left = rows.where(F.col(found).isNotNull()).join(some.select(F.col("row").alias(row)), row, "left_anti")
    return clean.select(docs.columns).unionByName(left.select(docs.columns)).unionByName(hit.select(docs.columns))
