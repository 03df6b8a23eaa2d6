"""The bitemporal fold on a stream whose facts may arrive in any order.

Each fact key keeps, as keyed state, its assertions, the versions they fold to, and a base:
versions of assertions that nothing can come before any more.  Assertions that come after all folded ones go on
from the versions; an earlier one folds again from the base.  Either way the versions are those that
`bitemporal.assert_facts` gives for the same assertions, whatever the order of arrival and the bounds of batches.
What is emitted are changes: rows of `CHANGES`, of which the last revision of each (key, n) holds.

With a bound on lateness, a timer of each key folds what the watermark has passed into the base and drops it from
the state; later assertions than that are left out, as with any watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.bitemporal import KEY, VERSION, VersionFold, assertions, facts_in, stamped

CHANGES = "entity string, attribute string, n long, revision long, gone boolean, seq long, value string, valid_from long, valid_to long, recorded_at long, superseded_at long, source_id string, evidence_ids array<string>, confidence double, change_kind string, previous_value string"
_COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state of several parts needs the RocksDB store; a session that names one keeps it."""
    if "RocksDB" not in (spark.conf.get(_STORE, None) or ""):
        spark.conf.set(_STORE, _ROCKS)


class _Fold(StatefulProcessor):
    """State of a key: `facts` (a list of each batch's) and `base` as described above, `versions`, and a count of revisions with the last assertion folded.

    All are packed, so that a batch takes a few calls of the store for each key, however many facts it brings.
    """

    def __init__(self, bitemporal: bool, expires: bool) -> None:
        self.bitemporal, self.expires = bitemporal, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getListState("facts", "packed string")
        self.base = handle.getValueState("base", "packed string")
        self.versions = handle.getValueState("versions", "packed string")
        self.last = handle.getValueState("last", "recorded_at long, seq long, revision long")

    def close(self) -> None:
        pass

    @staticmethod
    def _at(fact: dict) -> tuple[int, int]:
        return fact["recorded_at"], fact["seq"]

    @staticmethod
    def _held(state) -> list[dict]:
        got = state.get()
        return json.loads(got[0]) if got else []

    def _facts(self) -> list[dict]:
        return sorted((f for row in self.facts.get() for f in json.loads(row[0])), key=self._at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        top, revision = ((last[0], last[1]), last[2]) if last else (None, 0)
        new: dict[tuple[int, int], dict] = {}
        for frame in rows:
            for fact in facts_in(frame):
                new.setdefault(self._at(fact), fact)  # the same assertion twice is one
        late = top is not None and bool(new) and min(new) <= top
        held = self._facts() if late else []
        for fact in held:
            new.pop(self._at(fact), None)
        if not new:
            return
        fresh = sorted(new.values(), key=self._at)
        self.facts.appendValue((json.dumps(fresh),))
        before = self._held(self.versions)
        if not late:
            fold, todo = VersionFold(self.bitemporal, before), fresh
        else:
            fold, todo = VersionFold(self.bitemporal, self._held(self.base)), sorted([*held, *fresh], key=self._at)
        for fact in todo:
            fold.take(fact)
        self.last.update((*max(self._at(fresh[-1]), top or self._at(fresh[-1])), revision + 1))
        if self.expires:
            for fact in fresh:
                self.handle.registerTimer(fact["recorded_at"] // 1000 + 1)
        after = fold.versions
        changed = [(n, v) for n, v in enumerate(after) if n >= len(before) or before[n] != v]
        changed += [(n, None) for n in range(len(after), len(before))]
        if changed:
            self.versions.update((json.dumps(after),))
            yield _frame(key, changed, revision + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Fold what the watermark has passed into the base; nothing changes for readers."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._facts()
        settled = [f for f in held if f["recorded_at"] < passed]
        if settled:
            fold = VersionFold(self.bitemporal, self._held(self.base))
            for fact in settled:
                fold.take(fact)
            self.base.update((json.dumps(fold.versions),))
            rest = held[len(settled) :]
            if rest:
                self.facts.put([(json.dumps(rest),)])
            else:
                self.facts.clear()
        return iter(())


def _frame(key: tuple, changed: list[tuple[int, dict | None]], revision: int) -> pd.DataFrame:
    none = dict.fromkeys(VERSION)
    rows = [{**(v or none), "entity": key[0], "attribute": key[1], "n": n, "revision": revision, "gone": v is None} for n, v in changed]
    return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in _COLUMNS})


def fold_stream(facts: DataFrame, mode: str = "reference", late: str | None = None) -> DataFrame:
    """Changes of versions for a stream of facts (the columns of `assert_facts`), to be written in append mode.

    `late` (as "30 days") bounds how much earlier than the latest recorded_at an assertion may come, and with it
    the state of a key; without it all assertions stay in the state.  Facts without entity, attribute or
    recorded_at are left out: they have no key or no place in the order.
    """
    use_keyed_state(facts.sparkSession)
    good = facts.where("entity is not null and attribute is not null and recorded_at is not null and seq is not null")
    rows = assertions(good).withColumn("value", F.col("value").cast("string"))
    if late is not None:
        rows = rows.withColumn("_at", F.timestamp_micros("recorded_at")).withWatermark("_at", late)
    processor = _Fold(mode == "bitemporal", late is not None)
    return rows.groupBy(*KEY).transformWithStateInPandas(processor, CHANGES, "Append", "None" if late is None else "EventTime")


def versions_of(changes: DataFrame) -> DataFrame:
    """The versions that the changes amount to, as `assert_facts` gives them: the last revision of each place."""
    rest = [c for c in _COLUMNS if c not in (*KEY, "n")]
    last = changes.groupBy(*KEY, "n").agg(F.max_by(F.struct(*rest), "revision").alias("v")).select(*KEY, "v.*")
    return stamped(last.where("not gone").select(*VERSION))
