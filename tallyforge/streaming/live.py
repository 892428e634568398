"""The live path: landed snapshots as a stream, latest state per contest, first-seen times, totals that follow the changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators.live import latest
from tallyforge.streaming.state import State, micros, newer


def landed(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Snapshots that land in a folder as Parquet."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def pages_until_failure(pages: DataFrame, run: str = "run", number: str = "page", status: str = "status", limit: int = 20) -> DataFrame:
    """The pages of each run up to the first that failed or is missing, no more than `limit`; pages count from 1.

    A run's landed pages (any status but 200 is a failure) are reduced to the first bad number by partial minima, and to how
    many good ones there are before it, which tells a gap.
    """
    have = pages.where(F.col(number).between(1, limit))
    bad = have.groupBy(run).agg(F.coalesce(F.min(F.when(F.coalesce(F.col(status) != 200, F.lit(True)), F.col(number))), F.lit(limit + 1)).alias("_bad"), F.collect_set(number).alias("_have"))
    # At most `limit` numbers a run.
    gap = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(limit + 1)), F.col("_have").cast("array<int>")))
    stop = bad.select(F.col(run).alias("_run"), F.least("_bad", gap).alias("_stop"))
    return have.join(stop, have[run].eqNullSafe(F.col("_run"))).where(F.col(number) < F.col("_stop")).drop("_run", "_stop")


def latest_state(spark: SparkSession, folder: str, schema: str, key: str, at: str, tie: str, **more) -> State:
    """A state that keeps the newest row of each key by (at, tie)."""
    return State(spark, folder, schema, key, merge=newer(at, tie), **more)


def upsert_latest(state: State, at: str, tie: str, source: str = "stream", good: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that lands the newest good row of each key; a batch without one leaves the state as it is."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch if good is None else batch.where(F.coalesce(good, F.lit(False)))
        if not batch.isEmpty():
            clock = batch.agg(F.max(micros(F.col(at)))).first()[0] if state.until else None
            state.commit(latest(batch, state.key, at, tie), source=source, batch=number, clock=clock)

    return run


def first_seen_state(spark: SparkSession, folder: str, key: str, key_type: str, at_type: str, tie_type: str) -> State:
    """Per key: its last row, and when its current run of declared rows began (null outside a run)."""

    def merge(old: Column, new: Column) -> Column:
        began = F.when(new["broke"], new["declared_at"]).otherwise(F.coalesce(old["declared_at"], new["declared_at"]))
        return F.struct(new[key].alias(key), new["last_at"].alias("last_at"), new["last_tie"].alias("last_tie"), began.alias("declared_at"), new["broke"].alias("broke"))

    return State(spark, folder, f"{key} {key_type}, last_at {at_type}, last_tie {tie_type}, declared_at {at_type}, broke boolean", key, merge)


def first_seen(state: State, at: str, declared: str, tie: str, source: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch that keeps per key when its current run of declared rows began; a row that isn't declared ends it.

    Rows of a batch are taken in time order, batches as they come.
    """

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        key, place = state.key, F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"))
        # Later than the last break inside the batch, the earliest declared row starts the run.
        b = batch.groupBy(key).agg(F.max(F.when(~F.col(declared), place)).alias("_broke"), F.max(place).alias("_last"))
        rows = batch.join(b, key).where(F.col(declared) & (F.col("_broke").isNull() | (place > F.col("_broke"))))
        new = b.join(rows.groupBy(key).agg(F.min(at).alias("declared_at")), key, "left")
        new = new.select(key, F.col("_last.at").alias("last_at"), F.col("_last.tie").alias("last_tie"), "declared_at", F.col("_broke").isNotNull().alias("broke"))
        state.commit(new, source=source, batch=number)

    return run


class Summary:
    """Contests, declared ones and sums per group, and the closest contests, kept up by what each commit of a state changed.

    The row that a changed key had goes out of the totals and its new one comes in. Of the closest, `spare` times k are
    held with the place up to which they are known whole; while k are left of them the list needs no look at the state,
    and it is read again from the state when fewer are. Rows that end by the clock alone aren't told, so the state must
    have no `until`.
    """

    def __init__(self, state: State, folder: str, group: str, sums: dict[str, Callable[[Column], Column]], margin: str, counts: Callable[[Column], Column], k: int = 10, spare: int = 4) -> None:
        self.state, self.group, self.sums, self.margin, self.counts, self.k, self.spare = state, group, sums, margin, counts, k, spare
        kind = state.schema[group].dataType.simpleString()
        add = lambda old, new: F.struct(old[group].alias(group), *[(old[c] + new[c]).alias(c) for c in ("contests", *sums)])
        self.totals = State(state.spark, folder, f"{group} {kind}, contests long, " + ", ".join(f"{c} long" for c in sums), group, add)

    def _deltas(self, rows: DataFrame) -> DataFrame:
        """Rows (sign, row) as changes of the groups' totals."""
        have = rows.where(F.col("row").isNotNull()).select("sign", "row", F.col("row")[self.group].alias(self.group))
        sums = [F.sum(F.col("sign") * F.coalesce(make(F.col("row")).cast("long"), F.lit(0))).alias(c) for c, make in self.sums.items()]
        return have.groupBy(self.group).agg(F.sum("sign").alias("contests"), *sums)

    def update(self, version: int) -> None:
        """Takes in what a commit of the state changed; one that is in already changes nothing. A reset empties the totals."""
        if self.state.snapshot(version)["kind"] == "reset":
            self.totals.reset()
            return
        changes = self.state.changes(version)
        sides = F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("sign"), F.col("old").alias("row")), F.struct(F.lit(1).cast("long").alias("sign"), F.col("new").alias("row"))))
        delta = self._deltas(changes.select(sides.alias("x")).select("x.*"))
        self.totals.commit(delta, source="summary", batch=version, meta={"top": self._top(changes, version)})

    def of_run(self, version: int) -> DataFrame:
        """The totals over the rows that a commit brought alone."""
        return self._deltas(self.state.changes(version).select(F.lit(1).cast("long").alias("sign"), F.col("new").alias("row")))

    def _places(self, rows: DataFrame) -> DataFrame:
        row = F.col("row")
        return rows.where(row.isNotNull()).where(self.counts(row)).select(row[self.margin].cast("long").alias("margin"), row[self.state.key].alias("id"))

    def _first(self, places: DataFrame) -> list[list]:
        return [[r["margin"], r["id"]] for r in places.orderBy("margin", "id").limit(self.k * self.spare).collect()]

    def _top(self, changes: DataFrame, version: int) -> dict:
        """The closest contests known, in order, and whether there are none beside them; bounded by k * spare."""
        size, held = self.k * self.spare, (self.totals.snapshot()["meta"] or {}).get("top")
        if held:
            ids, last = [i for _, i in held["rows"]], held["rows"][-1] if held["rows"] else None
            touched = {r[0] for r in changes.where(F.col(self.state.key).isin(ids)).select(self.state.key).collect()} if ids else set()
            rows = [x for x in held["rows"] if x[1] not in touched]
            new = self._places(changes.select(F.col("new").alias("row")))
            if not held["whole"]:
                # Beyond the last one held, others may lie that are not known here.
                new = new.where((F.col("margin") < last[0]) | ((F.col("margin") == last[0]) & (F.col("id") <= F.lit(last[1])))) if last else new.limit(0)
            rows = sorted(rows + self._first(new))
            whole = held["whole"] and len(rows) <= size
            if whole or len(rows) >= self.k:
                return {"rows": rows[:size], "whole": whole}
        rows = self._first(self._places(self.state.read(version).select(F.struct("*").alias("row"))))
        return {"rows": rows, "whole": len(rows) < size}

    def read(self) -> DataFrame:
        """Totals of the groups that have contests."""
        return self.totals.read().where("contests > 0")

    def tightest(self) -> list[tuple]:
        """(margin, id) of the k closest contests."""
        held = (self.totals.snapshot()["meta"] or {}).get("top") or {"rows": []}
        return [tuple(x) for x in held["rows"][: self.k]]


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what has landed, batch by batch, and stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
