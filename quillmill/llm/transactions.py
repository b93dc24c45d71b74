"""Reassembly of an interleaved transaction log, and the versions of the store its commits make.

Records are dealt to ranges of the log order, so that counts over the whole log (transactions of a stream, commits)
are sums of whole ranges and a count inside one. The records of a transaction are one sorted array; a higher-order aggregate folds it, carrying
the stack of savepoints, the live changes and those undone. The exploded results feed windows by key, cut into blocks of epochs.
Everything is DataFrame functions; no key, stream or range is gathered in one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Commits of an epoch, and blocks that the epochs of a key are cut into at most.
COMMITS, BLOCKS = 4, 1024
#: Bits that a place in a range of the log takes, as monotonically_increasing_id() has them.
PLACE_BITS = 33


class Reassembled(NamedTuple):
    """undone: kind ('abort' or 'rollback'), seq, by (seq of the record that undoes it, null at the log's end), key.

    versions: key, value, since, until (epochs; until is null while the value stays): what the store holds after each epoch.
    epochs: how many there are.
    """

    undone: DataFrame
    versions: DataFrame
    epochs: int


def _name(c: str) -> Column:
    """A text for any value of a column, null being one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _joined(rows: DataFrame, more: DataFrame, on: list[str]) -> DataFrame:
    """rows with the other columns of more, which has one row for each value of the columns `on`, nulls included."""
    there = more.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in more.columns if c not in on])
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return rows.join(there, match).drop(*[f"_on_{c}" for c in on])


def counted(rows: DataFrame, by: list[str], part: str, order: str, values: list[str]) -> DataFrame:
    """rows with every column of values replaced by its sum over the rows of their group (by) up to their own.

    part rises with order and has a bounded number of values: sums of whole parts are added up, and a window
    adds up inside each.
    """
    totals = rows.groupBy(*by, part).agg(*[F.sum(v).alias(f"_of_{v}") for v in values])
    ahead = Window.partitionBy(*by).orderBy(part)
    before = totals.select(*by, part, *[(F.sum(f"_of_{v}").over(ahead) - F.col(f"_of_{v}")).alias(f"_before_{v}") for v in values])
    inside = Window.partitionBy(*by, part).orderBy(order)
    sums = rows.withColumns({v: F.sum(v).over(inside) for v in values})
    return _joined(sums, before, [*by, part]).withColumns({v: F.col(v) + F.col(f"_before_{v}") for v in values}).drop(*[f"_before_{v}" for v in values])


def in_order(records: DataFrame) -> DataFrame:
    """records with at, their place in the log: by seq, then a hash of the other columns, so that only equal rows may change places."""
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = C.stage(records.withColumn("_tie", F.xxhash64(*[c for c in records.columns if c != "seq"])), "records")
    dealt = marked.repartitionByRange(parts, "seq", "_tie").sortWithinPartitions("seq", "_tie").drop("_tie")
    return C.stage(dealt.withColumn("at", F.monotonically_increasing_id()), "log")


def folded(records: Column, key: str, value: str) -> Column:
    """Of a transaction's sorted records, with key and value of these types: live (the changes that remain), and undone."""
    none = F.array().cast(f"array<struct<seq:bigint,key:{key},value:{value}>>")
    nothing = F.array().cast(f"array<struct<kind:string,seq:bigint,by:bigint,key:{key}>>")

    def state(live: Column, marks: Column, undone: Column) -> Column:
        return F.struct(live.alias("live"), marks.alias("marks"), undone.alias("undone"))

    def gone(kind: str, changes: Column, by: Column) -> Column:
        return F.transform(changes, lambda x: F.struct(F.lit(kind).alias("kind"), x["seq"].alias("seq"), by.alias("by"), x["key"].alias("key")))

    def step(a: Column, r: Column) -> Column:
        live, marks, undone = a["live"], a["marks"], a["undone"]
        mark = F.coalesce(F.try_element_at(marks, F.lit(-1)), F.lit(0))
        back = gone("rollback", F.slice(live, mark + 1, F.size(live)), r["seq"])
        below = F.slice(marks, F.lit(1), F.greatest(F.size(marks) - 1, F.lit(0)))
        change = F.struct(r["seq"].alias("seq"), r["key"].alias("key"), r["value"].alias("value"))
        return (
            F.when(r["op"] == "commit", a)
            .when(r["op"] == "savepoint", state(live, F.concat(marks, F.array(F.size(live))), undone))
            .when(r["op"] == "rollback", state(F.slice(live, F.lit(1), mark), below, F.concat(undone, back)))
            .when(r["op"] == "abort", state(none, marks, F.concat(undone, gone("abort", live, r["seq"]))))
            .otherwise(state(F.concat(live, F.array(change)), marks, undone))
        )

    def finish(a: Column) -> Column:
        ended = F.element_at(records, -1)["op"].isin("commit", "abort")
        rest = gone("abort", a["live"], F.lit(None).cast("long"))
        return F.struct(F.when(ended, a["live"]).otherwise(none).alias("live"), F.when(ended, a["undone"]).otherwise(F.concat(a["undone"], rest)).alias("undone"))

    return F.aggregate(records, state(none, F.array().cast("array<int>"), nothing), step, finish)


def reassemble(records: DataFrame, commits: int = COMMITS) -> Reassembled:
    """What becomes of records(seq, stream, op, key, value), an interleaved log in order of seq (long).

    op is commit, abort, savepoint, rollback, or anything else, null too: a change that gives its key a value, or deletes it if
    the value is null. Each stream (null is one) runs successive transactions, ended by commit, abort or the log's end, which is an abort. A
    rollback undoes the transaction's remaining changes since its latest savepoint (none: its start) and removes that
    savepoint. Commits apply the changes that remain to one store; every `commits` of them, empty ones included, end an epoch, the last one may be
    shorter. A null key is a key. A record without seq has no place in the log and is left out; records of one seq are ordered by a hash of the other columns, equal
    records all count. Values may be very long; they travel with their changes. An empty log gives no rows and no epochs. Other columns, whatever their names, are not read.
    """
    kinds = dict(records.dtypes)
    control = F.coalesce(F.col("op"), F.lit("change"))
    log = in_order(records.where("seq IS NOT NULL").select(F.col("seq").cast("long").alias("seq"), _name("stream").alias("stream"), control.alias("op"), "key", "value"))
    part = F.shiftright("at", PLACE_BITS)
    ends = F.col("op").isin("commit", "abort").cast("long")
    # a transaction's number: the ends before a record in its stream
    numbered = counted(log.withColumns({"part": part, "ended": ends}), ["stream"], "part", "at", ["ended"]).withColumn("number", F.col("ended") - ends)
    whole = F.sort_array(F.collect_list(F.struct("at", "op", "seq", "key", "value")))
    arrays = numbered.groupBy("stream", "number").agg(whole.alias("records"))
    done = C.held(folded(F.col("records"), kinds["key"], kinds["value"]))
    last = F.element_at("records", -1)
    folds = C.stage(arrays.select(done.alias("done"), last["at"].alias("at"), (last["op"] == "commit").alias("committed")), "folds")

    undone = folds.select(F.explode("done.undone").alias("u")).select("u.*")
    rank = counted(folds.where("committed").select("at", part.alias("part"), F.lit(1).cast("long").alias("rank"), "done.live"), [], "part", "at", ["rank"])
    applied = C.stage(rank.select(F.expr(f"(rank - 1) div {int(commits)} + 1").alias("epoch"), "rank", "live"), "applied")
    epochs = applied.agg(F.max("epoch")).first()[0] or 0
    changes = applied.select("epoch", "rank", F.posexplode("live").alias("pos", "change"))
    # of an epoch the last value of each key stays
    newest = changes.groupBy("change.key", "epoch").agg(F.max_by(F.struct("change.value"), F.struct("rank", "pos")).alias("v")).select("key", "epoch", "v.value")
    return Reassembled(undone, _versions(newest, epochs), epochs)


def _versions(newest: DataFrame, epochs: int) -> DataFrame:
    """Each value of newest(key, epoch, value) with the epoch in which another follows: in its block of epochs, or the first of the key's next block."""
    dealt = C.stage(newest.withColumn("block", F.expr(f"epoch div {max(1, -(-epochs // BLOCKS))}")), "newest")
    firsts = dealt.groupBy("key", "block").agg(F.min("epoch").alias("first"))
    next_block = firsts.select("key", "block", F.lead("first").over(Window.partitionBy("key").orderBy("block")).alias("_next"))
    inside = dealt.withColumn("until", F.lead("epoch").over(Window.partitionBy("key", "block").orderBy("epoch")))
    both = _joined(inside, next_block, ["key", "block"])
    return both.where("value IS NOT NULL").select("key", "value", F.col("epoch").alias("since"), F.coalesce("until", "_next").alias("until"))


def states(done: Reassembled, value: Column) -> DataFrame:
    """epoch, n (stored keys), total (sum of value, a long made of the versions' columns) after every epoch."""
    spark = done.versions.sparkSession
    one = done.versions.select(value.cast("long").alias("v"), "since", "until")
    edges = F.explode(F.array(F.struct(F.col("since").alias("epoch"), F.lit(1).cast("long").alias("n"), F.col("v").alias("total")), F.struct(F.col("until").alias("epoch"), F.lit(-1).cast("long").alias("n"), (-F.col("v")).alias("total"))))
    moved = one.select(edges.alias("e")).select("e.*").where("epoch IS NOT NULL").groupBy("epoch").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    every = spark.range(1, done.epochs + 1).select(F.col("id").alias("epoch")).join(moved, "epoch", "left").select("epoch", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))
    dealt = every.withColumn("part", F.expr(f"epoch div {max(1, -(-done.epochs // BLOCKS))}"))
    return counted(dealt, [], "part", "epoch", ["n", "total"]).select("epoch", "n", "total")


def document_log(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as records: what a record does, and its key, follow from crc32 of the decimal doc_id; the value is crc32 of `key:text`, null for a null text or a document labelled toxic."""
    h = F.crc32(F.col("doc_id").cast("string"))
    kind = F.col("h") % 23
    op = F.when(kind <= 1, "commit").when(kind == 2, "abort").when(kind <= 4, "savepoint").when(kind <= 6, "rollback").otherwise("change")
    key = F.expr("(h div 100) % 300")
    stored = F.crc32(F.concat(F.col("key").cast("string"), F.lit(":"), F.col("text")))
    narrow = docs.select("doc_id", "source", "text", h.alias("h")).withColumns({"op": op, "key": key}).select("doc_id", "source", "op", "key", F.when(F.col("op") == "change", stored).alias("value"))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("_id")).distinct()
    value = F.when(F.col("_id").isNull(), F.col("value"))
    return narrow.join(toxic, F.col("doc_id") == F.col("_id"), "left").select(F.col("doc_id").alias("seq"), F.col("source").alias("stream"), "op", "key", value.alias("value"))


def op12_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State digests of every epoch, and every undone change."""
    done = reassemble(document_log(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")))
    after = states(done, F.col("value")).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", F.col("total").alias("value"))
    return after.unionByName(done.undone.select("kind", F.col("seq").alias("id"), F.col("by").alias("n"), F.col("key").cast("long").alias("value")))


ORACLE: dict[str, str] = {}
