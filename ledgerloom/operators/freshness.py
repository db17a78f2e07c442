"""When an analytical query may run: the groups of its tables, their commit marks, lag, and the query mix."""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefix import running


def tables_of_sql(spark: SparkSession, sql: str) -> list[str]:
    """The tables a statement reads, by Spark's own parser, subqueries included and names of CTEs left out."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    tables: set[str] = set()
    ctes: set[str] = set()

    def items(seq) -> list:  # noqa: ANN001
        return [seq.apply(i) for i in range(seq.size())]

    def walk(node) -> None:  # noqa: ANN001
        name = node.getClass().getSimpleName()
        if name == "UnresolvedRelation":
            tables.add(".".join(items(node.multipartIdentifier())))
        if name == "UnresolvedWith":
            for pair in items(node.cteRelations()):
                ctes.add(pair._1())
                walk(pair._2())
        for child in items(node.children()):
            walk(child)
        for expression in items(node.expressions()):
            inside(expression)

    def inside(expression) -> None:  # noqa: ANN001
        if expression.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "InSubquery", "ListQuery", "LateralSubquery"):
            try:
                walk(expression.plan())
            except Exception:  # an IN has its plan inside its ListQuery child
                walk(expression.query().plan())
        for child in items(expression.children()):
            inside(child)

    walk(plan)
    return sorted(t for t in tables if t not in ctes)


def ready_transaction(queries: DataFrame, timeline: DataFrame) -> DataFrame:
    """(query_id, ready_txn): the first transaction after which every group of the query is at its time or later.

    ``queries``: (query_id, query_time, groups); ``timeline``: (group_id, txn_seq, commit_time),
    whose marks only grow. A group's part is an as-of search: marks and query times are
    merged into one ordered sequence by group, cut into days, and each query takes the next mark. Null
    where a group never gets there.
    """
    wanted = queries.select("query_id", "query_time", F.explode("groups").alias("group_id"))
    # Marks that several transactions share count once, with the first of them.
    marks = timeline.where("commit_time IS NOT NULL").groupBy("group_id", "commit_time").agg(F.min("txn_seq").alias("txn_seq"))
    none = F.lit(None)
    both = marks.select("group_id", F.col("commit_time").alias("at"), "txn_seq", none.cast(queries.schema["query_id"].dataType).alias("query_id"))
    both = both.unionByName(wanted.select("group_id", F.col("query_time").alias("at"), none.cast("bigint").alias("txn_seq"), "query_id"))
    # From the end backwards, the least transaction at the query's time or later: at one time marks come before queries.
    back = [F.desc("at"), F.desc_nulls_last("txn_seq")]
    day = F.datediff(F.lit("9999-12-31").cast("date"), F.to_date("at"))
    searched = running(both, ["group_id"], back, day, {"txn": ("min", F.col("txn_seq"))})
    each = searched.where("query_id IS NOT NULL").select("query_id", "group_id", "txn")
    done = each.groupBy("query_id").agg(F.max("txn").alias("last"), F.count_if(F.col("txn").isNull()).alias("open"))
    return queries.join(done, "query_id", "left").withColumn("ready_txn", F.when(F.col("open") == 0, F.col("last"))).drop("last", "open")


def waits(queries: DataFrame, high_water: DataFrame) -> DataFrame:
    """``queries`` with commit_time (the least mark of its groups) and is_fresh (whether that is the query's time or later)."""
    wanted = queries.select("query_id", F.explode("groups").alias("group_id"))
    marks = wanted.join(high_water.select("group_id", "commit_time"), "group_id", "left")
    least = marks.groupBy("query_id").agg(F.min("commit_time").alias("commit_time"), F.count_if(F.col("commit_time").isNull()).alias("_open"))
    out = queries.join(least, "query_id", "left")
    return out.withColumn("commit_time", F.when(F.col("_open") == 0, F.col("commit_time"))).withColumn("is_fresh", F.coalesce(F.col("commit_time") >= F.col("query_time"), F.lit(False))).drop("_open")


def round_robin(mix: DataFrame) -> DataFrame:
    """``mix`` (query_id, freq, ...): each query freq / gcd(all freqs) times, with its repetition from 1."""
    freqs = [r[0] for r in mix.select("freq").distinct().collect()]  # configuration
    unit = reduce(gcd, freqs, 0) or 1
    return mix.withColumn("repetition", F.explode(F.sequence(F.lit(1), (F.col("freq") / unit).cast("int"))))


def query_lag(arrivals: DataFrame, timeline: DataFrame, ahead: int = 50_000, extra_us: int = 3000) -> DataFrame:
    """Lag of queries: until each of its groups has committed ``ahead`` transactions more than at its arrival.

    ``arrivals``: (query_id, at_txn, groups); ``timeline``: (group_id, txn_seq, finish_us).
    """
    wanted = arrivals.select("query_id", "at_txn", F.explode("groups").alias("group_id"))
    now = timeline.select("group_id", F.col("txn_seq").alias("at_txn"), F.col("finish_us").alias("_from"))
    then = timeline.select("group_id", (F.col("txn_seq") - ahead).alias("at_txn"), F.col("finish_us").alias("_to"))
    both = wanted.join(now, ["group_id", "at_txn"], "left").join(then, ["group_id", "at_txn"], "left")
    each = both.groupBy("query_id").agg(F.max(F.col("_to") - F.col("_from")).alias("_lag"), F.count_if(F.col("_to").isNull()).alias("_open"))
    return arrivals.join(each, "query_id", "left").withColumn("lag_us", F.when(F.col("_open") == 0, F.col("_lag") + extra_us)).drop("_lag", "_open")


def admitted(n_txns: Column, rate: float = 14.4) -> Column:
    """How many queries were admitted by the time a group had committed ``n_txns``: the earlier arrival rule."""
    return F.floor(n_txns / rate)
