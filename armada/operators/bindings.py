"""Bindings whose values name other bindings of the same cluster.

All joins here shuffle: the rows are many more than the files they come from let Spark expect (a cluster has
any number of bindings), and a broadcast planned on that would put all of them in the memory of each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armada.operators.rendering import PLACEHOLDER, expand_templates
from armada.session import pin

MOST_ROUNDS = 62


def references(bindings: DataFrame, cluster: str, name: str = "name", value: str = "value") -> DataFrame:
    """(cluster, name, other): which binding's value names which other."""
    marks = F.regexp_extract_all(F.coalesce(F.col(value), F.lit("")), F.lit(PLACEHOLDER), F.lit(0))
    other = F.explode(F.array_distinct(F.transform(marks, lambda m: F.substring_index(F.substring_index(m, '"', 2), '"', -1))))
    return bindings.select(cluster, name, other.alias("other"))


def _same(cluster: str, left: Column, right: Column) -> Column:
    return F.col(cluster).eqNullSafe(F.col("_c")) & (left == right)


def cycles(graph: DataFrame, cluster: str, name: str = "name") -> DataFrame:
    """(cluster, name) of bindings that name themselves, at once or through others.

    Paths are doubled: after round k every pair joined by at most 2^k steps is known, so long chains take
    few rounds. Only what leads on and is led to can lie on a cycle; the rest is taken out before each
    round, so chains that end shrink away and what is left are the cycles and the ways between them.
    """
    paths = pin(graph.select(cluster, name, "other").distinct())
    for _ in range(MOST_ROUNDS):
        starts = paths.select(F.col(cluster).alias("_c"), F.col(name).alias("_n")).distinct()
        ends = paths.select(F.col(cluster).alias("_c"), F.col("other").alias("_n")).distinct()
        inner = paths.join(_shuffled(starts), _same(cluster, F.col("other"), F.col("_n")), "left_semi")
        inner = pin(inner.join(_shuffled(ends), _same(cluster, F.col(name), F.col("_n")), "left_semi"))
        on = inner.select(F.col(cluster).alias("_c"), F.col(name).alias("_n"), F.col("other").alias("_to"))
        longer = inner.join(_shuffled(on), _same(cluster, F.col("other"), F.col("_n"))).select(cluster, name, F.col("_to").alias("other"))
        paths = pin(inner.union(longer).distinct())
        if paths.count() == inner.count():  # every way is known
            return paths.filter(F.col(name) == F.col("other")).select(cluster, name)
    raise RuntimeError("the references did not settle")


def resolve_bindings(bindings: DataFrame, cluster: str, order: list[str] | None = None, name: str = "name", value: str = "value") -> DataFrame:
    """J2 over bindings that name others: (cluster, name, value, depth, state, unresolved).

    ``{{ getenv "X" }}`` in a value stands for the cluster's binding of X, which may name others in turn. A
    binding is settled once those it names are: round k settles the chains of k steps, ``depth`` is that k.
    ``state`` is ``resolved``; ``unbound`` where a name, its own or of one it stands on, has no binding (the
    mark stays in the text); ``cycle`` where the binding lies on a cycle; ``blocked`` where it stands on one:
    these two keep their own text. Of several bindings of one name the last by ``order`` counts. Rows without
    cluster, name or value are no bindings.
    """
    pick = F.max_by(value, F.struct(*order)) if order else F.max(value)
    one = pin(bindings.dropna("any", None, [cluster, name, value]).groupBy(cluster, name).agg(pick.alias(value)))
    names = one.select(F.col(cluster).alias("_c"), F.col(name).alias("_n"))
    graph = references(one, cluster, name, value)
    bound = pin(graph.join(_shuffled(names), _same(cluster, F.col("other"), F.col("_n")), "left_semi"))

    waiting = bound.select(cluster, name).distinct()
    settled = pin(one.join(_renamed(waiting, cluster, name), _same(cluster, F.col(name), F.col("_n")), "left_anti").withColumn("depth", F.lit(0)))
    total, depth = settled.count(), 0
    open_rows = pin(one.join(_renamed(settled, cluster, name), _same(cluster, F.col(name), F.col("_n")), "left_anti"))
    while True:
        depth += 1
        held = bound.join(_renamed(settled, cluster, name), _same(cluster, F.col("other"), F.col("_n")), "left_anti").select(cluster, name).distinct()
        ready = open_rows.join(_renamed(held, cluster, name), _same(cluster, F.col(name), F.col("_n")), "left_anti")
        done = expand_templates(ready, settled, cluster, [name], body=value, env_name=name, env_value=value)
        settled = pin(settled.unionByName(done.drop("unresolved").withColumn("depth", F.lit(depth))))
        open_rows = pin(open_rows.join(_renamed(settled, cluster, name), _same(cluster, F.col(name), F.col("_n")), "left_anti"))
        before, total = total, settled.count()
        if total == before:
            break
    round_trips = _renamed(cycles(bound.join(_renamed(open_rows, cluster, name), _same(cluster, F.col(name), F.col("_n")), "left_semi"), cluster, name), cluster, name)
    stuck = open_rows.join(round_trips.withColumn("_on", F.lit(True)), _same(cluster, F.col(name), F.col("_n")), "left").select(
        cluster, name, value, F.lit(None).cast("int").alias("depth"), F.when(F.col("_on"), "cycle").otherwise("blocked").alias("state")
    )
    left = F.array_distinct(F.transform(
        F.regexp_extract_all(F.col(value), F.lit(PLACEHOLDER), F.lit(0)),
        lambda m: F.substring_index(F.substring_index(m, '"', 2), '"', -1),
    ))
    ended = settled.select(cluster, name, value, "depth", F.when(F.size(left) > 0, "unbound").otherwise("resolved").alias("state"))
    return ended.unionByName(stuck).withColumn("unresolved", F.array_sort(left))


def _renamed(rows: DataFrame, cluster: str, name: str) -> DataFrame:
    return _shuffled(rows.select(F.col(cluster).alias("_c"), F.col(name).alias("_n")))


def _shuffled(rows: DataFrame) -> DataFrame:
    return rows.hint("shuffle_merge")
