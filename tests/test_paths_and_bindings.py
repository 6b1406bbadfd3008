"""Paths with ``..`` and bindings that name other bindings."""

import posixpath

from pyspark.sql import functions as F

from armada.functions.naming import clean_path, content_path, escapes_mount
from armada.operators.bindings import cycles, references, resolve_bindings
from armada.session import pin


def plain_clean(path):
    done = posixpath.normpath(path) if path else "."
    return "/" + done.lstrip("/") if path.startswith("/") else done


def test_paths_are_cleaned(spark):
    paths = [
        "", "/", ".", "..", "/..", "a", "a/", "/a//b/./c", "a/b/../c", "a/../..", "../a/../../b", "/../../a", "/a/../../b/", "//a",
        "a/./../b//", "/kubedoop/app/git-0/current/", "...", "a/.../b", "..a/b..", "/a/b/c/../../../..",
    ]
    table = spark.createDataFrame([(p,) for p in paths], "p string").repartition(2)
    assert {r.p: r.c for r in table.select("p", clean_path(F.col("p")).alias("c")).collect()} == {p: plain_clean(p) for p in paths}
    assert spark.range(1).select(clean_path(F.lit(None).cast("string")).alias("c")).first().c is None


def test_content_paths(spark):
    mount = "/app/git-0"
    cases = {
        "/": ("/app/git-0/current", False), "": ("/app/git-0/current", False), None: ("/app/git-0/current", False),
        "/nar": ("/app/git-0/current/nar", False), "a/../b/": ("/app/git-0/current/b", False), "..": ("/app/git-0", False),
        "../../git-1": ("/app/git-1", True), "../../git-01": ("/app/git-01", True), "../../../../etc": ("/etc", True), "../..": ("/app", True),
    }
    table = spark.createDataFrame([(f,) for f in cases], "f string")
    got = table.select("f", content_path(mount, F.col("f")).alias("p"), escapes_mount(mount, F.col("f")).alias("e")).collect()
    assert {r.f: (r.p, r.e) for r in got} == cases
    assert not spark.range(1).select(escapes_mount("/", F.lit("../../x")).alias("e")).first().e


def mark(name):
    return '{{ getenv "%s" }}' % name


ROWS = [
    ("c", "A", "1"), ("c", "B", f"{mark('A')}{mark('A')}-"), ("c", "C", f"<{mark('B')}|{mark('A')}>"), ("c", "D", f"{mark('C')}{mark('GONE')}"),
    ("c", "E", mark("D")), ("c", "X", mark("Y")), ("c", "Y", f"{mark('Z')} {mark('A')}"), ("c", "Z", mark("X")), ("c", "S", mark("S")),
    ("c", "W", f"{mark('X')} {mark('A')}"), ("c", "N", None), ("c", "M", mark("N")), ("d", "A", "other"), ("d", "B", mark("A")),
    ("d", "X", "plain"), (None, "A", "no cluster"), (None, "B", mark("A")),
]


def test_bindings_are_resolved(spark):
    table = spark.createDataFrame([*ROWS, ROWS[1]], "cluster string, name string, value string").repartition(3)
    got = {(r.cluster, r.name): (r.value, r.depth, r.state, r.unresolved) for r in resolve_bindings(table, "cluster").collect()}
    assert got == {
        ("c", "A"): ("1", 0, "resolved", []), ("c", "B"): ("11-", 1, "resolved", []), ("c", "C"): ("<11-|1>", 2, "resolved", []),
        ("c", "D"): (f"<11-|1>{mark('GONE')}", 3, "unbound", ["GONE"]), ("c", "E"): (f"<11-|1>{mark('GONE')}", 4, "unbound", ["GONE"]),
        ("c", "X"): (mark("Y"), None, "cycle", ["Y"]), ("c", "Y"): (f"{mark('Z')} {mark('A')}", None, "cycle", ["A", "Z"]),
        ("c", "Z"): (mark("X"), None, "cycle", ["X"]), ("c", "S"): (mark("S"), None, "cycle", ["S"]),
        ("c", "W"): (f"{mark('X')} {mark('A')}", None, "blocked", ["A", "X"]), ("c", "M"): (mark("N"), 0, "unbound", ["N"]),
        ("d", "A"): ("other", 0, "resolved", []), ("d", "B"): ("other", 1, "resolved", []), ("d", "X"): ("plain", 0, "resolved", []),
    }


def test_long_cycles_and_chains(spark):
    chain = [("c", f"n{i}", f"n{i + 1}") for i in range(40)]
    ring = [("c", f"r{i}", f"r{(i + 1) % 23}") for i in range(23)] + [("c", "n40", "r3"), ("d", "n1", "n0"), ("c", "r5", "n90")]
    graph = spark.createDataFrame(chain + ring, "cluster string, name string, other string")
    assert {(r.cluster, r.name) for r in cycles(graph, "cluster").collect()} == {("c", f"r{i}") for i in range(23)}
    none = spark.createDataFrame([], "cluster string, name string, value string")
    assert references(none, "cluster").count() == 0 and resolve_bindings(none, "cluster").count() == 0


def test_bindings_are_never_broadcast(spark, monkeypatch, tmp_path):
    # Spark expects few rows of these frames, for they come of small files; a broadcast would hold all of them in each task.
    plans = []

    def planned(frame):
        plans.append(frame._jdf.queryExecution().sparkPlan().toString())
        return pin(frame)

    monkeypatch.setattr("armada.operators.bindings.pin", planned)
    spark.createDataFrame(ROWS, "cluster string, name string, value string").write.parquet(str(tmp_path / "rows"))
    table = spark.read.parquet(str(tmp_path / "rows"))
    plans.append(resolve_bindings(table, "cluster")._jdf.queryExecution().sparkPlan().toString())
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]
