"""Edge cases on hand-made frames: nulls, ties, empty groups and literal values."""

import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from armada.functions import arguments, naming, units
from armada.operators import (
    components,
    drift,
    health,
    lookups,
    rendering,
    rules,
    scraping,
    sequences,
    upkeep,
)
from armada.sources import records, specs
from armada.sources.segments import write_searchable


def rows(df, *order):
    got = df.orderBy(*order) if order else df
    return [tuple(r) for r in got.collect()]


def column(spark, expression, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_durations(spark):
    got = column(
        spark,
        units.duration_ms,
        ["20s", "2m", "1h30m", "30 sec", "2 mins", "500 ms", "7 days", "15 seconds", "1.5s",
         "10 apples", "", None, "20s x", "1h1.5s", "100us", "99999999999999999 days"],
    )
    assert got == [20000, 120000, 5400000, 30000, 120000, 500, 604800000, 15000, 1500,
                   None, None, None, None, 3601500, 0, None]


def test_sizes_and_ratios(spark):
    assert column(spark, units.size_bytes, ["1 MB", "16 KB", "100 MB", "0.5 KB", "x", None]) == [
        2**20, 2**14, 100 * 2**20, 512, None, None]
    assert column(spark, lambda c: units.size_bytes(c, 1000), ["1 MB"]) == [10**6]
    assert column(spark, units.ratio, ["50%", "12.5 %", "50", None]) == [0.5, 0.125, None, None]


def test_quantities(spark):
    cases = {
        "100m": "0.1", "1M": "1000000", "1Mi": "1048576", "10Gi": str(10 * 2**30), ".5": "0.5",
        "2.": "2", "1e3": "1000", "1E": str(10**18), "-1k": "-1000", "+2k": "2000",
        "64Mi": str(64 * 2**20), "3n": "0.000000003", "1.5u": "0.0000015", "1e-2": "0.01",
        "9E": str(9 * 10**18), "1Ei": str(2**60), "12k": "12000", "0.5Ki": "512",
    }
    got = column(spark, units.parse_quantity, list(cases))
    assert got == [Decimal(v) for v in cases.values()]
    assert all(column(spark, units.valid_quantity, list(cases)))
    wrong = ["1.5.2", "", "Gi", "5 Gi", "7K", "1e", "x"]
    assert column(spark, units.parse_quantity, [*wrong, None]) == [None] * 8
    assert not any(column(spark, units.valid_quantity, wrong))
    # Valid, but outside DECIMAL(38,9).
    assert column(spark, units.parse_quantity, ["9999999999999E", "1e40"]) == [None, None]


@pytest.mark.parametrize(
    "folder,want",
    [("/", "/app/git-0/current"), ("/processors", "/app/git-0/current/processors"),
     ("a//b/", "/app/git-0/current/a/b"), (None, "/app/git-0/current"), ("", "/app/git-0/current"), ("/./a/./.b/.", "/app/git-0/current/a/.b"), ("//", "/app/git-0/current")],
)
def test_content_path(spark, folder, want):
    assert column(spark, lambda c: naming.content_path("/app/git-0", c), [folder]) == [want]


def test_index_entries(spark):
    df = spark.createDataFrame(
        [("c", [("/",), ("/nar",)]), ("empty", [])], "cluster string, git array<struct<gitFolder:string>>"
    )
    assert rows(sequences.index_entries(df, "git", "/app/git"), "pos") == [
        ("c", 0, "git-sync-0", "git-sync-0-init", "content-from-git-0", "/app/git-0", "/app/git-0/current"),
        ("c", 1, "git-sync-1", "git-sync-1-init", "content-from-git-1", "/app/git-1", "/app/git-1/current/nar"),
    ]


def test_sync_arguments(spark):
    df = spark.createDataFrame(
        [("r", "", 0, None, {"--depth": "9", "--one-time": "x", "--b": "2", "--a": "1"})],
        "repo string, branch string, depth int, wait string, user map<string,string>",
    )
    base = arguments.sync_args(F.col("repo"), F.col("branch"), F.col("depth"), F.col("wait"), True)
    loose, strict = df.select(
        arguments.merge_args(base, F.col("user")), arguments.merge_args(base, F.col("user"), strict=True)
    ).first()
    assert loose == ["--repo=r", "--ref=main", "--depth=1", "--period=20s", "--link=current",
                     "--root=/tmp/git", "--one-time=true", "--git-config=safe.directory:/tmp/git",
                     "--a=1", "--b=2", "--one-time=x"]
    assert strict == loose[:-1]


def test_override_args_keeps_repeats(spark):
    df = spark.createDataFrame(
        [(["-a", "-a", "-Xmx1g", "-x"], ["-n", "-a"], ["-x"], ["^-Xmx"]), (["-k"], None, None, None)],
        "args array<string>, a array<string>, r array<string>, rx array<string>",
    )
    got = df.select(
        arguments.override_args(F.col("args"), F.col("a"), F.col("r"), F.col("rx"))
    ).collect()
    assert [r[0] for r in got] == [["-a", "-a", "-n"], ["-k"]]


def test_cluster_health_and_offenders(spark):
    nodes = spark.createDataFrame(
        [("a", "n1", "CONNECTED"), ("a", "n2", "DISCONNECTED"), ("b", "n1", "CONNECTED"),
         ("c", "n1", None), ("d", None, None), ("x", "n1", "CONNECTED")],
        "cluster string, node string, status string",
    )
    expected = spark.createDataFrame(
        [("a", 2), ("b", 2), ("c", 1), ("d", 0), ("e", 0), ("f", 1)],
        "cluster string, expected_nodes int",
    )
    verdict = health.cluster_health(nodes, expected)
    got = {r["cluster"]: (r["reason"], r["healthy"]) for r in verdict.collect()}
    assert got == {
        "a": ("not_connected", False), "b": ("count_mismatch", False), "c": ("not_connected", False),
        "d": ("healthy", True), "e": ("healthy", True), "f": ("count_mismatch", False),
    }
    blamed = health.cluster_offenders(nodes, verdict)
    assert rows(blamed.select("cluster", "offender"), "cluster") == [
        ("a", "n2=DISCONNECTED"), ("b", "n1=CONNECTED"), ("c", "n1=null")]


def test_bodies_agree_with_rows(spark):
    def body(*nodes):
        return json.dumps({"cluster": {"nodes": [dict(zip(("address", "nodeId", "status"), n)) for n in nodes]}})

    df = spark.createDataFrame(
        [("a", body(("h1", "1", "CONNECTED"), (None, "2", "CONNECTED")), 2),
         ("b", body(("h1", "1", "LOST")), 1), ("c", "not json", 1), ("d", body(), 0), ("e", "{}", 0)],
        "cluster string, body string, expected_nodes int",
    )
    exploded = health.explode_nodes(df, "body", ["cluster"])
    verdict = health.cluster_health(exploded, df)
    single = health.body_health(df, "body")
    names = ["cluster", "nodes", "bad_nodes", "reason", "healthy"]
    assert rows(verdict.select(*names), "cluster") == rows(single.select(*names), "cluster")
    offenders = {r["cluster"]: r["offenders"] for r in single.collect()}
    assert offenders["b"] == ["h1=LOST"] and offenders["c"] == []


def test_first_eligible_group(spark):
    clusters = spark.createDataFrame([("a",), ("b",), ("c",)], "cluster string")
    groups = spark.createDataFrame(
        [("a", "z", 2), ("a", "m", 0), ("a", "n", 3), ("b", "y", None), ("b", "x", 0)],
        "cluster string, role_group string, replicas int",
    )
    assert rows(sequences.pick_first_eligible(clusters, groups), "cluster") == [
        ("a", "n", "a-node-n-0", None), ("b", "x", "b-node-x-0", None), ("c", None, None, "no_role_groups")]


def test_defaults_fill_blank_only_where_asked(spark):
    df = spark.createDataFrame([("", 0, ""), (None, None, None), ("b", 2, "c")], "branch string, depth int, folder string")
    got = rules.apply_defaults(df, {"branch": "main", "depth": 1, "folder": "/"}, {"branch": "", "depth": 0})
    assert rows(got) == [("main", 1, ""), ("main", 1, "/"), ("b", 2, "c")]


def test_rules(spark):
    df = spark.createDataFrame([(1, None, -1, "10Gi", "INFO"), (2, "n", 3, "x", "LOUD")], "k int, name string, depth int, q string, level string")
    checks = [rules.required("name"), rules.minimum("depth", 0), rules.quantity("q"),
              rules.one_of("level", ("INFO", "WARN")), rules.max_length("name", 3), rules.pattern("name", "^[a-z]$")]
    assert rows(rules.validate(df, checks, ["k"]), "k", "rule") == [
        (1, "depth", "minimum", "-1"), (1, "name", "required", None),
        (2, "level", "enum", "LOUD"), (2, "q", "quantity", "x")]


def test_labels(spark):
    df = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"a": "2"}), (3, {}), (4, None)], "i int, l map<string,string>")
    assert rows(rules.match_labels(df, "l", {"a": "1", "b": "2"}).select("i")) == [(1,)]
    assert rules.match_labels(df, "l", {}).count() == 4


def test_directory_and_oidc_logins(spark):
    df = spark.createDataFrame(
        [(1, "s", True, "", "uid"), (2, "s", None, "(x)", "uid"), (3, None, True, None, "cn")],
        "i int, secret string, tls boolean, filter string, uid string")
    got = rules.ldap_audit(df, "secret", "tls", "filter", "uid").select("i", "strategy", "protocol", "effective_filter")
    assert rows(got, "i") == [(1, "LDAPS", "ldaps", "uid={0}"), (2, "SIMPLE", "ldap", "(x)"), (3, "ANONYMOUS", "ldaps", "cn={0}")]
    df = spark.createDataFrame(
        [(1, "h", 0, "/r", ["a"], ["b", "c"]), (2, "h", 8080, "r", None, None), (3, "h", None, "", ["a"], None)],
        "i int, host string, port int, root string, s array<string>, e array<string>")
    got = rules.oidc_audit(df, "host", "port", "root", "s", "e").select("i", "issuer", "all_scopes")
    assert rows(got, "i") == [(1, "http://h/r", "a,b,c"), (2, "http://h:8080/r", ""), (3, "http://h", "a")]


def test_auth(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, ["a", "b"]), (4, [""]), (5, ["x"])], "i int, classes array<string>")
    got = rules.auth_cardinality(df, "classes").select("i", "auth_verdict")
    assert [v for _, v in rows(got, "i")] == ["auth_missing", "auth_missing", "auth_multiple", "auth_class_empty", "ok"]
    clusters = spark.createDataFrame([("c1", "a"), ("c2", "b"), ("c3", "zz"), ("c4", "n"), ("c5", None)], "cluster string, auth_class string")
    classes = spark.createDataFrame([("a", "x", "y", None), ("b", None, "y", "z"), ("n", None, None, None)], "name string, oidc string, ldap string, static string")
    got = lookups.resolve_auth(clusters, classes).select("cluster", "auth")
    assert [v for _, v in rows(got, "cluster")] == ["oidc", "ldap", "auth_class_missing", "unsupported", "auth_class_missing"]


def test_secret_verdict_and_keys(spark):
    clusters = spark.createDataFrame([("ns", "a", False), ("ns", "b", True), ("ns", "c", None), ("other", "a", None)], "namespace string, key_secret string, auto_generate boolean")
    secrets = spark.createDataFrame([("ns", "a", ["user"]), ("ns", "a", ["user"])], "namespace string, name string, held array<string>")
    got = lookups.secret_verdict(clusters, secrets, keys="held", needed=("user", "password"))
    assert rows(got.select("namespace", "key_secret", "secret_verdict", "missing_keys"), "namespace", "key_secret") == [
        ("ns", "a", "ok", ["password"]), ("ns", "b", "generate", None), ("ns", "c", "fail", None), ("other", "a", "fail", None)]


def test_layering(spark):
    roles = spark.createDataFrame([("c", "30s", ["x"], {"a": "1", "b": "2"})], "cluster string, wait string, args array<string>, env map<string,string>")
    groups = spark.createDataFrame([("c", "g", None, ["y"], {"b": "3"}), ("c", "h", "5s", None, None), ("d", "i", None, None, {"q": "1"})],
                                   "cluster string, g string, wait string, args array<string>, env map<string,string>")
    got = {r["g"]: r.asDict() for r in lookups.layer_config(roles, groups, "cluster", ["wait", "args"], ["env"]).collect()}
    assert got["g"]["wait"] == "30s" and got["g"]["args"] == ["y"] and got["g"]["env"] == {"a": "1", "b": "3"}
    assert got["h"]["wait"] == "5s" and got["h"]["env"] == {"a": "1", "b": "2"}
    assert got["i"]["wait"] is None and got["i"]["env"] == {"q": "1"}


def test_drift(spark):
    expected = spark.createDataFrame([("a", None, None), ("b", "r", "1"), ("b", "s", "2"), ("c", "r", "1"), ("c", "s", "1")], "name string, field string, value string")
    observed = spark.createDataFrame([("a", "x", "1"), ("b", "r", "1"), ("b", "t", "9")], "name string, field string, value string")
    got = drift.expected_vs_observed(expected, observed, ["name"])
    assert rows(got, "name", "field") == [("b", "mismatch", "s", "2", None), ("c", "missing", None, None, None)]


def test_members(spark):
    df = spark.createDataFrame([("w", "git-sync-0"), ("w", "/app/git-0/x"), ("v", "other"), ("u", None)], "w string, m string")
    got = drift.required_members(df, ["w"], "m", ["git-sync-0"])
    assert rows(got, "w") == [("u", ["git-sync-0"], False), ("v", ["git-sync-0"], False), ("w", [], True)]
    got = drift.required_members(df, ["w"], "m", ["/app/git-0"], match="contains")
    assert {r["w"]: r["complete"] for r in got.collect()} == {"u": False, "v": False, "w": True}


def test_templates_insert_literally_and_once(spark):
    files = spark.createDataFrame(
        [("c", "f", 'a={{ getenv "X" }}\nb={{getenv "Y"}}{{ getenv "X" }}\nc={{ getenv "NO" }}'), ("c", "g", "plain"), ("d", "f", '{{ getenv "X" }}')],
        "cluster string, file string, body string")
    env = spark.createDataFrame([("c", "X", '$1\\{{ getenv "Y" }}'), ("c", "Y", "y"), ("d", "Y", "q")], "cluster string, name string, value string")
    got = rendering.expand_templates(files, env, "cluster", ["file"])
    assert rows(got.select("cluster", "file", "body", "unresolved"), "cluster", "file") == [
        ("c", "f", 'a=$1\\{{ getenv "Y" }}\nb=y$1\\{{ getenv "Y" }}\nc={{ getenv "NO" }}', ["NO"]),
        ("c", "g", "plain", []), ("d", "f", '{{ getenv "X" }}', ["X"])]


def test_rendered_files_and_parts(spark):
    props = spark.createDataFrame([("f", "b", "2", 1), ("f", "B", "1", 2), ("f", "a", "old", 3), ("f", "a", None, 4), ("f", "c", "x", 5), ("g", "k", "v", 1)],
                                  "file string, key string, value string, pos int")
    whole = rendering.render_files(props, ["file"], pos="pos")
    assert rows(whole.select("file", "part", "body"), "file") == [("f", 0, "B=1\na=\nb=2\nc=x\n"), ("g", 0, "k=v\n")]
    cut = rendering.render_files(props, ["file"], pos="pos", lines_per_part=2)
    bodies = [r["body"] for r in cut.filter("file = 'f'").orderBy("part").collect()]
    assert len(bodies) > 1 and "".join(bodies) == "B=1\na=\nb=2\nc=x\n"


def test_lines_and_lint(spark):
    df = spark.createDataFrame([(1, "a\n\n${{file:x}\n{ok}\n"), (2, ""), (3, None)], "i int, t string")
    assert rows(rendering.explode_lines(df, "t"), "i", "pos") == [(1, 0, "a"), (1, 2, "${{file:x}"), (1, 3, "{ok}")]
    assert rows(rendering.lint_placeholders(df, "t").select("i", "pos", "opened", "closed")) == [(1, 2, 2, 1)]


def test_any_contained(spark):
    df = spark.createDataFrame([(1, "xxabcx"), (2, "nothing"), (3, None), (4, "zqz"), (5, "abc q")], "i int, t string")
    needles = spark.createDataFrame([("abc",), ("q",), ("abc",), (None,)], "text string")
    got = scraping.any_contained(df, "t", needles)
    assert rows(got.select("i"), "i") == [(1,), (4,), (5,)]
    assert rows(scraping.any_contained(df, "t", ["abc", "q"]).select("i"), "i") == [(1,), (4,), (5,)]
    assert scraping.any_contained(df, "t", needles.limit(0)).count() == 0
    blank = spark.createDataFrame([("",)], "text string")
    assert scraping.any_contained(df, "t", blank).count() == 4


def test_names_in_texts_by_words_and_by_characters(spark):
    texts = ["up_total{a} 1", "xx the quick-brown fox", "quickbrown", "Ähre 日本", "é", "", None, "the quick-brown fox"]
    names = ["e quick-brown fo", "up_total{", "re 日", "brown ", "quick", "nowhere at all", "é", "-"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    table = spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "text string")
    for some in (names, names[:1], names[2:3], names[5:6]):
        chosen = table.filter(F.col("text").isin(some))
        want = [i for i, t in enumerate(texts) if t is not None and any(n in t for n in some)]
        found = scraping.any_contained(df, "t", chosen)
        assert sorted(r["i"] for r in found.collect()) == want
        assert "Python" not in found._jdf.queryExecution().toString()


def test_parts_do_not_depend_on_the_cluster(spark):
    props = spark.createDataFrame([("c", "f", f"k{i:04d}", '{{ getenv "NO" }} {' if i % 400 == 0 else "v") for i in range(1000)],
                                  "cluster string, file string, key string, value string").repartition(7)
    expect = None
    for per_task in (3, 70, 2_000_000):
        cut = rendering.render_files(props, ["cluster", "file"], lines_per_part=300, rows_per_task=per_task)
        found = rows(cut, "part")
        assert [r[2] for r in found] == [0, 1, 2, 3]
        assert expect in (None, found)
        expect = found


def test_last_binding_counts(spark):
    files = spark.createDataFrame([("c", "f", '{{ getenv "X" }}')], "cluster string, file string, body string")
    base = spark.createDataFrame([("c", "X", "zzz", 1)], "cluster string, name string, value string, pos int")
    auth = spark.createDataFrame([("c", "X", "aaa", 0)], "cluster string, name string, value string, pos int")
    env = rendering.gather_env({"base": base, "auth": auth}, ["cluster", "name", "value", "pos"])
    got = rendering.expand_templates(files, env, "cluster", ["file"], env_order=["source_rank", "pos"])
    assert got.first()["body"] == "aaa"


def test_unresolved_name_is_one_finding_of_a_file(spark):
    props = spark.createDataFrame([("c", "f", f"k{i}", '{{ getenv "NO" }}') for i in range(5)] + [("c", "f", "z", "{")],
                                  "cluster string, file string, key string, value string")
    env = spark.createDataFrame([], "cluster string, name string, value string")
    old = rendering.LINES_PER_PART
    from armada.plans import audit
    for size in (2, old):
        files = rendering.render_files(props, ["cluster", "file"], lines_per_part=size)
        expanded = rendering.expand_templates(files, env, "cluster", ["file", "part"])
        assert expanded.count() == (3 if size == 2 else 1)
    _, findings, _ = audit.configuration_audit(props, env)
    assert sorted((r["finding"], r["detail"]) for r in findings.collect()) == [("unbalanced", "z={"), ("unresolved", "NO")]


def test_repeated_lookup_keys(spark):
    classes = spark.createDataFrame([("k", None, "x", None), ("k", "x", None, None), ("s", None, None, None)], "name string, oidc string, ldap string, static string")
    clusters = spark.createDataFrame([("a", "k"), ("b", "s"), ("c", "no")], "cluster string, auth_class string")
    got = {r["cluster"]: r["auth"] for r in lookups.resolve_auth(clusters, classes).collect()}
    assert got == {"a": "oidc", "b": "unsupported", "c": "auth_class_missing"}
    roles = spark.createDataFrame([("r", 1, {"a": "1"}), ("r", 2, {"b": "2"}), ("q", None, None)], "role string, n int, m map<string,string>")
    groups = spark.createDataFrame([("r", None, {"c": "3"}), ("q", 7, None)], "role string, n int, m map<string,string>")
    merged = {r["role"]: (r["n"], r["m"]) for r in lookups.layer_config(roles, groups, "role", ["n"], ["m"]).collect()}
    assert merged == {"r": (2, {"b": "2", "c": "3"}), "q": (7, None)}


def test_latest_call_decides(spark):
    ok = '{"cluster":{"nodes":[{"address":"h","status":"CONNECTED"}]}}'
    calls = [("dead", 1, 1, 200, ok)] + [("dead", 2 + i, i, 503, None) for i in range(9)] + [("fine", 1, 1, 503, None), ("fine", 2, 2, 200, ok)]
    calls += [("alone", 1, 1, 404, None), ("short", 1, 1, 404, None)]
    responses = spark.createDataFrame(calls, "cluster string, ts int, id int, code int, body string")
    wanted = spark.createDataFrame([("dead", 1), ("fine", 1), ("alone", 1), ("short", 3), ("silent", 1)], "cluster string, expected_nodes int")
    from armada.plans.health import fleet_health
    got = {r["cluster"]: (r["reason"], r["healthy"]) for r in fleet_health(responses, wanted)[0].collect()}
    assert got == {"dead": ("no_response", False), "fine": ("healthy", True), "alone": ("standalone", True),
                   "short": ("count_mismatch", False), "silent": ("no_response", False)}
    old = {r["cluster"]: r["reason"] for r in fleet_health(responses, wanted, F.lit(3))[0].collect()}
    assert old["fine"] == "no_response"


def test_metric_presence(spark):
    df = spark.createDataFrame([("a", "# HELP up_total x"), ("a", "up_total_sum 1"), ("b", "x 1\nup_total{a=\"1\"} 2"), ("c", None)], "target string, body string")
    loose = scraping.metric_present(df, "target", "body", "up_total")
    assert {r["target"]: r["present"] for r in loose.collect()} == {"a": True, "b": True, "c": False}
    exact = scraping.metric_present(df, "target", "body", "up_total", exact=True)
    assert {r["target"]: r["present"] for r in exact.collect()} == {"a": False, "b": True, "c": False}


def test_json_records(spark):
    df = spark.createDataFrame([("x", None)], "name string, built string")
    record = records.to_json_records(df, {"built": "BuildTime", "name": "AppName"}).first()[0]
    assert record == '{"BuildTime":null,"AppName":"x"}'


def test_components(spark, tmp_path):
    df = spark.createDataFrame([(1, "test data"), (2, None)], "i int, t string")
    got = components.process_records(df, "t", "GitSyncTestProcessor")
    assert rows(got.select("processed"), "i")[0] == ("Processed by GitSyncTestProcessor: test data",)
    source = tmp_path / "armada_sent_component.py"
    source.write_text("class Upper:\n    def process(self, x):\n        return None if x is None else x.upper()\n")
    components.ship(spark, str(source))
    got = components.apply_component(df, "t", "armada_sent_component:Upper")
    assert rows(got.select("i", "processed"), "i") == [(1, "TEST DATA"), (2, None)]


def test_specs(spark, tmp_path):
    good = {"metadata": {"name": "c", "namespace": "ns"}, "spec": {"image": {"productVersion": "2.4.0"},
            "clusterConfig": {"authentication": [{"authenticationClass": "a"}], "sensitiveProperties": {"keySecret": "k", "autoGenerate": True},
                              "customComponentsGitSync": [{"repo": "r", "wait": "30s"}]},
            "nodes": {"roleGroups": {"default": {"replicas": 1}, "other": {}}}},
            "status": {"conditions": [{"type": "Ready", "status": "True"}]}}
    (tmp_path / "specs.json").write_text(json.dumps(good) + "\n{broken\n")
    read = specs.read_specs(spark, str(tmp_path))
    assert read.count() == 2
    bad = read.filter("metadata is null").select("metadata", "_corrupt_record").collect()
    assert [r[1] for r in bad] == ["{broken"]
    flat = specs.flatten_specs(read.filter("metadata is not null"))
    row = flat.first()
    assert (row["cluster"], row["version"], row["tls"], row["auth_classes"]) == ("c", "2.4.0", False, ["a"])
    assert rows(specs.explode_role_groups(flat), "role_group") == [("c", "ns", "default", 1), ("c", "ns", "other", None)]
    assert specs.explode_conditions(read).first()["type"] == "Ready"


def test_schema_rules(spark):
    df = spark.createDataFrame(
        [(1, "Ready", "True", "AllGood", "", -1, "2024-01-01"), (2, "a/b/c", "Maybe", "", "x", 1, None),
         (3, "kube.io/Ready", "Unknown", "9bad", "m" * 40000, None, "2024-01-01")],
        "i int, type string, status string, reason string, message string, observedGeneration long, lastTransitionTime string")
    got = rows(rules.validate(df, rules.condition_rules(), ["i"]).select("i", "field", "rule"), "i", "field", "rule")
    assert got == [
        (1, "observedGeneration", "minimum"), (2, "lastTransitionTime", "required"), (2, "reason", "min_length"),
        (2, "reason", "pattern"), (2, "status", "enum"), (2, "type", "pattern"), (3, "message", "max_length"), (3, "reason", "pattern")]
    df = spark.createDataFrame([(1, None, -1, None, "X_MD5", "5", "1 Gi", "INFO")],
                               "i int, repo string, depth int, key_secret string, algorithm string, cpu_max string, memory_limit string, level string")
    checks = [*rules.git_rules(), *rules.key_rules("X_"), *rules.log_level_rules("level"), rules.quantity("cpu_max"), rules.quantity("memory_limit")]
    assert rows(rules.validate(df, checks, ["i"]).select("field", "rule"), "field") == [
        ("algorithm", "enum"), ("depth", "minimum"), ("key_secret", "required"), ("memory_limit", "quantity"), ("repo", "required")]


def test_searchable_layout(spark, tmp_path):
    df = spark.range(500).select(
        (F.col("id") % 5).cast("string").alias("EventType"), F.col("id").cast("string").alias("Filename"), "id")
    path = str(tmp_path / "events")
    write_searchable(df, path, ["EventType", "id"])
    found = upkeep.event_search(spark.read.parquet(path), EventType="3", Filename="13")
    assert rows(found) == [("3", "13", 13)]
    assert "EqualTo(Filename,13)" in found._jdf.queryExecution().toString()


def test_retention_and_truncation(spark):
    df = spark.createDataFrame(
        [(1, "node", 1), (2, "node", 20), (3, "component", 2), (4, "component", 4), (5, "other", 0), (6, None, 0)],
        "i int, kind string, age int")
    df = df.withColumn("ts", F.expr("timestamp'2024-03-01' - make_dt_interval(age)"))
    kept = upkeep.retain(df, "ts", "kind", datetime(2024, 3, 1))
    assert rows(kept.select("i"), "i") == [(1,), (3,)]
    cut = upkeep.truncate_attributes(spark.createDataFrame([("abc",), ("ab",), (None,)], "t string"), "t", 2)
    assert rows(cut.select("t", "t_cut")) == [("ab", True), ("ab", False), (None, False)]


def test_response_classes(spark):
    df = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate([("token", 409), ("token", 404), ("cluster", 404), ("cluster", 409), ("cluster", 200), ("cluster", None), ("token", 201)])],
                               "i int, call string, code int")
    got = health.classify_response(df, "call", "code").select("i", "response")
    assert [v for _, v in rows(got, "i")] == ["anonymous", "retry", "standalone", "standalone", "ok", "retry", "ok"]


def test_silent_clusters_have_a_row_in_each_window(spark):
    from armada.streaming.snapshots import stream_health, with_silent

    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    body = '{"cluster":{"nodes":[{"address":"h","status":"CONNECTED"}]}}'
    bodies = spark.createDataFrame([("a", at(0), 1, body), ("a", at(5), 2, body), ("b", at(5), 3, body)],
                                   "cluster string, ts timestamp, id int, body string")
    wanted = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 1)], "cluster string, expected_nodes int")
    judged = stream_health(bodies, wanted, "cluster", "body", "ts", "id", every="1 minute")
    assert judged.count() == 3
    got = sorted((r["window_start"].minute, r["cluster"], r["reason"]) for r in with_silent(judged, wanted, "cluster").collect())
    assert got == [(0, "a", "healthy"), (0, "b", "no_response"), (0, "c", "no_response"),
                   (5, "a", "healthy"), (5, "b", "healthy"), (5, "c", "no_response")]
