"""Provider documents: reading, rules, rendering and what is not well formed."""

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from armada.sources import providers

STATE = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<stateManagement>
    <local-provider>
        <id>local-provider</id>
        <class>a.b.Local</class>
        <property name="Directory">/data &amp; state</property>
        <property name="Always Sync">false</property>
        <property name="Empty"></property>
    </local-provider>
    <cluster-provider>
        <id>zk-provider</id>
        <class>a.b.Zk</class>
        <property name="Connect String">{{ getenv "HOSTS" }}</property>
    </cluster-provider>
    <cluster-provider>
        <id>bare</id>
        <class>a.b.Bare</class>
    </cluster-provider>
</stateManagement>
"""


def files(spark):
    rows = [("c1", STATE), ("c2", "<stateManagement></stateManagement>"), ("c3", "<a><b></a>"), ("c4", None), ("c5", "")]
    return spark.createDataFrame(rows, "cluster string, body string")


def tree(text):
    def of(e):
        return (e.tag, tuple(sorted(e.attrib.items())), (e.text or "").strip(), tuple(of(c) for c in e))

    return of(ET.fromstring(text))


def test_documents_become_property_rows(spark):
    rows, broken = providers.provider_rows(files(spark), ["cluster"])
    got = {(r.cluster, r.place, r.kind, r.provider, r.pos, r.property, r.value or "") for r in rows.collect()}
    assert got == {
        ("c1", 0, "local-provider", "local-provider", 0, "Directory", "/data & state"),
        ("c1", 0, "local-provider", "local-provider", 1, "Always Sync", "false"),
        ("c1", 0, "local-provider", "local-provider", 2, "Empty", ""),
        ("c1", 1, "cluster-provider", "zk-provider", 0, "Connect String", '{{ getenv "HOSTS" }}'),
        ("c1", 2, "cluster-provider", "bare", None, None, ""),
    }
    assert {r.cluster for r in broken.collect()} == {"c3", "c4", "c5"}


def test_rendering_gives_the_document_back(spark):
    rows, _ = providers.provider_rows(files(spark), ["cluster"])
    rows = rows.withColumn("root", F.lit("stateManagement"))
    for per_part, per_task in ((1000, 1000), (1, 1)):
        parts = providers.render_providers(rows, ["cluster"], providers_per_part=per_part, rows_per_task=per_task).collect()
        assert len(parts) == (1 if per_part > 1 else 3)
        body = "".join(p.body for p in sorted(parts, key=lambda p: p.part))
        assert tree(body) == tree(STATE)
    again, _ = providers.provider_rows(spark.createDataFrame([("c1", body)], "cluster string, body string"), ["cluster"])
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.drop("root").collect()))


def test_last_property_of_a_name_counts(spark):
    rows = spark.createDataFrame(
        [("c", "r", 0, "provider", "p", "k", 0, "x", "old"), ("c", "r", 0, "provider", "p", "k", 2, "x", "<new>"), ("c", "r", 0, "provider", "p", "k", 1, "y", None)],
        "cluster string, root string, place int, kind string, provider string, class string, pos int, property string, value string",
    )
    body = providers.render_providers(rows, ["cluster"]).first().body
    assert "&lt;new" in body and "old" not in body and body.index('"y"') < body.index('"x"')
    assert ET.fromstring(body).find("provider/identifier").text == "p"


def test_rules_choose_by_cluster(spark):
    clusters = spark.createDataFrame([("c1", "zk"), ("c2", ""), ("c3", None)], "cluster string, zookeeper string")
    rules = spark.createDataFrame([(None, "local"), ("zk", "zk-provider"), ("no zk", "other")], "needs string, provider string")
    uses = F.coalesce(F.col("zookeeper"), F.lit("")) != ""
    got = providers.applicable(rules, clusters, ["cluster"], {"zk": uses, "no zk": ~uses, "never": F.lit(None).cast("boolean")})
    assert sorted(map(tuple, got.collect())) == [
        ("c1", "local"), ("c1", "zk-provider"), ("c2", "local"), ("c2", "other"), ("c3", "local"), ("c3", "other"),
    ]


def test_files_are_read_by_element(spark, tmp_path):
    (tmp_path / "one.xml").write_text(STATE)
    (tmp_path / "two.xml").write_text(STATE.replace("zk-provider", "zk-2"))
    rows = providers.read_providers(spark, str(tmp_path), "cluster-provider").collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.provider, r.property) for r in rows if r.property) == [
        ("one.xml", "zk-provider", "Connect String"), ("two.xml", "zk-2", "Connect String"),
    ]
    assert sorted(r.provider for r in rows if not r.property) == ["bare", "bare"]
