"""Provider documents in XML: read to property rows, chosen by rules, and rendered for every cluster.

A document holds providers; a provider has an id, a class and properties in order. As rows that is one
row per property: file keys, ``place`` (of the provider in its document), ``kind`` (its element),
``provider`` (its id), ``class``, ``pos``, ``property``, ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.operators.ordered import ROWS_PER_TASK, running, same_key
from armada.operators.rules import ldap_audit

# Elements of provider documents, and how they name a provider.
KINDS = ("local-provider", "cluster-provider", "provider")
IDS = {"local-provider": "id", "cluster-provider": "id", "provider": "identifier"}
DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'

CORRUPT = "_corrupt_record"
PROPERTIES = "array<struct<_name: string, _VALUE: string>>"
PROVIDER = f"id string, identifier string, class string, property {PROPERTIES}"

# Longer documents are cut, so that one row never grows without bound.
PROVIDERS_PER_PART = 1000


def document_type(kinds: tuple[str, ...] = KINDS) -> str:
    nested = f"struct<id: string, identifier: string, class: string, property: {PROPERTIES}>"
    return ", ".join([*(f"`{k}` array<{nested}>" for k in kinds), f"{CORRUPT} string"])


def _provider(kind: Column, p: Column) -> Column:
    return F.struct(
        kind.alias("kind"), F.coalesce(p["id"], p["identifier"]).alias("provider"), p["class"].alias("class"),
        p["property"].alias("properties"),
    )


def _of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda p: _provider(F.lit(kind), p))


def _property_rows(providers: DataFrame, keep: list[str]) -> DataFrame:
    """One row per property; a provider without any keeps one row with null for it."""
    return providers.select(
        *keep, "kind", "provider", "class", F.posexplode_outer("properties").alias("pos", "_p")
    ).select(
        *keep, "kind", "provider", "class", "pos", F.col("_p._name").alias("property"), F.col("_p._VALUE").alias("value")
    )


def provider_rows(
    files: DataFrame, keep: list[str], body: str = "body", kinds: tuple[str, ...] = KINDS
) -> tuple[DataFrame, DataFrame]:
    """Provider documents in a column as property rows, and the files that are no such documents.

    Providers are placed in the order of ``kinds`` and, inside a kind, of the document. A null body is not
    well formed either. The second result has ``keep`` and the text.
    """
    parsed = files.select(
        *keep, F.col(body).alias("_body"),
        F.from_xml(body, document_type(kinds), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("_doc"),
    )
    broken = F.col("_doc").isNull() | F.col(f"_doc.{CORRUPT}").isNotNull()
    none = F.array().cast(f"array<struct<kind: string, provider: string, class: string, properties: {PROPERTIES}>>")
    found = F.concat(
        *(F.coalesce(_of_kind(F.col("_doc")[kind], kind), none) for kind in kinds)
    )
    placed = parsed.filter(~broken).select(*keep, F.posexplode(found).alias("place", "_f")).select(*keep, "place", "_f.*")
    return _property_rows(placed, [*keep, "place"]), parsed.filter(broken).select(*keep, F.col("_body").alias(body))


def read_providers(spark: SparkSession, path: str, kind: str = "provider") -> DataFrame:
    """Files of provider documents, one kind of element, as property rows with the ``file`` they are in.

    The XML source finds the elements and gives one row for each, so a file with very many providers is never
    one row. Each file is one document.
    """
    read = spark.read.format("xml").option("rowTag", kind).schema(PROVIDER).load(path)
    one = _provider(F.lit(kind), F.struct("id", "identifier", "class", "property"))
    flat = read.select(F.col("_metadata.file_path").alias("file"), one.alias("_f")).select("file", "_f.*")
    return _property_rows(flat, ["file"])


def applicable(templates: DataFrame, clusters: DataFrame, keep: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Template rows for every cluster they apply to.

    ``templates`` is a rule table of property rows with ``needs``: null for all clusters, or the name of one
    of ``conditions`` (columns over ``clusters``). A cluster meets the rules through the names it satisfies,
    so neither side is paired with what it does not need. A condition that is null does not hold.
    """
    held = F.filter(F.array(F.lit(""), *(F.when(c, F.lit(n)) for n, c in conditions.items())), lambda n: n.isNotNull())
    asked = clusters.select(*keep, F.explode(held).alias("_need"))
    return asked.join(templates.withColumn("_need", F.coalesce("needs", F.lit(""))).drop("needs"), "_need").drop("_need")


def ldap_properties(
    providers: DataFrame, keep: list[str], host: str, port: str, secret_class: str, tls_verification: str,
    search_base: str, search_filter: str, uid_field: str, file: str = "login-identity-providers.xml",
) -> DataFrame:
    """Property rows of directory logins, as the audit of the same settings (P11) judges them."""
    audited = ldap_audit(providers, secret_class, tls_verification, search_filter, uid_field)
    url = F.concat("protocol", F.lit("://"), F.col(host), F.lit(":"), F.col(port).cast("string"))
    listed = {
        "Authentication Strategy": F.col("strategy"), "Url": url,
        "User Search Base": F.col(search_base), "User Search Filter": F.col("effective_filter"),
    }
    pairs = F.array(*(F.struct(F.lit(n).alias("property"), v.alias("value")) for n, v in listed.items()))
    return audited.select(
        *keep, F.lit(file).alias("file"), F.lit("loginIdentityProviders").alias("root"), F.lit(0).alias("place"),
        F.lit("provider").alias("kind"), F.lit("login-identity-provider").alias("provider"), F.lit("ldap").alias("class"),
        F.posexplode(pairs).alias("pos", "_p"),
    ).select("*", "_p.*").drop("_p")


def render_providers(
    rows: DataFrame, file_keys: list[str], root: str = "root", kinds: tuple[str, ...] = KINDS,
    providers_per_part: int = PROVIDERS_PER_PART, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Property rows to XML documents; (file keys, part, body), to be joined in order of ``part``.

    ``root`` is the column with the name of the document's element. Providers come in order of ``place``,
    then kind and id; properties in order of ``pos``, of one name the last. A null value is an empty
    property, a null property none. Signs that XML reserves are escaped.
    """
    ids = [*file_keys, "place", "kind", "provider"]
    last = rows.groupBy(*ids, "property").agg(
        F.max_by(F.struct("value", "pos"), F.coalesce("pos", F.lit(-1))).alias("_v"), F.max("class").alias("class"),
        F.max(root).alias("_root"),
    )
    one = F.struct("_v.pos", F.col("property").alias("_name"), F.coalesce("_v.value", F.lit("")).alias("_VALUE"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("property").isNotNull(), one))), lambda p: p.dropFields("pos"))
    providers = last.groupBy(*ids).agg(listed.alias("_listed"), F.max("class").alias("class"), F.max("_root").alias("_root"))
    text = F.lit(None).cast("string")
    for kind in kinds:
        element = F.struct(F.col("provider").alias(IDS.get(kind, "id")), "class", F.col("_listed").alias("property"))
        text = F.when(F.col("kind") == kind, F.to_xml(element, {"rowTag": kind})).otherwise(text)
    indented = F.concat(F.regexp_replace(text, "(?m)^", "    "), F.lit("\n"))
    written = providers.select(*ids, "_root", indented.alias("_text"))
    counted = running(written, file_keys, ["place", "kind", "provider"], F.lit(1), "_line", "sum", rows_per_task)
    part = F.floor((F.col("_line") - 1) / providers_per_part).cast("long")
    parts = counted.withColumn("part", part).groupBy(*file_keys, "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "_text"))), lambda e: e["_text"]), "").alias("_body"),
        F.max("_root").alias("_root"),
    )
    keys = [f"_k{i}" for i in range(len(file_keys))]
    ends = parts.groupBy(*[F.col(k).alias(n) for k, n in zip(file_keys, keys)]).agg(F.max("part").alias("_end"))
    head = F.when(F.col("part") == 0, F.concat(F.lit(DECLARATION + "<"), F.col("_root"), F.lit(">\n"))).otherwise("")
    foot = F.when(F.col("part") == F.col("_end"), F.concat(F.lit("</"), F.col("_root"), F.lit(">\n"))).otherwise("")
    return parts.join(ends, same_key(file_keys, keys)).select(*file_keys, "part", F.concat(head, "_body", foot).alias("body"))
