"""Configuration files: rendering, template expansion and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armada.functions import units
from armada.operators.ordered import ROWS_PER_TASK, running

PLACEHOLDER = r'\{\{\s*getenv\s+"[^"]+"\s*\}\}'

# Longer documents are cut, so that one row never grows without bound.
LINES_PER_PART = 100_000


def latest_entries(
    props: DataFrame, file_keys: list[str], key: str, value: str, pos: str | None = None
) -> DataFrame:
    """One value per (file, key): the last by ``pos``, or the greatest without one.

    A file is a map, so a repeated key replaces; copies fold in the map-side aggregate.
    """
    last = F.max_by(value, pos) if pos else F.max(value)
    return props.groupBy(*file_keys, key).agg(last.alias(value))


def render_files(
    props: DataFrame,
    file_keys: list[str],
    key: str = "key",
    value: str = "value",
    pos: str | None = None,
    lines_per_part: int = LINES_PER_PART,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Property rows to ``key=value`` documents, keys in bytewise order, newline after each.

    Line n of a file, counted from 0, is in part n div ``lines_per_part``, whatever the size of the
    file or the cluster; joined in order of ``part`` the rows are the whole document.
    """
    entries = latest_entries(props, file_keys, key, value, pos)
    counted = running(entries, file_keys, [key], F.lit(1), "_line", "sum", rows_per_task)
    part = F.floor((F.col("_line") - 1) / lines_per_part).cast("long")
    numbered = counted.withColumn("part", part).drop("_line")
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))),
        lambda e: F.concat(e["k"], F.lit("="), F.coalesce(e["v"], F.lit("")), F.lit("\n")),
    )
    return numbered.groupBy(*file_keys, "part").agg(F.array_join(lines, "").alias("body"))


def expand_templates(
    files: DataFrame,
    env: DataFrame,
    cluster: str,
    file_id: list[str],
    body: str = "body",
    env_name: str = "name",
    env_value: str = "value",
    env_order: list[str] | None = None,
) -> DataFrame:
    """Replace each ``{{ getenv "X" }}`` by the cluster's value of X.

    Only the names a file uses are looked up and brought back to it, so neither a cluster's
    bindings nor its files are ever gathered. Values are inserted literally and are not expanded
    again. Unbound names stay in the text and are listed in ``unresolved``. ``file_id`` are the
    columns that identify a file within its cluster. Of several bindings of one name the last by
    ``env_order`` counts (for ``gather_env``: its rank and position), as in a process environment;
    without an order, the greatest value.
    """
    keys = [cluster, *file_id]
    used = files.select(*keys, F.explode(F.array_distinct(_names(_marks(body)))).alias("_name"))
    bound = env.groupBy(
        F.col(cluster).alias("_cluster"), F.col(env_name).alias("_env")
    ).agg(
        (F.max_by(env_value, F.struct(*env_order)) if env_order else F.max(env_value)).alias("_value")
    )
    match = (F.col(cluster) == F.col("_cluster")) & (F.col("_name") == F.col("_env"))
    found = used.join(bound.hint("shuffle_merge"), match).filter(F.col("_value").isNotNull())
    lookup = found.groupBy(*keys).agg(
        F.map_from_entries(F.collect_set(F.struct("_name", "_value"))).alias("_bindings")
    )
    bindings = F.coalesce("_bindings", F.create_map().cast("map<string,string>"))
    marked = files.join(lookup.hint("shuffle_merge"), keys, "left").withColumns(
        {"_marks": _marks(body), "_bindings": bindings}
    )
    values = F.transform(
        "_marks", lambda m: F.coalesce(F.try_element_at(F.col("_bindings"), _name(m)), m)
    )
    unbound = F.filter(_names(F.col("_marks")), lambda n: ~F.map_contains_key("_bindings", n))
    # One more piece of text than placeholders; the last value is missing and adds nothing.
    pieces = F.zip_with(
        F.split(body, PLACEHOLDER, -1), values, lambda t, v: F.concat(t, F.coalesce(v, F.lit("")))
    )
    some = F.size("_marks") > 0
    return marked.withColumns(
        {
            "unresolved": F.array_sort(F.array_distinct(unbound)),
            body: F.when(some, F.array_join(pieces, "")).otherwise(F.col(body)),
        }
    ).drop("_marks", "_bindings")


def _marks(body: str) -> Column:
    """Placeholders of a text as they are written."""
    found = F.regexp_extract_all(body, F.lit(PLACEHOLDER), F.lit(0))
    return F.when(F.col(body).contains("{{"), found).otherwise(F.array().cast("array<string>"))


def _name(mark: Column) -> Column:
    return F.substring_index(F.substring_index(mark, '"', 2), '"', -1)


def _names(marks: Column) -> Column:
    return F.transform(marks, _name)


def explode_lines(df: DataFrame, col: str, keep: list[str] | None = None) -> DataFrame:
    """S3: non-empty lines of a text, with their position in it."""
    keep = keep if keep is not None else [c for c in df.columns if c != col]
    lines = df.select(*keep, F.posexplode(F.split(col, "\n", -1)).alias("pos", "line"))
    return lines.filter(F.col("line") != "")


def unbalanced_lines(body: str) -> Column:
    """Lines of a text whose opening and closing braces differ in number."""

    def count(line: Column, mark: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(mark)))

    judged = F.transform(
        F.split(body, "\n", -1),
        lambda line, i: F.struct(
            i.alias("pos"),
            line.alias("line"),
            count(line, "{").alias("opened"),
            count(line, "}").alias("closed"),
        ),
    )
    return F.filter(judged, lambda j: j["opened"] != j["closed"])


def lint_placeholders(files: DataFrame, body: str, keep: list[str] | None = None) -> DataFrame:
    """one row per line with unbalanced braces."""
    keep = keep if keep is not None else [c for c in files.columns if c != body]
    return files.select(*keep, F.inline(unbalanced_lines(body)))


def normalise_units(props: DataFrame, value: str = "value", step: int = 1024) -> DataFrame:
    """numbers beside the raw text; null where the text is not of that kind."""
    raw = F.col(value)
    return props.withColumns(
        {
            "duration_ms": units.duration_ms(raw),
            "size_bytes": units.size_bytes(raw, step),
            "ratio": units.ratio(raw),
        }
    )


def gather_env(sources: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """G1: bindings of several sources one after another, duplicates kept.

    ``source_rank`` and the given columns (which should hold a position) keep the order.
    """
    tagged = [
        df.select(*columns).withColumns({"source": F.lit(name), "source_rank": F.lit(rank)})
        for rank, (name, df) in enumerate(sources.items())
    ]
    result = tagged[0]
    for df in tagged[1:]:
        result = result.unionByName(df)
    return result
