"""The library's tables, derived from the tables of a data folder, in Spark and as SQL for comparison.

``part`` gives database A: entities are parts, with six categorical features; brand is the genus, type the family. Key arithmetic
decides which cells are blanked. ``lineitem`` gives database B over the same entities. ``embeddings`` gives the vectors.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.columns import POISSON, PRIME, ROUNDS
from lacuna.functions.scratch import written


def draw_sql(seed: int, *columns: str) -> str:
    """``functions.columns.draw`` in SQL."""
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(columns)})), 1, 15))::BIGINT"


def permuted_sql(place: str, n: str, seed: int, *keys: str) -> str:
    """``functions.columns.permuted`` in SQL."""
    key = f"{seed}::BIGINT"
    for c in keys:
        key = f"(({key} * 1000003 + ({c})::BIGINT) % {PRIME})"
    mix = lambda v: f"(({v}) * (({v}) % 65521 + 7) % {PRIME})"
    turn = f"(({key} * 40503 + _r * 7919) % {PRIME})"
    other = f"(({mix(turn)} % ({n}) - _at + ({n})) % ({n}))"
    bit = f"(({mix(f'(greatest(_at, {other}) * 2654435 + {turn}) % {PRIME}')} // 4096) % 2)"
    return f"list_reduce(list_prepend(({place})::BIGINT, range(0, {ROUNDS})), lambda _at, _r: CASE WHEN {bit} = 1 THEN {other} ELSE _at END)"


def poisson_sql(key: str, replicate: str) -> str:
    """``functions.columns.poisson_counts`` in SQL."""
    mix = lambda v: f"(({v}) * (({v}) % 65521 + 7) % {PRIME})"
    start = f"((({key}) % {PRIME} + (({replicate}) + 1) * 7368787) % {PRIME})"
    u = f"(({mix(start)} + (({key}) >> 31)) % {PRIME} * 48271 + 11) % {PRIME}"
    return f"len(list_filter({list(POISSON)}, lambda _t: {mix(u)} >= _t))"


#: name, SQL expression and number of each feature of database A
FEATURES = (
    ("adj", "split_part(p_name, ' ', 1)", 1),
    ("heavy", "CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END", 2),
    ("noun", "split_part(p_name, ' ', 2)", 3),
    ("odd", "CASE WHEN p_partkey % 2 = 1 THEN 'yes' ELSE 'no' END", 4),
    ("price", "concat('p', CAST(floor((p_retailprice - 900) / 25) AS INT))", 5),
    ("size", "concat('s', CAST(floor(p_size / 10) AS INT))", 6),
)
GOLD = " UNION ALL ".join(f"SELECT p_partkey AS entity, '{f}' AS feature, {e} AS value, {n} AS fno FROM part" for f, e, n in FEATURES)
BLANKED = "(entity * 31 + fno * 17) % 5 = 0"
META = """SELECT p_partkey AS entity, p_brand AS genus, p_type AS family, CAST(p_partkey * 37 % 181 - 90 AS DOUBLE) AS latitude,
    CAST(p_partkey * 53 % 361 - 180 AS DOUBLE) AS longitude FROM part"""
OTHER = """SELECT l_partkey AS entity, 'flag' AS feature, min(l_returnflag) AS value FROM lineitem GROUP BY l_partkey
    UNION ALL SELECT l_partkey, 'status', max(l_linestatus) FROM lineitem GROUP BY l_partkey
    UNION ALL SELECT l_partkey, 'most', concat('q', CAST(floor(max(l_quantity) / 5) AS INT)) FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY l_partkey
    UNION ALL SELECT l_partkey, 'lines', concat('n', CAST(count(*) / 10 AS INT)) FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY l_partkey"""
PREDS = {
    "freq": "SELECT b.entity, b.feature, m.value, 0.3 AS score FROM blanks b JOIN freq m USING (feature)",
    "genus": "SELECT b.entity, b.feature, g.value, 0.6 AS score FROM blanks b JOIN meta USING (entity) JOIN genus_mode g USING (genus, feature)",
    "family": "SELECT b.entity, b.feature, g.value, 0.5 AS score FROM blanks b JOIN meta USING (entity) JOIN family_mode g USING (family, feature)",
}
MODE = "SELECT {k}, value FROM (SELECT {k}, value, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, value) AS r FROM cells {j} GROUP BY {k}, value) WHERE r = 1"

PRELUDE = f"""
WITH RECURSIVE gold0 AS ({GOLD}), cells AS (SELECT entity, feature, value FROM gold0 WHERE NOT {BLANKED}),
blanks AS (SELECT entity, feature FROM gold0 WHERE {BLANKED}), gold AS (SELECT entity, feature, value FROM gold0 WHERE {BLANKED}),
meta AS ({META}),
book AS (SELECT feature, value, (dense_rank() OVER (ORDER BY feature) - 1)::INT AS fi, (row_number() OVER (PARTITION BY feature ORDER BY value) - 1)::INT AS vi,
    count(*) OVER (PARTITION BY feature)::INT AS k, (row_number() OVER (ORDER BY feature, value) - 1)::INT AS gid FROM (SELECT feature, value FROM (SELECT DISTINCT feature, value FROM cells) QUALIFY count(*) OVER (PARTITION BY feature) >= 2)),
counts AS (SELECT feature, value, count(*) AS n FROM cells GROUP BY feature, value),
p AS (SELECT feature, value, (n + 0.5)::DOUBLE / sum(n + 0.5) OVER (PARTITION BY feature) AS p FROM counts WHERE feature IN (SELECT feature FROM book)),
cooc AS (SELECT a.feature AS fi, a.value AS vi, b.feature AS fj, b.value AS vj, count(*) AS n FROM cells a JOIN cells b USING (entity) WHERE a.feature <> b.feature GROUP BY ALL),
freq AS ({MODE.format(k="feature", j="")}), freqs AS (SELECT feature, value, n::DOUBLE / sum(n) OVER (PARTITION BY feature) AS score FROM counts JOIN (SELECT feature FROM freq) USING (feature) QUALIFY (feature, value) IN (SELECT (feature, value) FROM freq)),
genus_mode AS ({MODE.format(k="genus, feature", j="JOIN meta USING (entity)")}), family_mode AS ({MODE.format(k="family, feature", j="JOIN meta USING (entity)")}),
preds AS ({" UNION ALL ".join(f"SELECT '{s}' AS system, entity, feature, value, score FROM ({q})" for s, q in PREDS.items())}),
other AS ({OTHER}),
vecs AS (SELECT vec_id AS id, embedding AS vec, label FROM embeddings)
"""


#: Bytes of files up to which a side of a join is broadcast before anything was measured.
SMALL_FILES = 256 << 10


def broadcast_by_measured_sizes(spark: SparkSession) -> None:
    """Lets the session broadcast sides that adaptive execution has measured, as large as before, but those it only guesses from files up to ``SMALL_FILES``.

    A file of a few megabytes can hold millions of entities, each of which becomes several cells, and the driver builds the whole table of a broadcast.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    now = spark.conf.get(static)
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", now.strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > SMALL_FILES:
        if spark.conf.get(adaptive, None) is None:
            spark.conf.set(adaptive, now)
        spark.conf.set(static, str(SMALL_FILES))


def unions_without_partitioning(spark: SparkSession) -> None:
    """Lets no union claim the partitioning of its sides: Spark 4.1 plans joins by that claim, while adaptive execution may run the union as all partitions of all sides one after another."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


#: Rows of a table that one task gets, where they are dealt by a key. Each part becomes some hundred rows of a profile.
PART_ROWS, LINE_ROWS = 1 << 13, 1 << 17


class Inputs:
    """Lazily derived frames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        broadcast_by_measured_sizes(spark)
        unions_without_partitioning(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def dealt(self, name: str, key: str, rows: int) -> DataFrame:
        """The table dealt by a key to as many tasks as it has ``rows``: what follows by that key moves nothing, and a task's share does not grow with the table."""
        table = self.table(name)
        return table.repartition(max(1, -(-table.count() // rows)), key)

    @cached_property
    def parts(self) -> DataFrame:
        return self.dealt("part", "p_partkey", PART_ROWS)

    @cached_property
    def all_cells(self) -> DataFrame:
        """Every cell of database A, blanked ones too: (entity, feature, value, fno)."""
        rows = ", ".join(f"'{f}', {e}, {n}" for f, e, n in FEATURES)
        return self.parts.selectExpr("p_partkey AS entity", f"stack({len(FEATURES)}, {rows}) AS (feature, value, fno)")

    @property
    def cells(self) -> DataFrame:
        return self.all_cells.filter(f"NOT {BLANKED}").select("entity", "feature", "value")

    @property
    def gold(self) -> DataFrame:
        return self.all_cells.filter(BLANKED).select("entity", "feature", "value")

    @property
    def blanks(self) -> DataFrame:
        return self.gold.select("entity", "feature")

    @cached_property
    def meta(self) -> DataFrame:
        place = lambda factor, mod, off: f"CAST(p_partkey * {factor} % {mod} - {off} AS DOUBLE)"
        return self.parts.selectExpr("p_partkey AS entity", "p_brand AS genus", "p_type AS family", f"{place(37, 181, 90)} AS latitude", f"{place(53, 361, 180)} AS longitude")

    def kept(self) -> Inputs:
        """The same tables, with cells and entities written once, for queries that read them many times."""
        out = Inputs(self.spark, self.sf_dir)
        out.all_cells = written(self.all_cells, "cells")
        out.meta = written(self.meta, "entities")
        return out

    # The next three have a row per value. They are written, so that plans know how small they are: joined by the feature, cells would meet in one task a feature.

    @cached_property
    def book(self) -> DataFrame:
        from lacuna.operators.coding import codebook

        return written(codebook(self.cells), "book")

    @cached_property
    def counts(self) -> DataFrame:
        from lacuna.operators.stats import marginal_counts

        return written(marginal_counts(self.cells), "counts")

    @cached_property
    def p(self) -> DataFrame:
        from lacuna.operators.stats import marginals

        return written(marginals(self.counts, self.book), "marginals")

    @cached_property
    def preds(self) -> DataFrame:
        """Predictions of three systems: commonest value overall, in the genus and in the family."""
        from lacuna.operators.impute import modes

        with_meta = self.cells.join(self.meta, "entity")
        blanks = self.blanks.join(self.meta, "entity")
        out = None
        for system, keys, source, score in (("freq", ["feature"], self.cells, 0.3), ("genus", ["genus", "feature"], with_meta, 0.6), ("family", ["family", "feature"], with_meta, 0.5)):
            rows = blanks.join(modes(source, *keys), keys).select(F.lit(system).alias("system"), "entity", "feature", "value", F.lit(score).alias("score"))
            out = rows if out is None else out.unionByName(rows)
        return out

    @cached_property
    def other(self) -> DataFrame:
        """Cells of database B."""
        lines = self.dealt("lineitem", "l_partkey", LINE_ROWS).groupBy(F.col("l_partkey").alias("entity")).agg(F.min("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.max("l_quantity").alias("q"), F.count("*").alias("n"))
        rows = lines.selectExpr(
            "entity",
            "stack(4, 'flag', flag, 'status', status, 'most', CASE WHEN entity % 7 <> 0 THEN concat('q', CAST(floor(q / 5) AS INT)) END, "
            "'lines', CASE WHEN entity % 5 <> 0 THEN concat('n', CAST(bround(n / 10) AS INT)) END) AS (feature, value)",
        )
        return rows.filter("value IS NOT NULL")

    @property
    def vecs(self) -> DataFrame:
        return self.table("embeddings").selectExpr("vec_id AS id", "embedding AS vec", "label")
