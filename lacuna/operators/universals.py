"""Implicational formulas over feature values, and pairs mined from texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.columns import cosine, draw, numbered
from lacuna.functions.ranks import ranked

TOKEN = r"GB\d+:\d+"


def parse_formula(rows: DataFrame, column: str = "formula") -> DataFrame:
    """Adds ant, con (arrays of tokens), ant_conn, con_conn (single, and, or, mixed), ftype and status to rows with a formula.

    The formula is split at its first ``>``; ``sum(`` or no ``>`` makes it untestable.
    """
    plain = F.regexp_replace(F.trim(column), r"\s+", " ")
    out = rows.withColumn("_sides", F.split(plain, ">", 2))
    testable = (F.size("_sides") == 2) & ~F.contains(F.lower(plain), F.lit("sum("))
    for no, side in ((1, "ant"), (2, "con")):
        text = F.coalesce(F.try_element_at("_sides", F.lit(no)), F.lit(""))
        tokens = F.when(testable, F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
        both, either = F.regexp_like(text, F.lit(r"&|\band\b")), F.regexp_like(text, F.lit(r"\||\bor\b"))
        conn = F.when(F.size(side) <= 1, "single").when(both & either, "mixed").when(either, "or").otherwise("and")
        out = out.withColumn(side, tokens).withColumn(f"{side}_conn", conn)
    ftype = F.concat_ws(">", "ant_conn", "con_conn")
    ok = testable & (F.size("ant") > 0) & (F.size("con") > 0)
    return out.withColumn("ftype", F.when(ok, ftype)).withColumn("status", F.when(ok, "ok").otherwise("untestable")).drop("_sides")


def negation_map(book: DataFrame) -> DataFrame:
    """(feature, value, negation): all other values of the feature."""
    other = book.select("feature", F.col("value").alias("negation"))
    return book.select("feature", "value").join(other, "feature").filter("value <> negation")


def implication_cosine(formulas: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, m1) from parsed formulas and token vectors (token, vec).

    Each antecedent meets the consequent: its tokens' maximum for "or", minimum for "and" and single, their centroid's cosine for
    "mixed". Antecedents joined by "or" must all hold, so the minimum counts; others are taken by their centroid.
    """
    from lacuna.operators.vectors import centroid

    ok = formulas.filter("status = 'ok'").select("id", "ant", "ant_conn", "con", "con_conn")
    ants = ok.select("id", "ant_conn", F.explode("ant").alias("token")).join(vectors, "token")
    apart = ants.filter("ant_conn = 'or'").select("id", F.col("token").alias("_part"), "vec")
    joint = centroid(ants.filter("ant_conn <> 'or'"), "id").select("id", F.lit("").alias("_part"), "vec")
    left = apart.select("id", "_part", F.col("vec").cast("array<double>").alias("_a")).union(joint.select("id", "_part", F.col("vec").alias("_a")))
    cons = ok.select("id", "con_conn", F.explode("con").alias("token")).join(vectors, "token")
    mixed = centroid(cons.filter("con_conn = 'mixed'"), "id").select("id", F.lit("mixed").alias("con_conn"), "vec")
    right = cons.filter("con_conn <> 'mixed'").select("id", "con_conn", F.col("vec").cast("array<double>").alias("vec")).union(mixed).withColumnRenamed("vec", "_b")
    scored = left.join(right, "id").withColumn("_c", cosine("_a", "_b"))
    by_part = scored.groupBy("id", "_part", "con_conn").agg(F.when(F.col("con_conn") == "or", F.max("_c")).otherwise(F.min("_c")).alias("_m"))
    return by_part.groupBy("id").agg(F.min("_m").alias("m1"))


def missing_tokens(formulas: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, token) of tokens without a vector."""
    used = formulas.filter("status = 'ok'").select("id", F.explode(F.concat("ant", "con")).alias("token")).distinct()
    return used.join(vectors.select("token"), "token", "left_anti")


def null_cosines(vectors: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(cos): cosines of ``n`` hashed draws of two tokens of different features (token, feature, vec)."""
    placed = numbered(vectors, draw(seed, "token"), "token", name="_p").select("feature", "vec", (F.col("_p") - 1).alias("_p"))
    draws = vectors.sparkSession.range(n).withColumnRenamed("id", "no").crossJoin(F.broadcast(vectors.agg(F.count("*").alias("_n"))))
    at = lambda i: F.pmod(draw(seed + 1 + i, "no"), F.col("_n"))
    x = draws.withColumn("_p", at(0)).join(placed, "_p").select("no", "_n", F.col("feature").alias("_f"), F.col("vec").alias("_a"))
    both = x.withColumn("_p", at(1)).join(placed, "_p")
    return both.filter("_f <> feature").select("no", cosine("_a", "vec").alias("cos"))


def probe(m1: DataFrame, anti: DataFrame, null: DataFrame) -> DataFrame:
    """(id, m1, z, p, margin): place of each formula's cosine in the null distribution, and its margin over the negated one (id, anti).

    ``null`` is a sample of a given size (``null_cosines``): one sorted array, which every formula looks into.
    """
    stats = null.agg(F.avg("cos").alias("_m"), F.stddev_pop("cos").alias("_s"), F.sort_array(F.collect_list("cos")).alias("_all"))
    out = m1.crossJoin(F.broadcast(stats)).join(anti, "id", "left")
    share = F.try_divide(F.size(F.filter("_all", lambda x: x >= F.col("m1"))), F.size("_all"))
    return out.select("id", "m1", F.try_divide(F.col("m1") - F.col("_m"), F.col("_s")).alias("z"), share.alias("p"), (F.col("m1") - F.col("anti")).alias("margin"))


def mann_whitney(rows: DataFrame, x: str, first: str) -> DataFrame:
    """One row: U of the rows where ``first`` holds, one-sided p by the normal approximation, and the means of both groups."""
    s = ranked(rows.withColumn("_g", F.expr(first)), x, name="_r").agg(
        F.sum(F.when(F.col("_g"), F.col("_r"))).alias("_w"), F.count_if(F.col("_g")).alias("n1"), F.count_if(~F.col("_g")).alias("n0"),
        F.avg(F.when(F.col("_g"), F.col(x))).alias("mean1"), F.avg(F.when(~F.col("_g"), F.col(x))).alias("mean0"),
    )
    s = s.withColumn("u", F.col("_w") - F.col("n1") * (F.col("n1") + 1) / 2)
    z = F.try_divide(F.col("u") - F.col("n1") * F.col("n0") / 2, F.sqrt(F.col("n1") * F.col("n0") * (F.col("n1") + F.col("n0") + 1) / 12))
    # upper tail of the normal distribution by a rational approximation (absolute error below 7.5e-8)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / F.sqrt(2 * F.pi()) * poly
    return s.select("u", F.when(z >= 0, tail).otherwise(1 - tail).alias("p"), "mean1", "mean0", "n1", "n0")


def mine_references(texts: DataFrame, pattern: str, covered: DataFrame) -> DataFrame:
    """(id, ref): references found by the pattern in descriptions (id, text), minus the covered pairs."""
    found = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("ref")).distinct()
    return found.join(covered, ["id", "ref"], "left_anti")


def verify_pairs(pairs: DataFrame, known_a: DataFrame, known_b: DataFrame) -> DataFrame:
    """Pairs (a, b) with ``reason``: null where both sides are known, else which one is not."""
    x = known_a.select("a").distinct().withColumn("_ka", F.lit(True))
    y = known_b.select("b").distinct().withColumn("_kb", F.lit(True))
    joined = pairs.join(x, "a", "left").join(y, "b", "left")
    reason = F.when(F.col("_ka").isNull() & F.col("_kb").isNull(), "both unknown").when(F.col("_ka").isNull(), "a unknown").when(F.col("_kb").isNull(), "b unknown")
    return joined.select("a", "b", reason.alias("reason"))
