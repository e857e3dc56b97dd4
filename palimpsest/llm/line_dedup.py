"""Line dedup by distinct-site spread.

Every line hash gets a HyperLogLog sketch of the sites (sources) it appears on; sketches are merged by aggregation,
partially before the shuffle. Lines whose estimate is far from the threshold are decided by it, lines near it get exact
distinct counts. A line that spreads over enough sites is boilerplate: its first occurrence stays, the others go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.scratch import stash

#: Sites from which on a line counts as boilerplate.
LEAST_SITES = 10
#: log2 of the registers of a sketch; its relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 12


def lines_of(df: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per line that isn't blank: id, tie (a hash of the whole text, which tells rows apart that share an id), line
    (its number from 0), h1, h2 (128 bits of its trimmed text), site."""
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(site_col).alias("site"), F.split(F.col(text_col), "\n").alias("all"))
    lines = docs.select("id", "tie", "site", F.posexplode("all").alias("line", "raw")).withColumn("key", F.trim("raw")).filter("key <> ''")
    site = F.coalesce(F.concat(F.lit("="), F.col("site")), F.lit(""))
    return lines.select("id", "tie", "line", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(LG_K), F.reverse("key")).alias("h2"), site.alias("site"))


def removed_lines(df: DataFrame, id_col: str, text_col: str, site_col: str, least_sites: int) -> DataFrame:
    """One row per id and tie that loses lines: id, tie and gone, the numbers of those lines."""
    lines = stash(lines_of(df, id_col, text_col, site_col), "lines")
    key, margin = ["h1", "h2"], 4 * 1.04 / 2 ** (LG_K / 2)
    near = (F.col("sites") >= least_sites * (1 - margin) - 1) & (F.col("sites") < least_sites * (1 + margin) + 1)
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "line", "tie")).alias("first")
    spread = lines.groupBy(*key).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), first)
    spread = stash(spread.filter(F.col("sites") >= least_sites * (1 - margin) - 1), "spread")
    exact = lines.join(spread.filter(near).select(*key), key, "left_semi").groupBy(*key, "site").agg(F.lit(1)).groupBy(*key).agg(F.count(F.lit(1)).alias("exact"))
    common = spread.filter(~near).select(*key, "first").unionByName(spread.join(exact.filter(F.col("exact") >= least_sites), key).select(*key, "first"))
    common = stash(common, "boilerplate")
    hits = lines.join(common, key).filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("line") == F.col("first.line")) & (F.col("tie") == F.col("first.tie"))))
    return hits.groupBy("id", "tie").agg(F.collect_set("line").alias("gone"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least_sites: int = LEAST_SITES) -> DataFrame:
    """The input with boilerplate lines taken out of its text, and n_lines, n_removed (long).

    A line is what stands between line feeds; it is compared without blanks around it, and blank lines stay. A line on
    least_sites or more distinct sites is boilerplate (null is a site of its own); the occurrence with the smallest id
    and line number stays, every other is removed. A document that loses all lines has an empty text. A null text stays
    null with no lines, an empty text has one blank line. A null id comes last. Rows that share an id, null too, are told
    apart by their texts; those that repeat both are one document and keep or lose the same lines. Columns named n_lines
    or n_removed are replaced, others pass through. An empty table gives an empty result.
    """
    gone = removed_lines(df, id_col, text_col, site_col, least_sites).select(F.col("id").alias("__of"), F.col("tie").alias("__tie"), F.col("gone").alias("__gone"))
    same = F.col(id_col).eqNullSafe(F.col("__of")) & (F.xxhash64(text_col) == F.col("__tie"))
    out = df.drop("n_lines", "n_removed").join(gone.hint("shuffle_hash"), same, "left")
    lines = F.split(F.col(text_col), "\n")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("__gone", i)), "\n")
    out = out.withColumn("n_lines", F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(lines)), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    return out.withColumn(text_col, F.when(F.col("n_removed") > 0, left).otherwise(F.col(text_col))).drop("__of", "__tie", "__gone")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = {
    "op5_line_dedup": f"""
        WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS site, string_split(text, chr(10)) AS a FROM documents),
        l AS (SELECT doc_id, site, generate_subscripts(a, 1) AS i, unnest(a) AS raw FROM d),
        k AS (SELECT doc_id, i, raw, trim(raw, ' ') AS key, site FROM l),
        b AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= {LEAST_SITES}),
        r AS (SELECT k.*, b.key IS NOT NULL AND row_number() OVER (PARTITION BY k.key ORDER BY doc_id, i) > 1 AS gone
              FROM k LEFT JOIN b ON k.key = b.key),
        g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
                     coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents LEFT JOIN g ON documents.doc_id = g.doc_id"""
}
QUERIES = {"op5_line_dedup": op5_line_dedup}
