"""Line deduplication by distinct-site spread.

A line (without spaces, tabs and carriage returns at its ends) is boilerplate
if it stands on ``min_sites`` different sites or more. A HyperLogLog sketch of
the sites of each line hash is merged by aggregation; lines whose estimate is
near the threshold get exact distinct counts. The first copy of a boilerplate
line (smallest document, then place) stays, all others go. Only DataFrame
functions are used, and no line travels as text: the shuffles carry hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import discard, free_names, stored

#: Sub-keys that the rows of one line hash are dealt to in joins, so that a very common line is no hot key.
SALTS = 32
_EDGE = " \t\r"


def _key(id_col: str, text_col: str) -> list[Column]:
    """The row key: the id (null has a flag of its own) and a hash of the text."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.col(id_col).isNull(), F.xxhash64(F.col(text_col))]


_KEY = ["__id", "__null", "__text"]


def line_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(key, pos, site, h1, h2) of each line that is not blank; 128 bits name a line."""
    lines = docs.select(*[k.alias(n) for k, n in zip(_key(id_col, text_col), _KEY)], F.xxhash64(site_col).alias("site"), F.col(site_col).isNotNull().alias("known"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    bare = F.btrim("line", F.lit(_EDGE))
    return lines.withColumn("line", bare).where("line <> ''").select(*_KEY, "pos", F.when(F.col("known"), F.col("site")).alias("site"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _salt() -> Column:
    return F.pmod(F.xxhash64("__id", "pos"), F.lit(SALTS)).cast("int")


def _salted(keys: DataFrame) -> DataFrame:
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def wide_lines(places: DataFrame, min_sites: int, lg_k: int = 12, band: float = 0.25) -> DataFrame:
    """(h1, h2, first, near): lines whose sketch says that they stand on ``min_sites`` sites or nearly so.

    ``first`` is the copy that stays; ``near`` marks estimates within ``band`` of the
    threshold (many times the sketch's error), which need an exact count. Lines
    without a known site have spread 0.
    """
    spread = places.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"),
        F.min(F.struct("__null", "__id", "__text", "pos")).alias("first"),
        F.count("*").alias("n"),
    )
    wide = spread.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites * (1 - band)))
    return wide.select("h1", "h2", "first", (F.col("sites") <= min_sites * (1 + band)).alias("near"))


def boilerplate_places(places: DataFrame, min_sites: int, made: list[str]) -> DataFrame:
    """The places of boilerplate lines that go: all but each line's first copy.

    The texts are split twice, for the sketches and for the places of the few wide
    lines, which are kept in a table: the exact counts of near lines and the
    result both come from it.
    """
    wide = stored(wide_lines(places, min_sites), "wide-lines", made)
    seen = stored(places.withColumn("salt", _salt()).join(_salted(wide).hint("merge"), ["h1", "h2", "salt"]), "wide-places", made)
    exact = seen.where("near and site is not null").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    few = wide.where("near").join(exact.where(F.col("sites") >= min_sites), ["h1", "h2"], "left_anti").select("h1", "h2")
    return seen.where(F.struct("__null", "__id", "__text", "pos") != F.col("first")).join(_salted(few), ["h1", "h2", "salt"], "left_anti")


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """All columns of ``docs``, with the text without its boilerplate lines, and n_lines and n_removed.

    Blank lines stay and don't count in n_lines. A null text stays null with
    counts 0. Rows that agree in id and text count as one document and are
    treated alike. A line's first copy stays, so a document of which there are
    copies on many sites stays whole once. Columns named n_lines or n_removed are
    replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    places = line_places(docs, id_col, text_col, site_col)
    made: list[str] = []
    gone = boilerplate_places(places, min_sites, made).groupBy(*_KEY).agg(F.array_sort(F.collect_set("pos")).alias("places"))
    gone = stored(gone, "boilerplate")
    discard(docs.sparkSession, made)
    *keys, places = free_names(docs, *_KEY, "places")  # the table may have any columns
    gone = gone.toDF(*keys, places)
    both = docs.withColumns(dict(zip(keys, _key(id_col, text_col)))).join(gone.hint("merge"), keys, "left")
    lines = F.split(F.col(text_col), "\n")
    d, n = F.col(places), F.size(lines)
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(d, k - 1))
    after = lambda k: F.coalesce(F.get(d, k), n)
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(d)), lambda k: F.slice(lines, before(k) + 2, after(k) - before(k) - 1)))
    solid = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(_EDGE)) != ""))
    return both.select(
        *[F.when(d.isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(solid).cast("long").alias("n_lines"),
        F.coalesce(F.size(d), F.lit(0)).cast("long").alias("n_removed"),
    )


def op3_line_spread(spark, sf_dir: str) -> DataFrame:
    """Every document with the count of its boilerplate lines and a digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), solid AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM lines
), spread AS (
  SELECT bare, min({'d': doc_id, 'p': pos}) AS first FROM solid WHERE bare <> ''
  GROUP BY bare HAVING count(DISTINCT source) >= 10
), judged AS (
  SELECT s.*, b.bare IS NOT NULL AND {'d': doc_id, 'p': pos} <> b.first AS gone
  FROM solid s LEFT JOIN spread b USING (bare)
)
SELECT d.doc_id, coalesce(count(*) FILTER (bare <> ''), 0) AS n_lines, coalesce(count(*) FILTER (gone), 0) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""


def lines_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines; a document goes if no word is left, as its lines stay elsewhere.

    All columns stay, ``n_chars`` is counted anew where lines went. Null and empty
    texts lose nothing and stay; repeated rows are treated alike; lines without a
    source count no site. An empty table gives no rows.
    """
    out = remove_boilerplate(docs)
    out = out.where((F.col("n_removed") == 0) | (F.btrim(F.replace("text", F.lit("\n"), F.lit(" "))) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
