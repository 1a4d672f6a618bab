"""Joins, roll-ups and checks over documents, jobs and references; each check returns the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.storage import stored
from lectern.operators.chunking import chunk_documents
from lectern.operators.text import chunk_uuid

#: What a failure kind means (fixed values); anything else is FATAL.
FAILURE_RULES = (("error", "TRANSIENT", "PROVIDER_ERROR"), ("click", "TRANSIENT", "TIMEOUT"), ("purchase", "FATAL", "INVALID_CONTENT"))


# ---- scans and writes


def scan_blocks(blocks: DataFrame, material: str, first: int, last: int) -> DataFrame:
    """Blocks of page texts and tables of a page range, in reading order: a page's text, then its tables, each by ordinal.

    Pages count from 1 and the range isn't empty, else an error. The filters reach the scan.
    """
    if first < 1 or last < first:
        raise ValueError("not a range of pages")
    wanted = (F.col("material_id") == material) & F.col("page_number").between(first, last) & F.col("block_type").isin("PAGE_TEXT", "TABLE_TEXT")
    return blocks.where(wanted).orderBy("page_number", F.col("block_type") != "PAGE_TEXT", "ordinal")


def eligible_versions(versions: DataFrame) -> DataFrame:
    """Versions fit for processing: not deleted, of a PDF, with a key, a size and pages."""
    return versions.where((F.col("status") != "DELETED") & (F.col("content_type") == "application/pdf") & (F.trim("storage_key") != "") & (F.col("size") > 0) & (F.col("page_count") > 0))


def content_addressed(items: DataFrame, version: str, page: str, content: str) -> DataFrame:
    """(version, page, storage_key): one row for each content of a page."""
    h = F.sha2(F.col(content).cast("binary"), 256)
    return items.select(F.col(version).alias("version"), F.col(page).alias("page"), h.alias("h")).distinct().select("version", "page", F.concat_ws("/", F.lit("materials"), "version", F.lit("visuals"), F.col("page").cast("string"), "h").alias("storage_key"))


def append_or_verify(existing: DataFrame, drafts: DataFrame, keys: list[str]) -> DataFrame:
    """Drafts with ``state``: NEW, SAME, or CONFLICT if the key is there with other values."""
    values = [c for c in drafts.columns if c not in keys]
    old = existing.select(*keys, F.struct(*values).alias("__old"), F.lit(True).alias("__there"))
    state = F.when(F.col("__there").isNull(), "NEW").when(F.struct(*values).eqNullSafe(F.col("__old")), "SAME").otherwise("CONFLICT")
    return drafts.join(old, keys, "left").withColumn("state", state).drop("__old", "__there")


def upsert_nullsafe(existing: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both tables by key (nulls equal); where both have one, the new value stays."""
    both = existing.select(*keys, F.struct(F.lit(0).alias("age"), F.col(value)).alias("v")).unionByName(new.select(*keys, F.struct(F.lit(1).alias("age"), F.col(value)).alias("v")))
    return both.groupBy(*keys).agg(F.max("v").alias("v")).select(*keys, F.col(f"v.{value}").alias(value))


def apply_deletes(materials: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes of delete requests (material_id, owner_id), and the materials after them."""
    m = materials.select("material_id", F.col("owner_id").alias("__o"), F.col("status").alias("__s"))
    joined = requests.join(m, "material_id", "left")
    outcome = F.when(~F.col("owner_id").eqNullSafe(F.col("__o")), "NOT_FOUND").when(F.col("__s") == "DELETED", "ALREADY_DELETED").otherwise("DELETED")
    results = joined.select("material_id", "owner_id", outcome.alias("outcome"))
    gone = results.where("outcome = 'DELETED'").select("material_id").distinct().withColumn("__d", F.lit(True))
    after = materials.join(gone, "material_id", "left").withColumns({"status": F.when(F.col("__d"), "DELETED").otherwise(F.col("status")), "active_version": F.when(F.col("__d").isNull(), F.col("active_version"))}).drop("__d")
    return results, after


def guarded_insert(requests: DataFrame, parents: DataFrame, existing: DataFrame, parent_key: str, keys: list[str]) -> DataFrame:
    """Requests with CREATED, DUPLICATE (the key is there) or INELIGIBLE (no live parent)."""
    p = parents.select(parent_key).distinct().withColumn("__p", F.lit(True))
    e = existing.select(*keys).distinct().withColumn("__e", F.lit(True))
    out = requests.join(p, parent_key, "left").join(e, keys, "left")
    return out.withColumn("result", F.when(F.col("__p").isNull(), "INELIGIBLE").when(F.col("__e"), "DUPLICATE").otherwise("CREATED")).drop("__p", "__e")


# ---- predicates and derived columns


def invalid_sources(pages: DataFrame) -> DataFrame:
    """Pages whose text isn't valid; what can't be told counts as invalid."""
    ok = (F.trim("content") != "") & (((F.col("extraction_method") == "NATIVE") & F.col("quality").isNull()) | ((F.col("extraction_method") == "OCR") & F.col("quality").isin("STRONG", "LIMITED")))
    return pages.where(~F.coalesce(ok, F.lit(False)))


def evidence_flags(pages: DataFrame) -> DataFrame:
    """Adds usable and limited; a native page without a quality is usable."""
    native, q = F.col("extraction_method") == "NATIVE", F.col("quality")
    return pages.withColumns({"usable": F.coalesce(native & q.isNull(), F.lit(False)) | F.coalesce(q.isin("STRONG", "LIMITED"), F.lit(False)), "limited": F.coalesce(q.isin("LIMITED", "POOR"), F.lit(False))})


def derived_columns(jobs: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """Adds a shown stage name, a single page only where the range is one, and the first text that isn't blank."""
    shown = F.concat(F.substring("stage", 1, 1), F.lower(F.substring("stage", 2, 100)))
    page = F.when(F.col("start_page") == F.col("end_page"), F.col("start_page"))
    return jobs.select("event_id", shown.alias("stage_name"), page.alias("single_page"), F.coalesce(F.nullif(F.trim("note"), F.lit("")), F.col("status")).alias("note"), (F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))).cast("long").alias("stage_no"))


def job_progress(log: DataFrame) -> DataFrame:
    """(job_id, event_id, progress): percent cut to two places that never falls; 100 where the total is 0."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    now = F.when(F.col("total") == 0, F.lit(100.0)).otherwise(F.floor(F.col("current") * 10000.0 / F.col("total")) / 100)
    return log.select("job_id", "event_id", F.max(now).over(w).alias("progress"))


def retry_due(jobs: DataFrame, initial: int = 5, most: int = 300) -> DataFrame:
    """Adds the delay and due time of the next try: doubling from ``initial`` to ``most`` seconds."""
    delay = F.least(F.lit(most).cast("double"), initial * F.pow(F.lit(2.0), F.least(F.lit(30), F.col("attempt") - 1))).cast("long")
    return jobs.withColumn("delay", delay).withColumn("due", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("delay").cast("decimal(18,6)")))


def classify_failures(failures: DataFrame, rules: tuple = FAILURE_RULES) -> DataFrame:
    """Adds the kind and code of a failure by a small table of rules; FATAL and UNKNOWN if none fits."""
    table = failures.sparkSession.createDataFrame(list(rules), "failure string, kind string, code string")
    return failures.join(F.broadcast(table), "failure", "left").withColumns({"kind": F.coalesce("kind", F.lit("FATAL")), "code": F.coalesce("code", F.lit("UNKNOWN"))})


# ---- joins


def chunk_corpus(chunks: DataFrame, versions: DataFrame, materials: DataFrame) -> DataFrame:
    return chunks.join(versions, "version_id").join(materials, "material_id")


def authorized_targets(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets without a node, or whose node is of the same material."""
    n = nodes.select(F.col("node_id"), F.col("material_id").alias("__m"))
    return targets.join(n, "node_id", "left").where(F.col("node_id").isNull() | (F.col("__m") == F.col("material_id"))).drop("__m")


def resolve_sources(selections: DataFrame, chunks: DataFrame, visuals: DataFrame) -> DataFrame:
    """Selected materials with a chunk of text, and whether they have visuals and usable ones."""
    solid = chunks.where(F.col("is_active") & (F.trim("content") != "")).select("material_id").distinct()
    v = visuals.groupBy("material_id").agg(F.lit(True).alias("has_visual"), F.bool_or(F.col("status") == "SUPPORTED").alias("has_supported"))
    none = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return selections.join(solid, "material_id", "left_semi").join(v, "material_id", "left").select(*selections.columns, none("has_visual"), none("has_supported"))


#: Levels of the halving of page numbers; ranges may reach up to 2**LEVELS pages.
LEVELS = 31


def _blocks(start: Column, end: Column) -> Column:
    """The fewest aligned blocks (level, block) of 2**level pages that make up start..end: at most two of each level."""

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        low, high = F.ceil((start - 1) / size), F.floor(end / size)
        some = low < high
        cut = lambda block: F.struct(level.cast("int").alias("level"), block.cast("long").alias("block"))
        return F.array(F.when(some & (low % 2 == 1), cut(low)), F.when(some & (high % 2 == 1), cut(high - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at)))


def locate_nodes(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(material_id, page_number, node_id) for each page: the deepest node with it; then the shortest, latest, largest ordinal; else the root.

    Ranges are cut into aligned blocks of pages, and only the best node of a block
    is kept, as all pages of the block lie in all its nodes. A page looks up the
    blocks that it lies in, one for each level that occurs, so the work grows with
    pages plus nodes, whatever the number of ranges over a page. The root is the
    node without a parent (at depth 0 where nodes have no ``parent_id``; the
    smallest id of several); a material without one leaves its pages out unless a
    range has them. Null ranges hold no page; repeated pages give one row.
    """
    order = F.struct("depth", (F.col("start_page") - F.col("end_page")).alias("short"), "start_page", "ordinal", "node_id")
    known = nodes.where("start_page is not null and end_page is not null and start_page >= 1 and start_page <= end_page")
    cut = known.select("material_id", order.alias("node"), F.explode(_blocks(F.col("start_page"), F.col("end_page"))).alias("b"))
    best = cut.groupBy("material_id", "b.level", "b.block").agg(F.max("node").alias("node"))
    levels = sorted(r.level for r in best.select("level").distinct().collect())  # at most LEVELS + 1
    asked = pages.select("material_id", "page_number").distinct()
    page = F.col("page_number")
    looked = asked.select("*", F.explode(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>")).alias("level"))
    looked = looked.where(page >= 1).withColumn("block", F.floor((page - 1) / F.pow(F.lit(2.0), F.col("level"))).cast("long"))
    found = looked.join(best, ["material_id", "level", "block"]).groupBy("material_id", "page_number").agg(F.max("node").alias("node"))
    top = F.col("parent_id").isNull() if "parent_id" in nodes.columns else F.col("depth") == 0
    roots = nodes.where(top).groupBy("material_id").agg(F.min("node_id").alias("root"))
    out = asked.join(found, ["material_id", "page_number"], "left").join(roots, "material_id", "left")
    return out.select("material_id", "page_number", F.coalesce("node.node_id", "root").alias("node_id")).where("node_id is not null")


def node_closure(nodes: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(material_id, ancestor, descendant, distance), each node its own ancestor at 0.

    One join a level, until a level is empty. A node above itself, or an outline
    deeper than ``max_depth``, is an error.
    """
    edges = nodes.select("material_id", F.col("parent_id").alias("p"), F.col("node_id").alias("c")).where("p is not null")
    level = nodes.select("material_id", F.col("node_id").alias("ancestor"), F.col("node_id").alias("descendant"), F.lit(0).cast("long").alias("distance"))
    out = [level]
    while True:
        level = level.join(edges, (edges["material_id"] == level["material_id"]) & (edges["c"] == level["ancestor"])).select(level["material_id"], F.col("p").alias("ancestor"), "descendant", (F.col("distance") + 1).alias("distance"))
        level = stored(level, "closure")
        rows, loops = level.agg(F.count("*"), F.count_if(F.col("ancestor") == F.col("descendant"))).first()
        if not rows:
            return reduce(DataFrame.unionByName, out)
        if loops or len(out) > max_depth:
            raise ValueError("a node is its own ancestor" if loops else f"the outline is deeper than {max_depth}")
        out.append(level)


def heading_paths(nodes: DataFrame) -> DataFrame:
    """(node_id, path): titles from the root down, blank ones left out."""
    c = node_closure(nodes)
    titles = nodes.select(F.col("node_id").alias("ancestor"), "title", "depth")
    parts = c.join(titles, "ancestor").where(F.trim("title") != "")
    return parts.groupBy(F.col("descendant").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "title"))), lambda x: x["title"]), " > ").alias("path"))


def outline_tree(nodes: DataFrame) -> DataFrame:
    """(material_id, node_id, depth, place): nodes in reading order, from the ordinals on the way down."""
    c = node_closure(nodes)
    ords = nodes.select(F.col("node_id").alias("ancestor"), F.coalesce("ordinal", F.lit(2**31)).alias("ordinal"), F.col("depth").alias("d"))
    key = c.join(ords, "ancestor").groupBy("material_id", F.col("descendant").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("d", "ordinal"))).alias("k"), F.max("d").alias("depth"))
    w = Window.partitionBy("material_id").orderBy("k", "node_id")
    return key.select("material_id", "node_id", "depth", F.row_number().over(w).cast("long").alias("place"))


def link_visuals(chunks: DataFrame, visuals: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunk_id, visual_id) where the visual's page is one of the chunk's and its node lies under the chunk's."""
    mine = F.col("primary_pages") if "primary_pages" in chunks.columns else F.sequence("start_page", "end_page")
    pages = chunks.select("chunk_id", "material_id", F.col("node_id").alias("ancestor"), F.explode(mine).alias("page_number"))
    v = visuals.select("visual_id", "material_id", "page_number", F.col("node_id").alias("descendant"))
    return pages.join(v, ["material_id", "page_number"]).join(node_closure(nodes).drop("distance"), ["material_id", "ancestor", "descendant"]).select("chunk_id", "visual_id").distinct()


def chunk_material_text(pages: DataFrame, nodes: DataFrame, visuals: DataFrame, target: int = 800, hard: int = 1000, overlap: int = 100) -> DataFrame:
    """The whole chunking job: pages to chunks with number, id, node, heading path and the visuals of their pages under their node."""
    chunks = stored(chunk_documents(pages, locate_nodes(pages, nodes), target, hard, overlap), "chunks")
    paths = heading_paths(nodes).select("node_id", F.col("path").alias("heading_path"))
    linked = link_visuals(chunks, visuals, nodes).groupBy("chunk_id").agg(F.array_sort(F.collect_set("visual_id")).alias("visual_ids"))
    return chunks.join(paths, "node_id", "left").join(linked, "chunk_id", "left").withColumn("visual_ids", F.coalesce("visual_ids", F.array()))


def resolve_references(refs: DataFrame, materials: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """References of which every named target (null: not named) still is there and active."""
    out = refs
    for col, table in (("material_id", materials), ("node_id", nodes), ("chunk_id", chunks)):
        there = table.select(F.col(col)).distinct().withColumn(f"__{col}", F.lit(True))
        out = out.join(there, col, "left").where(F.col(col).isNull() | F.col(f"__{col}")).drop(f"__{col}")
    return out


def is_latest_version(versions: DataFrame) -> DataFrame:
    """Adds whether no newer version of the material exists."""
    return versions.withColumn("is_latest", F.col("version") == F.max("version").over(Window.partitionBy("material_id")))


def validate_grounding(citations: DataFrame, prompted: DataFrame, evidence: DataFrame, current: DataFrame) -> DataFrame:
    """(answer_id, source_id, reason): the first check that a citation fails, null if none."""
    flag = lambda t, n, on: t.select(*on).distinct().withColumn(n, F.lit(True))
    both = ["answer_id", "source_id"]
    out = citations.join(flag(prompted, "p", both), both, "left").join(flag(evidence, "e", both), both, "left").join(flag(current, "c", ["source_id"]), "source_id", "left")
    reason = F.when(F.col("source_id").isNull(), "MISSING_ID").when(F.col("p").isNull(), "NOT_PROMPTED").when(F.col("e").isNull(), "NOT_IN_EVIDENCE").when(F.col("c").isNull(), "NOT_CURRENT")
    return out.select("answer_id", "source_id", reason.alias("reason"))


# ---- aggregations


def stage_summary(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("job_id").agg(F.count("*").alias("rows"), F.count_distinct("stage").alias("stages"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"))


def page_set_check(pages: DataFrame) -> DataFrame:
    """One row a material: whether its pages are exactly 1 to n and all valid."""
    return pages.groupBy("material_id").agg(
        F.count("*").alias("pages"), F.min("page_number").alias("first"), F.max("page_number").alias("last"), F.bool_and(F.coalesce(F.trim("content") != "", F.lit(False))).alias("valid"),
        ((F.min("page_number") == 1) & (F.max("page_number") == F.count("*")) & (F.count_distinct("page_number") == F.count("*"))).alias("complete"))


def table_set_check(materials: DataFrame, tables: DataFrame, nodes: DataFrame) -> DataFrame:
    """(material_id, tables, valid): every table's node is of its material; true without tables."""
    n = nodes.select("node_id", F.col("material_id").alias("__m"))
    good = tables.join(n, "node_id", "left").withColumn("ok", F.coalesce(F.col("__m") == F.col("material_id"), F.lit(False)))
    g = good.groupBy("material_id").agg(F.count("*").alias("tables"), F.bool_and("ok").alias("valid"))
    return materials.select("material_id").distinct().join(g, "material_id", "left").select("material_id", F.coalesce("tables", F.lit(0)).alias("tables"), F.coalesce("valid", F.lit(True)).alias("valid"))


def link_gaps(links: DataFrame, group: str, position: str) -> DataFrame:
    """Groups whose positions aren't 1 to n without a gap or repeat."""
    g = links.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(position).alias("d"), F.min(position).alias("lo"), F.max(position).alias("hi"))
    return g.where("lo <> 1 or hi <> n or d <> n").select(group, "n", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


def chunk_sequence_check(chunks: DataFrame, version_col: str = "material_id", uuid_col: str | None = None) -> DataFrame:
    """(chunk_id, chunk_index, place, reason): chunks whose index isn't their place in the material, or whose id isn't that of version and index."""
    w = Window.partitionBy("material_id").orderBy("chunk_index", "chunk_id")
    wrong = F.col(uuid_col) != chunk_uuid(F.col(version_col), F.col("chunk_index") + 1) if uuid_col else F.lit(False)
    reason = F.when(F.col("place") != F.col("chunk_index"), "POSITION").when(wrong, "ID")
    placed = chunks.withColumn("place", F.row_number().over(w).cast("long") - 1)
    return placed.withColumn("reason", reason).where("reason is not null").select("chunk_id", "chunk_index", "place", "reason")


def quality_profile(pages: DataFrame) -> DataFrame:
    return pages.groupBy("extraction_method", "quality").agg(F.count("*").alias("pages"))


def worst_quality(parts: DataFrame, group: str) -> DataFrame:
    """The worst quality of each group; nulls don't count."""
    rank = F.when(F.col("quality") == "STRONG", 0).when(F.col("quality") == "LIMITED", 1).when(F.col("quality") == "POOR", 2)
    names = F.array(F.lit("STRONG"), F.lit("LIMITED"), F.lit("POOR"))
    return parts.groupBy(group).agg(F.max(rank).alias("r")).select(group, F.when(F.col("r").isNotNull(), F.get(names, F.col("r"))).alias("quality"))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, grouping, a column for each share): exact quantiles of all sub-totals of ``keys``, as by ROLLUP.

    ``grouping`` has a bit for each key that is added up. The quantile of a share p
    is the smallest value with at least p * n values up to it; nulls don't count.
    Equal values are counted together first; the counts are dealt by ranges of
    (sub-total, value), and each range adds the counts of the ranges before it, so
    no task sees a whole group, whatever its size.
    """
    sets = [F.struct(*[(F.col(k) if i < n else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for i, k in enumerate(keys)], F.lit((1 << len(keys) - n) - 1).cast("long").alias("grouping")) for n in range(len(keys) + 1)]
    group = [*keys, "grouping"]
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    each = counted.select(value, "n", F.explode(F.array(*sets)).alias("g")).groupBy("g", value).agg(F.sum("n").alias("n")).select("g.*", F.col(value).alias("v"), "n")
    ranged = stored(each.repartitionByRange(*group, "v").withColumn("range", F.spark_partition_id()), "value-ranges")
    parts = ranged.groupBy(*group, "range").agg(F.sum("n").alias("held"))
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumns({"before": F.coalesce(F.sum("held").over(before), F.lit(0)), "total": F.sum("held").over(Window.partitionBy(*group))})
    upto = F.sum("n").over(Window.partitionBy(*group, "range").orderBy("v"))
    a, b = ranged.withColumn("upto", upto).alias("a"), offsets.alias("b")
    on = [F.col("a.range") == F.col("b.range"), *[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in group]]
    seen = a.join(b, on).select(*[F.col(f"a.{k}") for k in group], "v", (F.col("upto") + F.col("before")).alias("upto"), "total")
    least = {name: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p), F.col("v"))).alias(name) for name, p in shares.items()}
    return seen.groupBy(*group).agg(*least.values())


_USAGE = ("provider", "task", "status")


def usage_rollup(requests: DataFrame) -> DataFrame:
    """Counts, latencies, failures, tokens, cost and retries by provider, task and status, with sub-totals; the percentiles are exact at every size."""
    sums = requests.rollup(*_USAGE).agg(
        F.grouping_id().alias("grouping"), F.count("*").alias("requests"), F.round(F.avg("latency"), 6).alias("mean_latency"),
        F.count_if(F.col("status") == "FAILED").alias("failures"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"), F.sum("retries").alias("retries"), F.count_if(F.col("retries") > 0).alias("retried"))
    exact = exact_quantiles(requests, list(_USAGE), "latency", {"median_latency": 0.5, "p95_latency": 0.95})
    a, b = sums.alias("a"), exact.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*_USAGE, "grouping")], "left")
    return both.select(*[F.col(f"a.{k}") for k in (*_USAGE, "requests", "mean_latency")], "median_latency", "p95_latency", *[F.col(f"a.{k}") for k in ("failures", "tokens", "cost", "retries", "retried")])


def usage_sketches(requests: DataFrame, every: str = "1 hour", k: int = 400) -> DataFrame:
    """(provider, task, status, since, requests, sketch): counts and quantile sketches of the latencies of each stretch of time.

    What ``roll_up_sketches`` adds up later, so a roll-up over years reads sketches
    of bounded size and no request again. Null latencies are in the count only.
    """
    since = F.window("ts", every)["start"].alias("since")
    return requests.groupBy(*_USAGE, since).agg(F.count("*").alias("requests"), F.kll_sketch_agg_double("latency", F.lit(k)).alias("sketch"))


def roll_up_sketches(sketches: DataFrame, keys: tuple[str, ...] = _USAGE, shares: dict[str, float] | None = None, k: int = 400) -> DataFrame:
    """(keys, requests, values, one column a share) with sub-totals, from merged sketches.

    A quantile's rank is off by about 1 % of the group's values at ``k`` = 400, at
    any number of merges; null where a group has no value.
    """
    shares = shares or {"median_latency": 0.5, "p95_latency": 0.95}
    merged = sketches.rollup(*keys).agg(F.sum("requests").alias("requests"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    n = F.kll_sketch_get_n_double("sketch")
    return merged.select(*keys, "requests", n.alias("values"), *[F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(name) for name, p in shares.items()])


def transition_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("stage", "status").agg(F.count("*").alias("n"))


def derive_readiness(facts: DataFrame) -> DataFrame:
    """Adds the state from facts: failed, started, stages_done, provenance, usable, limited and the index's state."""
    state = (
        F.when(F.col("failed") | (F.col("index_state") == "FAILED"), "FAILED").when(~F.col("started"), "UPLOADED").when(F.col("stages_done") < 6, "PROCESSING")
        .when(~F.col("provenance") | ~F.col("usable"), "FAILED").when(F.col("index_state") != "SATISFIED", "PROCESSING").when(F.col("limited"), "PARTIALLY_READY").otherwise("READY")
    )
    return facts.withColumn("state", state)


def parent_status(versions: DataFrame) -> DataFrame:
    """Adds ``parent``: the material's status after one of its versions got ``state``.

    A deleted material stays so. A failed version fails the material unless
    another version is active and ready, whose status then stays; any other state
    is the material's own.
    """
    active, same = F.col("active_version").isNotNull(), F.col("active_version").eqNullSafe(F.col("version"))
    ready = active & ~same & F.col("active_status").isin("READY", "PARTIALLY_READY")
    parent = F.when(F.col("current_parent").eqNullSafe("DELETED"), "DELETED").when((F.col("state") == "FAILED") & F.coalesce(ready, F.lit(False)), F.col("active_status")).otherwise(F.col("state"))
    return versions.withColumn("parent", parent)


def preferred_generation(generations: DataFrame) -> DataFrame:
    """(model, generation, result): the one active generation, else the one being built, else a conflict or none."""
    active, building = F.col("status") == "ACTIVE", F.col("status") == "BUILDING"
    g = generations.groupBy("model").agg(F.count_if(active).alias("a"), F.count_if(building).alias("b"), F.max(F.when(active, F.col("generation"))).alias("ga"), F.max(F.when(building, F.col("generation"))).alias("gb"))
    result = F.when(F.col("a") > 1, "CONFLICT").when(F.col("a") == 1, "ACTIVE").when(F.col("b") > 1, "CONFLICT").when(F.col("b") == 1, "BUILDING").otherwise("NONE")
    return g.withColumn("result", result).select("model", F.when(F.col("result") == "ACTIVE", F.col("ga")).when(F.col("result") == "BUILDING", F.col("gb")).alias("generation"), "result")


def embedding_coverage(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    e = embeddings.select("chunk_id").distinct().withColumn("__e", F.lit(True))
    return chunks.where("is_active").join(e, "chunk_id", "left").groupBy("material_id").agg(F.count("*").alias("eligible"), F.count("__e").alias("durable"), F.round(F.count("__e") / F.count("*"), 9).alias("coverage"))


def aggregate_judgments(judgments: DataFrame) -> DataFrame:
    """(answer_id, outcome, missing): from each concept's judgment (SUPPORTED, PARTIAL, MISSING, CONTRADICTED) in order."""
    ordered = F.array_sort(F.collect_list(F.struct("concept_no", "concept", "judgment", "missing_part")))
    g = judgments.groupBy("answer_id", "evaluable").agg(ordered.alias("j"), F.bool_and(F.col("judgment") == "SUPPORTED").alias("all_"), F.bool_or(F.col("judgment").isin("SUPPORTED", "PARTIAL")).alias("some"))
    gap = lambda x: F.when(x["judgment"] == "PARTIAL", F.array(x["missing_part"])).when(x["judgment"].isin("MISSING", "CONTRADICTED"), F.array(x["concept"], x["missing_part"])).otherwise(F.array().cast("array<string>"))
    missing = F.array_distinct(F.array_compact(F.flatten(F.transform("j", gap))))
    outcome = F.when(~F.col("evaluable"), "UNCERTAIN").when(F.col("all_"), "CORRECT").when(F.col("some"), "PARTIAL").otherwise("INCORRECT")
    return g.select("answer_id", outcome.alias("outcome"), F.array_join(F.when(F.col("evaluable"), missing).otherwise(F.array().cast("array<string>")), ",").alias("missing"))


def judgment_violations(judgments: DataFrame, n_concepts: int) -> DataFrame:
    """(answer_id, concept_no, reason) of judgments out of range, repeated, or of a wrong shape."""
    n = F.count("*").over(Window.partitionBy("answer_id", "concept_no"))
    reason = F.when(~F.col("concept_no").between(0, n_concepts - 1), "OUT_OF_RANGE").when(n > 1, "REPEATED").when((F.col("judgment") == "SUPPORTED") & F.col("missing_part").isNotNull(), "SUPPORTED_WITH_GAP").when((F.col("judgment") == "PARTIAL") & F.col("missing_part").isNull(), "PARTIAL_WITHOUT_GAP")
    return judgments.withColumn("reason", reason).where("reason is not null").select("answer_id", "concept_no", "reason")


# ---- windows and top-k


def current_stage(jobs: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """The current row of each job: running first, then retry, pending; then stage order and age."""
    order = F.when(F.col("status") == "RUNNING", 0).when(F.col("status") == "RETRY", 1).when(F.col("status") == "PENDING", 2).otherwise(3)
    w = Window.partitionBy("job_id").orderBy(order, F.array_position(F.array(*map(F.lit, stages)), F.col("stage")), "ts", "event_id")
    return jobs.withColumn("n", F.row_number().over(w)).where("n = 1").select("job_id", "event_id", "stage", "status")


def effective_version(versions: DataFrame) -> DataFrame:
    """The active version of a material, else the highest number."""
    return versions.groupBy("material_id").agg(F.coalesce(F.max(F.when(F.col("active"), F.col("version"))), F.max("version")).alias("version"))


def failure_runs(requests: DataFrame, least: int = 3, window_seconds: int = 15) -> DataFrame:
    """(provider, started, failures, open_until): runs of ``least`` failures or more of a provider."""
    w = Window.partitionBy("provider").orderBy("ts", "event_id")
    run = requests.withColumn("ok", F.sum((F.col("status") != "FAILED").cast("int")).over(w))
    g = run.where("status = 'FAILED'").groupBy("provider", "ok").agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.count("*").alias("failures")).where(F.col("failures") >= least)
    return g.select("provider", "started", "failures", (F.col("last") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(window_seconds).cast("decimal(18,6)"))).alias("open_until"))


def page_of(rows: DataFrame, owner: str, order: list, page: int, size: int) -> DataFrame:
    """The rows of a page of each owner's listing, with total rows and pages."""
    w, all_ = Window.partitionBy(owner).orderBy(*order), Window.partitionBy(owner)
    n = rows.withColumns({"place": F.row_number().over(w).cast("long"), "total": F.count("*").over(all_)})
    return n.where((F.col("place") > page * size) & (F.col("place") <= (page + 1) * size)).withColumn("pages", F.ceil(F.col("total") / size))


def active_listing(children: DataFrame, parents: DataFrame, parent_key: str, name: str, sort_order: str) -> DataFrame:
    """Children of active parents with their place: sort order (nulls last), name, id."""
    live = children.join(parents.where("active").select(parent_key), parent_key, "left_semi")
    w = Window.partitionBy(parent_key).orderBy(F.col(sort_order).asc_nulls_last(), F.lower(name), "id")
    return live.withColumn("place", F.row_number().over(w).cast("long"))


def due_jobs(jobs: DataFrame, now: str, stale_seconds: int = 60, max_attempts: int = 3, materials: DataFrame | None = None) -> DataFrame:
    """Work that may be taken, oldest first (time, then id): pending, retry that is due, or running without a sign of life, with tries left.

    With ``materials`` (material_id, owner_id, status), a job that names a material
    (``material_id``, ``owner_id``) needs it to be there, of the job's owner and not
    DELETED; jobs without a material need none.
    """
    t = F.lit(now).cast("timestamp_ntz")
    old = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(stale_seconds).cast("decimal(18,6)")) < t
    ready = (F.col("status") == "PENDING") | ((F.col("status") == "RETRY") & (F.col("due") <= t)) | ((F.col("status") == "RUNNING") & old)
    due = jobs.where(ready & (F.col("attempt") < max_attempts))
    if materials is not None:
        live = materials.where("status <> 'DELETED'").select("material_id", "owner_id").distinct()
        due = due.where("material_id is not null").join(live, ["material_id", "owner_id"], "left_semi").select(due.columns).unionByName(due.where("material_id is null"))
    return due.select("event_id", "job_id", "status", "ts").orderBy("ts", "event_id")


def rank_providers(candidates: DataFrame) -> DataFrame:
    """(task, provider, fallback): the cheapest eligible provider, then the fastest; the fallback is the first of another one."""
    w = Window.partitionBy("task").orderBy("cost", "latency", "provider")
    r = candidates.where("available").withColumn("n", F.row_number().over(w))
    best = F.min_by("provider", "n")
    first = r.groupBy("task").agg(best.alias("provider"))
    other = r.join(first.withColumnRenamed("provider", "__p"), "task").where("provider <> __p").groupBy("task").agg(best.alias("fallback"))
    return first.join(other, "task", "left")


def set_mismatches(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose two sets of values differ."""
    sets = lambda t, n: t.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(n))
    return sets(a, "x").join(sets(b, "y"), key, "full").where(~F.col("x").eqNullSafe(F.col("y"))).select(key)


def outside_references(cited: DataFrame, supplied: DataFrame, keys: list[str]) -> DataFrame:
    return cited.join(supplied, keys, "left_anti").select(*keys).distinct()


# ---- outputs


def response_contracts(artifacts: DataFrame) -> DataFrame:
    """(id, question, expected, concepts) from JSON; concepts fall back to concept, then to the from/to pair."""
    j = F.from_json("payload", "question string, expectedAnswer string, concepts array<string>, concept string, `from` string, `to` string")
    solid = lambda a: F.filter(a, lambda x: F.trim(x) != "")
    pick = F.when(F.size(solid(F.col("j.concepts"))) > 0, solid(F.col("j.concepts"))).when(F.trim("j.concept") != "", F.array("j.concept")).otherwise(F.array_compact(F.array("j.from", "j.to")))
    rows = artifacts.withColumn("j", j).where((F.trim("j.question") != "") & (F.trim("j.expectedAnswer") != ""))
    return rows.select("id", F.col("j.question").alias("question"), F.col("j.expectedAnswer").alias("expected"), F.array_join(pick, ",").alias("concepts"))


def validate_outputs(outputs: DataFrame) -> DataFrame:
    """(id, reason) of model outputs that are malformed or break a rule of multiple choice; null if fine."""
    j = F.from_json("payload", "options array<struct<id:string,text:string>>, correct string")
    ids = F.transform("j.options", lambda x: x["id"])
    reason = F.when(F.get_json_object("payload", "$").isNull(), "MALFORMED").when(F.col("j.options").isNull() | F.col("j.correct").isNull(), "MISMATCH").when(F.size(ids) != F.size(F.array_distinct(ids)), "REPEATED_OPTION").when(~F.array_contains(ids, F.col("j.correct")), "NO_CORRECT_OPTION")
    return outputs.withColumn("j", j).select("id", reason.alias("reason"))


# ---- checks


def cycle_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that are their own ancestor.

    A jump goes 2**k parents up, by joining jumps of half the size, until it is
    longer than the largest outline has nodes: only cycles are left to land on.
    """
    jump = stored(nodes.select("material_id", F.col("node_id").alias("a"), F.col("parent_id").alias("b")).where("b is not null"), "jumps")
    most = jump.groupBy("material_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        half = jump.select("material_id", F.col("a").alias("b"), F.col("b").alias("c"))
        jump = stored(jump.join(half, ["material_id", "b"]).select("material_id", "a", F.col("c").alias("b")), "jumps")
    return jump.select(F.col("b").alias("node_id")).distinct()


def outline_violations(nodes: DataFrame) -> DataFrame:
    """(rule, node_id): more or fewer than one root, siblings with one ordinal, a range outside the parent's."""
    roots = nodes.groupBy("material_id").agg(F.count_if(F.col("node_type") == "DOCUMENT").alias("n")).where("n <> 1").select(F.lit("ROOT").alias("rule"), F.col("material_id").alias("node_id"))
    n = F.count("*").over(Window.partitionBy("material_id", "parent_id", "ordinal"))
    twins = nodes.withColumn("n", n).where("n > 1").select(F.lit("ORDINAL").alias("rule"), "node_id")
    p = nodes.select(F.col("node_id").alias("parent_id"), F.col("start_page").alias("ps"), F.col("end_page").alias("pe"))
    out = nodes.join(p, "parent_id").where("start_page < ps or end_page > pe or start_page > end_page").select(F.lit("RANGE").alias("rule"), "node_id")
    return roots.unionByName(twins).unionByName(out)


def orphan_rows(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child rows without the parent row that their (composite) key names."""
    p = parent.select(*[F.col(v).alias(f"__{k}") for k, v in keys.items()])
    cond = reduce(Column.__and__, [child[k] == p[f"__{k}"] for k in keys])
    return child.join(p, cond, "left_anti")


def check_rules(rows: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(id, failed) of rows that break a rule (unknown counts as broken), all rules in one pass."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select(id_col, F.array_join(failed, ",").alias("failed")).where("failed <> ''")


def duplicate_keys(rows: DataFrame, keys: list[str], condition: Column | None = None) -> DataFrame:
    """Keys (nulls equal) that more than one row has, among the rows of the condition."""
    return (rows.where(condition) if condition is not None else rows).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def chunk_violations(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunk_id, reason): blank text, an empty page range, or a node that isn't of the material."""
    n = nodes.select("node_id", F.col("material_id").alias("__m"))
    j = chunks.join(n, "node_id", "left")
    reason = F.when(F.trim("content") == "", "BLANK").when(F.col("start_page") > F.col("end_page"), "RANGE").when(~F.coalesce(F.col("__m") == F.col("material_id"), F.lit(False)), "NODE")
    return j.withColumn("reason", reason).where("reason is not null").select("chunk_id", "reason")


def link_violations(links: DataFrame, chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chunk_id, block_id, reason): links to blocks that aren't there, of another material, or outside the chunk's pages."""
    c = chunks.select("chunk_id", "material_id", "start_page", "end_page")
    b = blocks.select("block_id", F.col("material_id").alias("__m"), F.col("page_number").alias("__p"))
    j = links.join(c, "chunk_id", "left").join(b, "block_id", "left")
    reason = F.when(F.col("material_id").isNull(), "NO_CHUNK").when(F.col("__m").isNull(), "NO_BLOCK").when(F.col("__m") != F.col("material_id"), "MATERIAL").when(~F.col("__p").between(F.col("start_page"), F.col("end_page")), "PAGE")
    return j.withColumn("reason", reason).where("reason is not null").select("chunk_id", "block_id", "reason")


def visual_link_violations(links: DataFrame, chunks: DataFrame, visuals: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose visual isn't on a page, or under the node, of the chunk."""
    return links.join(link_visuals(chunks, visuals, nodes), ["chunk_id", "visual_id"], "left_anti").select("chunk_id", "visual_id")


#: What may stand under what in an outline (fixed values).
VALID_CHILDREN = ("DOCUMENT>CHAPTER", "DOCUMENT>SECTION", "CHAPTER>SECTION", "SECTION>SUBSECTION")


def suggestion_violations(suggestions: DataFrame, nodes: DataFrame, lines: DataFrame, most_chars: int = 500) -> DataFrame:
    """(node_id, title, reason): the first reason against a suggested title and type of a node.

    ``suggestions``: (node_id, title, node_type). Only nodes of low confidence may
    be changed, to a line of their page; the type must fit the parent and the
    children, and no other node of the page may have the title.
    """
    n = nodes.select("node_id", F.col("start_page").alias("page"), "material_id", F.col("title").alias("old"), "confidence", "parent_id")
    legal = lambda a, b: F.concat(a, F.lit(">"), b).isin(*VALID_CHILDREN)
    there = lines.select("material_id", F.col("page_number").alias("page"), F.trim("line").alias("title")).distinct().withColumn("__l", F.lit(True))
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("node_type").alias("__parent"))
    twins = nodes.groupBy("material_id", F.col("start_page").alias("page"), F.lower(F.trim("title")).alias("__key")).agg(F.collect_set("node_id").alias("__twins"))
    under = suggestions.select("node_id", "node_type").distinct().join(nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id"), F.col("node_type").alias("__child")), "node_id")
    unfit = under.where(~legal(F.col("node_type"), F.col("__child"))).select("node_id", "node_type").distinct().withColumn("__unfit", F.lit(True))
    j = suggestions.join(n, "node_id", "left").join(there, ["material_id", "page", "title"], "left").join(parents, "parent_id", "left")
    j = j.withColumn("__key", F.lower("title")).join(twins, ["material_id", "page", "__key"], "left").join(unfit, ["node_id", "node_type"], "left")
    count = F.count("*").over(Window.partitionBy("node_id"))
    other = F.size(F.filter("__twins", lambda x: x != F.col("node_id"))) > 0
    reason = (
        F.when(F.col("old").isNull(), "UNKNOWN_NODE").when(count > 1, "REPEATED").when(~F.col("confidence").eqNullSafe("LOW"), "NOT_LOW").when(F.col("title") == F.col("old"), "SAME")
        .when((F.trim("title") != F.col("title")) | (F.length("title") > most_chars) | F.col("title").rlike("\\p{Cntrl}") | F.col("__l").isNull(), "NOT_A_LINE")
        .when(~legal(F.coalesce("__parent", F.lit("DOCUMENT")), F.col("node_type")), "PARENT").when(other, "DUPLICATE").when(F.col("__unfit"), "CHILD")
    )
    return j.withColumn("reason", reason).where("reason is not null").select("node_id", "title", "reason")


def provenance_valid(pages: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(material_id, valid): complete valid pages, a sound outline and sound chunks."""
    ok = page_set_check(pages).select("material_id", (F.col("complete") & F.col("valid")).alias("pages_ok"))
    bad_nodes = outline_violations(nodes).join(nodes.select("node_id", "material_id"), "node_id").select("material_id").distinct().withColumn("bad_node", F.lit(True))
    bad_chunks = chunk_violations(chunks, nodes).join(chunks.select("chunk_id", "material_id"), "chunk_id").select("material_id").distinct().withColumn("bad_chunk", F.lit(True))
    j = ok.join(bad_nodes, "material_id", "left").join(bad_chunks, "material_id", "left")
    return j.select("material_id", (F.col("pages_ok") & F.col("bad_node").isNull() & F.col("bad_chunk").isNull()).alias("valid"))
