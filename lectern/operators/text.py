"""Page text: lines, noise, normalisation, tables, captions, headings, and chunks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Namespace of chunk ids (fixed value).
CHUNK_NAMESPACE = "bc9da86d-4f4f-5f4f-9f59-8cc72e70b86a"
#: Forms of lines (fixed values): numbered headings, page numbers, captions, list entries, entries of a table of contents.
CHAPTER = "(?i)^chapter\\s+(?:[0-9]{1,3}|[ivxlcdm]{1,8})(?:[.:)]?\\s+.+)?$"
SECTION = "(?i)^section\\s+(?:[0-9]{1,3}|[ivxlcdm]{1,8})(?:[.:)]?\\s+.+)?$"
DECIMAL = "^([0-9]{1,3}(?:\\.[0-9]{1,3}){0,2})[.):]?\\s+\\S.{0,500}$"
ROMAN = "(?i)^[ivxlcdm]{1,8}[.):]?\\s+\\S.{0,500}$"
PAGE_NUMBER = "^(?:[0-9]{1,5}|[ivxlcdm]{1,10})$"
CAPTION = "(?i)^(?:figure|fig\\.?|table)\\s+[0-9ivxlcdm]+\\b.*$"
LIST_ENTRY = "^(?:[-*•]|[a-zA-Z][.)])\\s+.+$"
TOC_ENTRY = "^(.{2,480}?)(?:\\.{2,}|\\s{2,})([0-9ivxlcdm]{1,8})$"
FIGURE_LABEL = "(?i)^\\s*(fig(?:ure)?\\.?\\s+\\d+(?:[-.]\\d+)?)(?:\\s*$|\\s*([.:\\-\u2013\u2014])\\s*(\\S.*))$"


#: White space, as ranges of code points (fixed values): blanks and breaks, but not those that forbid a break.
SPACES = ((0x09, 0x0D), (0x1C, 0x20), (0x1680, 0x1680), (0x2000, 0x2006), (0x2008, 0x200A), (0x2028, 0x2029), (0x205F, 0x205F), (0x3000, 0x3000))
#: The same as part of a class of a regular expression.
SPACE_CLASS = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SPACES)


def token_count(text: Column) -> Column:
    """A run of letters, digits and marks costs a quarter of its length, rounded up; any other sign that isn't white space costs 1."""
    runs = F.regexp_extract_all(text, F.lit("[\\p{L}\\p{Nd}\\p{M}]+"), F.lit(0))
    signs = F.length(F.regexp_replace(text, f"[{SPACE_CLASS}\\p{{L}}\\p{{Nd}}\\p{{M}}]", ""))
    return (F.aggregate(runs, F.lit(0), lambda s, x: s + F.ceil(F.length(x) / 4).cast("int")) + signs).cast("long")


def byte_tokens(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def canonical_line(line: Column) -> Column:
    """The form in which repeated lines are counted: trimmed, blanks collapsed, page numbers alike; null if over 512 signs."""
    t = F.trim(line)
    number = t.rlike("^[0-9]+$") | t.rlike("^(?i)page[ \\t]+[0-9]+$")
    return F.when((F.length(t) > 512) | (t == ""), F.lit(None)).when(number, "<PAGE_NUMBER>").otherwise(F.regexp_replace(t, "[ \\t]+", " "))


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    """Compatibility forms (NFKC), which no built-in function makes."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def comparison_key(text: Column) -> Column:
    """Compatibility forms, lower case, no ASCII punctuation at the ends, single spaces, at most 512 signs.

    Texts of ASCII and Latin letters are their own compatibility forms and stay in
    the JVM; the Python function gets nulls in their place.
    """
    other = text.rlike("[^\\x00-\\x7F\u00c0-\u00ff]")
    plain = F.when(other, _compatible(F.when(other, text))).otherwise(text)
    low = F.regexp_replace(F.lower(F.trim(plain)), "^[\\p{Punct}\\s]+|[\\p{Punct}\\s]+$", "")
    return F.substring(F.regexp_replace(low, "\\s+", " "), 1, 512)


def _slots(lines: DataFrame) -> DataFrame:
    """The first two and last two visible lines of each page, with their slot."""
    seen = lines.where(F.trim("line") != "")
    page = ["material_id", "page_number"]
    top = F.row_number().over(Window.partitionBy(*page).orderBy("line_no"))
    bottom = F.row_number().over(Window.partitionBy(*page).orderBy(F.desc("line_no")))
    both = seen.withColumns({"t": top, "b": bottom})
    a = both.where("t <= 2").select(*page, "line_no", "line", "extraction_method", F.concat(F.lit("TOP"), (F.col("t") - 1).cast("string")).alias("slot"))
    z = both.where("b <= 2").select(*page, "line_no", "line", "extraction_method", F.concat(F.lit("BOTTOM"), (F.col("b") - 1).cast("string")).alias("slot"))
    return a.unionByName(z).withColumn("canonical", canonical_line(F.col("line")))


def repeated_lines(lines: DataFrame, share: float = 0.9, min_pages: int = 3) -> DataFrame:
    """(material_id, slot, canonical, pages): header and footer lines on most native pages of a material."""
    native = lines.where("extraction_method = 'NATIVE'")
    pages = native.select("material_id", "page_number").distinct().groupBy("material_id").agg(F.count("*").alias("total"))
    counted = _slots(native).where("canonical is not null").groupBy("material_id", "slot", "canonical").agg(F.count_distinct("page_number").alias("pages"))
    return counted.join(pages, "material_id").where((F.col("total") >= min_pages) & (F.col("pages") >= F.ceil(F.col("total") * share))).select("material_id", "slot", "canonical", "pages")


def repeated_regions(lines: DataFrame, min_pages: int = 3, share: float = 0.2) -> DataFrame:
    """Text that stands in the top or bottom band of many pages."""
    band = _slots(lines).withColumn("band", F.regexp_replace("slot", "[0-9]", ""))
    pages = lines.groupBy("material_id").agg(F.count_distinct("page_number").alias("total"))
    n = band.groupBy("material_id", "band", comparison_key(F.col("line")).alias("key")).agg(F.count_distinct("page_number").alias("pages"))
    return n.join(pages, "material_id").where((F.col("pages") >= min_pages) & (F.col("pages") >= share * F.col("total"))).select("material_id", "band", "key", "pages")


def toc_pages(lines: DataFrame, last_page: int = 12) -> DataFrame:
    """Early pages with four entry lines, or two and a contents label in the first five lines."""
    entry = F.trim("line").rlike(TOC_ENTRY)
    label = (F.col("line_no") < 5) & comparison_key(F.col("line")).isin("contents", "table of contents")
    g = lines.where(F.col("page_number") <= last_page).groupBy("material_id", "page_number").agg(F.count_if(entry).alias("entries"), F.bool_or(label).alias("labelled"))
    return g.where((F.col("entries") >= 4) | (F.col("labelled") & (F.col("entries") >= 2)))


def toc_titles(lines: DataFrame) -> DataFrame:
    """(material_id, key): the titles that tables of contents name."""
    pages = toc_pages(lines).select("material_id", "page_number")
    title = F.regexp_extract(F.trim("line"), TOC_ENTRY, 1)
    return lines.join(pages, ["material_id", "page_number"], "left_semi").where(title != "").select("material_id", comparison_key(title).alias("key")).distinct()


def normalize_pages(pages: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """Adds ``normalized``: wrapped lines joined, blank and list lines kept apart, hyphen breaks of native pages closed.

    What stands between two lines depends on these two alone, so a page is one
    pass over its lines. A hyphen goes if a word of six letters a-z or more stands
    before it and the next line begins with a-z; another hyphen joins without a
    space. Scanned pages keep their hyphens and spaces. ``noise``: (material_id,
    slot, canonical) lines to leave out of native pages.
    """
    native = F.col("extraction_method") == "NATIVE"
    lines = F.split("content", "\n")
    if noise is not None:
        gone = noise.groupBy("material_id").agg(F.collect_set(F.concat_ws("|", "slot", "canonical")).alias("__noise"))
        pages = pages.join(gone, "material_id", "left")
        solid = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.trim(F.get(lines, i)) != "")
        pages = pages.withColumn("__solid", solid)
        place = {"TOP0": F.get("__solid", F.lit(0)), "TOP1": F.get("__solid", F.lit(1)), "BOTTOM0": F.get("__solid", F.size("__solid") - 1), "BOTTOM1": F.get("__solid", F.size("__solid") - 2)}

        def is_noise(x: Column, i: Column) -> Column:
            hit = F.lit(False)
            for slot, at in place.items():
                hit = hit | F.coalesce((at == i) & F.array_contains("__noise", F.concat_ws("|", F.lit(slot), canonical_line(x))), F.lit(False))
            return native & hit

        lines = F.filter(lines, lambda x, i: ~is_noise(x, i))
    pages = pages.withColumn("__lines", lines)
    apart = lambda x: (F.trim(x) == "") | x.rlike("^\\s*(- |\\* |[0-9]+[.)] .*$)")
    after = lambda i: F.get("__lines", i + 1)
    broken = lambda x, i: native & x.rlike("(^|[ \\t])[a-z]{6,}[-\u00ad]$") & after(i).rlike("^[a-z]")

    def piece(x: Column, i: Column) -> Column:
        return (
            F.when(after(i).isNull(), x)
            .when(apart(x) | apart(after(i)), F.concat(x, F.lit("\n")))
            .when(broken(x, i), F.substring(x, F.lit(1), F.length(x) - 1))
            .when(native & F.endswith(x, F.lit("-")), x)
            .otherwise(F.concat(x, F.lit(" ")))
        )

    return pages.withColumn("normalized", F.array_join(F.transform("__lines", piece), "")).drop("__noise", "__solid", "__lines")


def paragraphs(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, paragraph_no, paragraph): parts between blank lines; single breaks stay inside."""
    cut = texts.select(id_col, F.posexplode(F.split(F.col(text_col), "\\n[ \\t]*\\n\\s*")).alias("paragraph_no", "paragraph"))
    return cut.where(F.trim("paragraph") != "").withColumn("paragraph_no", F.col("paragraph_no").cast("long"))


def classify_pages(pages: DataFrame, text_col: str, has_image: Column) -> DataFrame:
    """NATIVE_TEXT, MIXED, IMAGE_ONLY or UNREADABLE by the number of meaningful signs."""
    n = F.length(F.regexp_replace(F.col(text_col), "[\\s\\p{C}\\p{Z}]", ""))
    kind = F.when(has_image & (n >= 8), "MIXED").when(has_image, "IMAGE_ONLY").when(n >= 1, "NATIVE_TEXT").otherwise("UNREADABLE")
    return pages.withColumn("page_class", kind)


def score_headings(lines: DataFrame, toc: DataFrame | None = None, threshold: int = 4) -> DataFrame:
    """Lines that are headings, with level, score and confidence.

    Numbering counts 3, up to 120 signs 1, a title that the table of contents
    names 1; layout columns, where the lines have them, count too: prominence
    (STRONG 3, RAISED 2), emphasized 1, separated 1, alignment CENTRE 1. A line
    without a number needs prominence and separation. Scanned pages of LIMITED
    quality need one point more, poorer ones have no headings.
    """
    has = lambda c: c in lines.columns
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    t = F.trim("line")
    prominence = F.col("prominence") if has("prominence") else F.lit("PLAIN")
    separated = F.coalesce(F.col("separated"), F.lit(False)) if has("separated") else F.lit(False)
    lifted = prominence.isin("STRONG", "RAISED") & separated
    number = F.regexp_extract(t, DECIMAL, 1)
    level = F.when(t.rlike(CHAPTER), 1).when(t.rlike(SECTION), 2).when(number != "", F.least(F.size(F.split(number, "\\.")), F.lit(3))).when(t.rlike(ROMAN) & lifted, 1).otherwise(0)
    named = lines.withColumns({"title": t, "number": level.cast("long")}).where((F.length("title") >= 3) & ~F.col("title").rlike(PAGE_NUMBER) & ~F.col("title").rlike(CAPTION) & ~F.col("title").rlike(LIST_ENTRY))
    named = named.where((F.col("number") > 0) | lifted)
    if toc is not None:
        listed = toc.select("material_id", F.col("key").alias("__key"), F.lit(True).alias("__toc"))
        named = named.withColumn("__key", comparison_key(F.col("title"))).join(listed, ["material_id", "__key"], "left")
    score = F.when(F.col("number") > 0, 3).otherwise(0) + F.when(prominence == "STRONG", 3).when(prominence == "RAISED", 2).otherwise(0) + flag(separated) + flag(F.length("title") <= 120)
    score = score + (flag(F.col("emphasized")) if has("emphasized") else 0) + (flag(F.col("alignment") == "CENTRE") if has("alignment") else 0) + (flag(F.col("__toc")) if toc is not None else 0)
    limit = F.when(F.col("extraction_method") == "NATIVE", threshold).when(F.col("quality") == "STRONG", threshold).when(F.col("quality") == "LIMITED", threshold + 1)
    found = named.withColumn("score", score.cast("long")).where(F.col("score") >= limit)
    shown = F.when(F.col("number") == 0, 2).otherwise(F.col("number")).cast("long")
    return found.select("material_id", "page_number", "line_no", "title", shown.alias("level"), "score", F.when(F.col("score") >= 7, "HIGH").when(F.col("score") >= 5, "MEDIUM").otherwise("LOW").alias("confidence"))


def heading_parents(headings: DataFrame) -> DataFrame:
    """Adds ordinal numbers and the parent: level 1 hangs on the root, 2 on the chapter, 3 on the section (else it is dropped)."""
    w = Window.partitionBy("material_id").orderBy("page_number", "line_no")
    n = headings.withColumn("pos", F.row_number().over(w).cast("long"))
    chapters = n.withColumn("chapter", F.last(F.when(F.col("level") == 1, F.col("pos")), True).over(w))
    inside = Window.partitionBy("material_id", "chapter").orderBy("pos")
    sections = chapters.withColumn("section", F.last(F.when(F.col("level") == 2, F.col("pos")), True).over(inside))
    kept = sections.where((F.col("level") < 3) | F.col("section").isNotNull())
    parent = F.when(F.col("level") == 2, F.col("chapter")).when(F.col("level") == 3, F.col("section"))
    sibling = Window.partitionBy("material_id", "parent").orderBy("pos")
    return kept.withColumn("parent", F.coalesce(parent, F.lit(0))).withColumn("ordinal", F.row_number().over(sibling).cast("long")).drop("chapter", "section")


def heading_spans(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds the end page: before the next heading of the same or a higher level, inside the parent, never before the start."""
    after = Window.partitionBy("material_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    following = lambda k: F.min(F.when(F.col("level") <= k, F.struct("pos", "page_number"))).over(after)["page_number"]
    next_page = F.when(F.col("level") == 1, following(1)).when(F.col("level") == 2, following(2)).otherwise(following(3))
    last = pages.groupBy("material_id").agg(F.max("page_number").alias("n_pages"))
    own = F.when(F.col("next_page") == F.col("page_number"), F.col("page_number")).otherwise(F.coalesce(F.col("next_page") - 1, F.col("n_pages")))
    spans = headings.withColumn("next_page", next_page).join(last, "material_id").withColumn("end_page", own)
    up = spans.select("material_id", F.col("pos").alias("parent"), F.col("end_page").alias("up"))
    out = spans.join(up, ["material_id", "parent"], "left").withColumn("end_page", F.greatest("page_number", F.least("end_page", F.coalesce("up", "n_pages"))))
    return out.select("material_id", "pos", "parent", "ordinal", "level", "title", "score", F.col("page_number").alias("start_page"), "end_page")


def attach_layout(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """Lines with the layout of the first layout line of their page that has the same comparison key.

    ``layout``: (material_id, page_number, line_order, text, prominence, separated,
    emphasized, alignment, band). Lines without one keep nulls.
    """
    key = ["material_id", "page_number", "__key"]
    w = Window.partitionBy(*key).orderBy("line_order")
    first = layout.withColumn("__key", comparison_key(F.col("text"))).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return lines.withColumn("__key", comparison_key(F.col("line"))).join(first.select(*key, "prominence", "separated", "emphasized", "alignment", "band"), key, "left").drop("__key")


def _alike(a: Column, b: Column) -> Column:
    """Equal keys, or one inside the other if both have eight signs."""
    return (a == b) | ((F.length(a) >= 8) & (F.length(b) >= 8) & (F.contains(a, b) | F.contains(b, a)))


def apply_outline(headings: DataFrame, outline: DataFrame, lines: DataFrame, pages: DataFrame, most_chars: int = 500) -> DataFrame:
    """Headings after the document's own outline: (material_id, page_number, line_no, title, level, score, confidence, origin).

    ``outline``: (material_id, page_number, title, depth, source_order). An entry
    takes over the first heading of its page that is alike, or else the first line
    that is. An entry found nowhere stands by itself on a poor or blank page, and on
    other pages where no heading speaks against it. Of headings with one key on a
    page the outline's stays, else the first.
    """
    page = ["material_id", "page_number"]
    native, q = F.col("extraction_method") == "NATIVE", F.col("quality")
    facts = pages.select(*page, F.when(native, "HIGH").otherwise(F.when(q == "STRONG", "HIGH").when(q == "LIMITED", "MEDIUM").otherwise("LOW")).alias("sure"), ((F.trim("content") == "") | (~native & q.eqNullSafe("POOR"))).alias("poor"), (native | q.eqNullSafe("STRONG")).alias("strong"))
    own = headings.withColumn("key", comparison_key(F.col("title")))
    entries = outline.select(*page, "title", "source_order", F.least(F.lit(3), "depth").cast("long").alias("level"), comparison_key(F.col("title")).alias("o_key"))
    best = lambda t, *cols: F.min(F.struct("line_no", *cols))
    met = entries.join(own.select(*page, "line_no", F.col("title").alias("h_title"), F.col("score").alias("h_score"), "key"), page).where(_alike(F.col("o_key"), F.col("key")))
    met = met.groupBy(*page, "source_order").agg(best(met, "h_title", "h_score", "key").alias("h"))
    body = lines.select(*page, "line_no", F.trim("line").alias("b_title")).where((F.col("b_title") != "") & (F.length("b_title") <= most_chars)).withColumn("key", comparison_key(F.col("b_title")))
    there = entries.join(body, page).where(_alike(F.col("o_key"), F.col("key"))).groupBy(*page, "source_order").agg(F.min(F.struct("line_no", "b_title")).alias("b"))
    some = headings.select(*page).distinct().withColumn("any", F.lit(True))
    e = entries.join(met, [*page, "source_order"], "left").join(there, [*page, "source_order"], "left").join(facts, page).join(some, page, "left")
    h, b = F.col("h").isNotNull(), F.col("b").isNotNull()
    against = F.coalesce("any", F.lit(False)) & F.col("strong")
    native_rows = e.where(h | b | F.col("poor") | ~against).select(
        *page,
        F.when(h, F.col("h.line_no")).when(b, F.col("b.line_no")).otherwise(F.col("source_order")).cast("long").alias("line_no"),
        F.when(h, F.col("h.h_title")).when(b, F.col("b.b_title")).otherwise(F.col("title")).alias("title"),
        "level",
        F.when(h, F.greatest("h.h_score", F.lit(6))).when(b, 5).when(F.col("poor"), 2).otherwise(4).cast("long").alias("score"),
        F.when(h | b, F.col("sure")).when(F.col("poor"), "LOW").otherwise("MEDIUM").alias("confidence"),
        F.lit("NATIVE").alias("origin"),
    )
    both = native_rows.unionByName(headings.select(*native_rows.columns[:-1], F.lit("HEURISTIC").alias("origin"))).withColumn("key", comparison_key(F.col("title")))
    w = Window.partitionBy(*page, "key").orderBy(F.col("origin") != "NATIVE", "line_no", "level")
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "key")


def detect_structure(lines: DataFrame, pages: DataFrame, outline: DataFrame | None = None, layout: DataFrame | None = None) -> DataFrame:
    """The outline of each material from its lines, with their layout and the document's own outline where these are given.

    Headings in the top or bottom band that are repeated there on many pages are no headings.
    """
    if layout is not None:
        lines = attach_layout(lines, layout)
    found = score_headings(lines, toc_titles(lines))
    if layout is not None:
        again = repeated_regions(lines).select("material_id", "band", F.col("key").alias("__key"))
        banded = lines.where(F.col("band").isin("TOP", "BOTTOM")).select("material_id", "page_number", "line_no", "band", comparison_key(F.col("line")).alias("__key"))
        found = found.join(banded.join(again, ["material_id", "band", "__key"], "left_semi"), ["material_id", "page_number", "line_no"], "left_anti")
    if outline is not None:
        found = apply_outline(found, outline, lines, pages)
    return heading_spans(heading_parents(found), pages)


def match_outline(outline: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, title, line_no): the first body line of a page that equals an outline title, or holds it (8 signs or more)."""
    k = lambda x: comparison_key(F.col(x))
    o = outline.select("page_id", "title", k("title").alias("a"))
    body = lines.select("page_id", "line_no", k("line").alias("b")).where("b <> ''")
    long = (F.length("a") >= 8) & (F.length("b") >= 8)
    hit = o.join(body, "page_id").where((F.col("a") == F.col("b")) | (long & (F.contains("a", F.col("b")) | F.contains("b", F.col("a")))))
    return hit.groupBy("page_id", "title").agg(F.min("line_no").alias("line_no"))


def caption_visuals(visuals: DataFrame, lines: DataFrame, label_pattern: str = FIGURE_LABEL) -> DataFrame:
    """(visual_id, caption, nearby): on pages with one visual and one caption line; at most three lines around it."""
    alone = Window.partitionBy("material_id", "page_number")
    one = visuals.withColumn("n", F.count("*").over(alone)).where("n = 1").drop("n")
    text = lines.where((F.trim("line") != "") & (F.col("quality").isNull() | (F.col("quality") == "STRONG")))
    w = Window.partitionBy("material_id", "page_number").orderBy("line_no")
    near = F.concat_ws(" ", F.lag("line").over(w), F.lead("line", 1).over(w), F.lead("line", 2).over(w))
    label = text.withColumn("nearby", near).where(F.col("line").rlike(label_pattern)).withColumn("n", F.count("*").over(alone)).where("n = 1")
    return one.join(label, ["material_id", "page_number"]).select("visual_id", F.substring(F.trim("line"), 1, 300).alias("caption"), "nearby")


def chunk_uuid(version: Column, index: Column, namespace: str = CHUNK_NAMESPACE) -> Column:
    """Name-based (version 5) UUID of the chunk's place; the first index is 1."""
    name = F.concat(F.lit("CHUNKER_V1\n"), F.lower(version), F.lit("\n"), index.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


# ---- layout tables: words and lines with positions


def ocr_quality(words: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """Mean confidence and its class: STRONG from 85, LIMITED from 60, else POOR."""
    m = F.avg(confidence)
    return words.groupBy(*keys).agg(F.round(m, 6).alias("mean_confidence"), F.when(m >= 85, "STRONG").when(m >= 60, "LIMITED").otherwise("POOR").alias("quality"))


def ocr_text(words: DataFrame) -> DataFrame:
    """(page, text): a space between words, a break between lines, a blank line between paragraphs."""
    w = Window.partitionBy("page").orderBy("pos")
    sep = F.when(F.lag("pos").over(w).isNull(), "").when(F.lag("paragraph").over(w) != F.col("paragraph"), "\n\n").when(F.lag("line").over(w) != F.col("line"), "\n").otherwise(" ")
    parts = words.withColumn("piece", F.concat(sep, F.col("word")))
    return parts.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("text"))


def line_layout(layout: DataFrame) -> DataFrame:
    """Lines (page, line, y, height, font, x, width; 0 to 1 of the page) with band, alignment, prominence and separation."""
    good = lambda c: F.when((F.col(c) > 0) & ~F.isnan(c), F.col(c))
    med = layout.groupBy("page").agg(F.median(good("font")).alias("median_font"), F.median(good("height")).alias("median_height"))
    w = Window.partitionBy("page").orderBy("y", "line")
    gap = F.greatest(F.col("y") - F.lag("y").over(w), F.lead("y").over(w) - F.col("y"))
    both = layout.join(med, "page")
    ratio = F.col("font") / F.col("median_font")
    middle = F.abs(F.col("x") + F.col("width") / 2 - 0.5) <= 0.05
    return both.select(
        "page", "line",
        F.when(F.col("y") <= 0.14, "TOP").when(F.col("y") >= 0.86, "BOTTOM").otherwise("BODY").alias("band"),
        F.when(middle, "CENTRE").otherwise("SIDE").alias("alignment"),
        F.when(ratio >= 1.6, "STRONG").when(ratio >= 1.25, "RAISED").otherwise("PLAIN").alias("prominence"),
        F.coalesce(gap > 1.8 * F.col("median_height"), F.lit(False)).alias("separated"),
    )


def line_medians(layout: DataFrame) -> DataFrame:
    """Median font size and height of each page's lines, of the values over 0."""
    return layout.groupBy("page").agg(F.median(F.when(F.col("font") > 0, F.col("font"))).alias("median_font"), F.median(F.when(F.col("height") > 0, F.col("height"))).alias("median_height"))


def escape_xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def assemble_context(ranked: DataFrame) -> DataFrame:
    """(query_id, context, sources): the sources of each query in order, escaped, in tags with their rank and id."""
    block = F.concat(F.lit('<source rank="'), F.col("rank_no").cast("string"), F.lit('" id="'), F.col("chunk_id").cast("string"), F.lit('">'), escape_xml(F.col("content")), F.lit("</source>"))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", block.alias("b")))), lambda x: x["b"]), "\n").alias("context"), F.count("*").alias("sources"))
