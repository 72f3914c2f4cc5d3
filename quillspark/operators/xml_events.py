"""XML as a stream of events: splitting, classes, attributes, profiles, depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import author_case, join_lines

PIECE = r"<!--[\s\S]*?-->|<[^>]*>|[^<]+"
_TAG = r"^</?\s*([A-Za-z_][\w:.-]*)"
_ATTRIBUTE = r"([A-Za-z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"


def split_xml(xml: Column) -> Column:
    """array<string>: tags, comments and the text between them; wrapped lines are joined first."""
    return F.regexp_extract_all(join_lines(xml), F.lit(f"({PIECE})"), F.lit(1))


def event_code(piece: Column) -> Column:
    """The class of a piece; blank text has none."""
    p = F.trim(piece)
    return (
        F.when(p.startswith("<!--"), "comment")
        .when(p.rlike(r"^<\?|^<!"), F.lit(None))
        .when(p.rlike(r"^<\s*body\b"), "bodyStart")
        .when(p.rlike(r"^</\s*body\s*>"), "bodyStop")
        .when(p.rlike("^</"), "closeTag")
        .when(p.rlike(r"^<[^>]*=[^>]*/\s*>"), "closedAttrTag")
        .when(p.rlike(r"^<[^>]*/\s*>"), "openCloseTag")
        .when(p.rlike("^<[^>]*="), "openAttrTag")
        .when(p.rlike("^<[^>]*>"), "openTag")
        .when(p != "", "text")
    )


def attributes(piece: Column, corrections: dict[str, str] | None = None) -> Column:
    """map<string, string> of a tag's attributes in their order; values in either kind of quotes, trimmed and corrected; the last of equal keys wins."""
    keys, double, single = (F.regexp_extract_all(piece, F.lit(_ATTRIBUTE), F.lit(k)) for k in (1, 2, 3))
    values = F.zip_with(double, single, lambda a, b: F.trim(F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    unique = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    out = F.map_from_entries(unique)
    if corrections:
        known = F.create_map(*[F.lit(x) for kv in corrections.items() for x in kv])
        out = F.transform_values(out, lambda _, v: F.coalesce(F.element_at(known, v), v))
    return out


def xml_events(df: DataFrame, id_col: str, xml_col: str, corrections: dict[str, str] | None = None) -> DataFrame:
    """(id, pos, code, tag, attrs, text) of every piece that has a class."""
    pieces = df.select(F.col(id_col).alias("id"), F.posexplode(split_xml(F.col(xml_col))).alias("pos", "piece")).withColumn("code", event_code(F.col("piece"))).where("code IS NOT NULL")
    tagged = ~F.col("code").isin("comment", "text")
    return pieces.select(
        F.col("id").alias(id_col),
        "pos",
        "code",
        F.when(tagged, F.regexp_replace(F.regexp_extract("piece", _TAG, 1), "[0-9]", "")).alias("tag"),
        F.when(F.col("code").isin("openAttrTag", "closedAttrTag"), attributes(F.col("piece"), corrections)).alias("attrs"),
        F.when(F.col("code") == "text", F.trim("piece")).alias("text"),
    )


def body_events(events: DataFrame, id_col: str) -> DataFrame:
    """Events between the first body start and the first body stop; documents without a body have none."""
    doc = Window.partitionBy(id_col)
    start = F.min(F.when(F.col("code") == "bodyStart", F.col("pos"))).over(doc)
    stop = F.min(F.when(F.col("code") == "bodyStop", F.col("pos"))).over(doc)
    return events.select("*", start.alias("start__"), stop.alias("stop__")).where((F.col("pos") > F.col("start__")) & (F.col("pos") < F.coalesce(F.col("stop__"), F.lit(2**31 - 1)))).drop("start__", "stop__")


def with_depth(events: DataFrame, id_col: str) -> DataFrame:
    """``events`` with ``depth``, the number of open elements at each."""
    opens = F.col("code").isin("openTag", "openAttrTag", "bodyStart").cast("int")
    closes = F.col("code").isin("closeTag", "bodyStop").cast("int")
    by_doc = Window.partitionBy(id_col).orderBy("pos")
    return events.select("*", (F.sum(opens).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce(F.sum(closes).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("depth"))


def number_tags(events: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, tag, tag_no): the running number of each opening or self-closing tag."""
    opened = events.where(F.col("code").isin("openTag", "openAttrTag", "openCloseTag", "closedAttrTag"))
    return opened.select(id_col, "pos", "tag", F.row_number().over(Window.partitionBy(id_col, "tag").orderBy("pos")).alias("tag_no"))


def attribute_profile(events: DataFrame) -> DataFrame:
    """(tag, attr, n, n_values): how often each attribute occurs and how many values it has."""
    pairs = events.where("attrs IS NOT NULL").select("tag", F.explode("attrs").alias("attr", "value"))
    return pairs.groupBy("tag", "attr").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


def attribute_values(events: DataFrame, id_col: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(id, tag, keys, attr, n_values, first_at): the values of each attribute by tag and the tag's set of attributes, those ignored not among them, in each document.

    ``first_at`` orders attributes as they first come: struct<pos, place in its tag>.
    """
    own = F.array_except(F.map_keys("attrs"), F.array(*[F.lit(x) for x in ignored]).cast("array<string>")) if ignored else F.map_keys("attrs")
    keyed = events.where("attrs IS NOT NULL").select(id_col, "tag", F.array_join(own, "\x1f").alias("keys"), "pos", F.posexplode("attrs").alias("place", "attr", "value"))
    return keyed.groupBy(id_col, "tag", "keys", "attr").agg(F.count_distinct("value").alias("n_values"), F.min(F.struct("pos", "place")).alias("first_at"))


def attribute_roles(
    events: DataFrame,
    id_col: str,
    section_tags: tuple[str, ...] = ("div",),
    section_keys: tuple[str, ...] = ("subtype",),
    ignored: tuple[str, ...] = (),
    non_section_keys: tuple[str, ...] = (),
    non_section_values: tuple[str, ...] = (),
) -> DataFrame:
    """(id, tag, keys, value_key, name_keys, first_pos): which attribute numbers a tag and which ones name it, in each document.

    ``n`` is the value where there is one, else the attribute of most values
    that isn't ignored, the first of equals. Names are the section keys where
    there are any, else the attribute of most values beside the value, with
    those that have as many. A tag of one attribute is named by itself
    (``name_keys`` empty). Where a section tag has ``n`` and only one name is
    left when those without section values go, that one alone names it, and
    ``is_section`` is set.
    """
    usable = ~F.col("attr").isin(*ignored) if ignored else F.lit(True)
    values = attribute_values(events, id_col, ignored).withColumn("usable", usable)
    rank = F.struct(F.when(F.col("usable"), F.col("n_values")).otherwise(0).alias("n"), (-F.col("first_at.pos")).alias("p"), (-F.col("first_at.place")).alias("q"))
    by_tag = Window.partitionBy(id_col, "tag", "keys")
    told = values.select("*", F.count("*").over(by_tag).alias("n_attrs"), F.coalesce(F.max(F.when(F.col("attr") == "n", "n")).over(by_tag), F.max_by("attr", rank).over(by_tag)).alias("value_key"))
    other = F.when(F.col("attr") != F.col("value_key"), rank)
    told = told.select("*", F.max(F.col("attr").isin(*section_keys)).over(by_tag).alias("has_key") if section_keys else F.lit(False).alias("has_key"), F.max(F.when(F.col("usable"), other)).over(by_tag)["n"].alias("most"))
    names = F.when(F.col("has_key"), F.col("attr").isin(*section_keys) if section_keys else F.lit(False)).otherwise((F.col("attr") != F.col("value_key")) & F.col("usable") & (F.col("n_values") == F.col("most")))
    told = told.select("*", (names & (F.col("n_attrs") > 1)).alias("names"))
    if non_section_values:
        odd = events.where("attrs IS NOT NULL").select(id_col, "tag", F.explode("attrs").alias("attr", "value")).where(F.col("value").isin(*non_section_values)).select(id_col, "tag", "attr").distinct().withColumn("odd", F.lit(True))
        told = told.join(odd, [id_col, "tag", "attr"], "left")
    else:
        told = told.withColumn("odd", F.lit(False))
    left_out = F.coalesce(F.col("odd"), F.lit(False)) | (F.col("attr").isin(*non_section_keys) if non_section_keys else F.lit(False)) | ~F.col("usable")
    name = F.struct("first_at", "attr")
    roles = told.groupBy(id_col, "tag", "keys").agg(
        F.max("value_key").alias("value_key"),
        F.array_sort(F.collect_list(F.when(F.col("names"), name))).alias("all_names"),
        F.array_sort(F.collect_list(F.when(F.col("names") & ~left_out, name))).alias("section_names"),
        F.max((F.col("attr") == "n")).alias("has_n"),
        F.min("first_at.pos").alias("first_pos"),
    )
    section = F.col("tag").isin(*section_tags) & F.col("has_n") & (F.size("section_names") == 1)
    keys = F.transform(F.when(section, F.col("section_names")).otherwise(F.col("all_names")), lambda x: x["attr"])
    return roles.select(id_col, "tag", "keys", "value_key", keys.alias("name_keys"), section.alias("is_section"), "first_pos")


def named_events(events: DataFrame, id_col: str, roles: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """``events`` with ``name`` and ``value`` by the roles of their attributes, and ``is_section``; tags without attributes are named by themselves."""
    own = F.array_except(F.map_keys("attrs"), F.array(*[F.lit(x) for x in ignored]).cast("array<string>")) if ignored else F.map_keys("attrs")
    keyed = events.withColumn("keys", F.array_join(own, "\x1f"))
    joined = keyed.join(roles.select(id_col, "tag", "keys", "value_key", "name_keys", "is_section"), [id_col, "tag", "keys"], "left")
    name = F.when(F.size("name_keys") > 0, F.array_join(F.transform("name_keys", lambda k: F.element_at("attrs", k)), "-")).otherwise(F.col("tag"))
    return joined.select(*[F.col(c) for c in events.columns], name.alias("name"), F.element_at("attrs", F.col("value_key")).alias("value"), F.coalesce("is_section", F.lit(False)).alias("is_section"))


def section_names(named: DataFrame, id_col: str) -> DataFrame:
    """(id, sections): the names of a document's sections, by tag and value as they first come."""
    opened = named.where("is_section").groupBy(id_col, "name").agg(F.min("pos").alias("at"))
    return opened.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("sections"))


def value_keys(profile: DataFrame, ignored: tuple[str, ...] = ("corresp", "source", "rend")) -> DataFrame:
    """(tag, value_key) over all documents: ``n`` where there is one, else the attribute of most values, the first by name of equals."""
    usable = profile.where(~F.col("attr").isin(*ignored))
    best = F.min(F.struct((F.col("attr") != "n").alias("not_n"), (-F.col("n_values")).alias("most"), F.col("attr").alias("attr")))
    return usable.groupBy("tag").agg(best.alias("top")).select("tag", F.col("top.attr").alias("value_key"))


def header_fields(events: DataFrame, id_col: str, blocks: dict | None = None) -> DataFrame:
    """(id, field, value): texts before the body.

    Without ``blocks`` by their enclosing tag, joined by a space. With blocks
    (tag → joined, delimiter, end), only the texts in one of them, the innermost:
    all in one field of the block's name, or by the tags below it, whose texts
    are joined where a tag is itself a statement (``…Stmt``). Full stops around
    a text go; authors and editors are in title case.
    """
    doc = Window.partitionBy(id_col)
    body = F.min(F.when(F.col("code") == "bodyStart", F.col("pos"))).over(doc)
    deep = with_depth(events.select("*", body.alias("body__")).where(F.col("pos") < F.coalesce("body__", F.lit(2**31 - 1))), id_col)
    opens = F.col("code").isin("openTag", "openAttrTag")
    inside = F.last(F.when(opens, F.col("tag")), ignorenulls=True).over(Window.partitionBy(id_col, "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    deep = deep.select("*", inside.alias("tag__"))
    if not blocks:
        head = deep.where("code = 'text'").select(id_col, "pos", F.col("tag__").alias("field"), F.col("text").alias("part"), F.lit(" ").alias("by"), F.lit("").alias("end"))
    else:
        known = F.create_map(*[x for n, b in blocks.items() for x in (F.lit(n), F.struct(F.lit(n).alias("block"), F.lit(b.joined).alias("joined"), F.lit(b.delimiter).alias("by"), F.lit(b.end).alias("end")))])
        marker = F.when(opens & F.col("tag").isin(*blocks), F.struct(F.element_at(known, F.col("tag")).alias("b"), F.col("depth").alias("at"))).when((F.col("code") == "closeTag") & F.col("tag").isin(*blocks), F.struct(F.lit(None).cast("struct<block:string,joined:boolean,by:string,end:string>").alias("b"), F.lit(0).cast("bigint").alias("at")))
        block = F.last(marker, ignorenulls=True).over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        below = F.when(F.col("depth") == F.col("in__.at") + 1, F.col("tag__")).otherwise(F.col("child__"))
        told = deep.select("*", block.alias("in__"))
        child = F.last(F.when(opens & (F.col("depth") == F.col("in__.at") + 1), F.col("tag")), ignorenulls=True).over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        told = told.select("*", child.alias("child__")).where((F.col("code") == "text") & F.col("in__.b").isNotNull())
        field = F.when(F.col("in__.b.joined") | (F.col("depth") == F.col("in__.at")), F.col("in__.b.block")).when(F.col("child__").endswith("Stmt"), below).otherwise(F.col("tag__"))
        bare = F.regexp_replace("text", r"^[. ]+|[. ]+\z", "")
        part = F.when(F.col("tag__").isin("author", "editor"), author_case(bare)).otherwise(bare)
        head = told.select(id_col, "pos", field.alias("field"), part.alias("part"), F.col("in__.b.by").alias("by"), F.when(F.col("in__.b.joined"), F.col("in__.b.end")).otherwise("").alias("end"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "by", "part"))), lambda s, k: F.when(k == 0, s["part"]).otherwise(F.concat(s["by"], s["part"]))), "")
    out = head.groupBy(id_col, "field").agg(joined.alias("value"), F.first("end").alias("end"))
    return out.select(id_col, "field", F.when(F.col("value").endswith(F.col("end")), F.col("value")).otherwise(F.concat("value", "end")).alias("value"))


def clean_transcription(c: Column, keep: tuple[str, ...] = ()) -> Column:
    """Tags of a transcription out of its text: bodies of notes, running heads and numbers go; an inner line break goes, another is a space; a gap is named; tags in ``keep`` stay."""
    for tag in ("note", "fw", "num"):
        c = F.regexp_replace(c, rf"<{tag}\b[^>]*>[\s\S]*?</{tag}>", "")
    c = F.regexp_replace(c, r"<lb\b[^>]*break=\"no\"[^>]*/?>", "")
    c = F.regexp_replace(c, r"<lb\b[^>]*/?>", " ")
    c = F.regexp_replace(c, r"<gap\b[^>]*/?>", " {gap} ")
    tags = "|".join(t for t in ("w", "div", "pb", "cb", "ab", "seg", "hi", "unclear", "supplied", "abbr", "ex") if t not in keep)
    c = F.regexp_replace(c, rf"</?(?:{tags})\b[^>]*>", "")
    c = F.regexp_replace(c, r"&[a-z]+;", "")
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def element_spans(events: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, tag, attrs, close_pos): where each opened element closes, by equal depth; an element that never closes has null."""
    deep = with_depth(events, id_col).where(F.col("code").isin("openTag", "openAttrTag", "closeTag"))
    level = Window.partitionBy(id_col, "depth").orderBy("pos")
    after = F.lead(F.struct("code", "pos")).over(level)
    return deep.select(id_col, "pos", "code", "tag", "attrs", F.when(after["code"] == "closeTag", after["pos"]).alias("close_pos")).where(F.col("code") != "closeTag").drop("code")


def xml_sections(events: DataFrame, id_col: str, tag: str, kind_attr: str, value_attr: str, levels: list[str]) -> DataFrame:
    """Text events (id, pos, text) with the value of each section level they stand in.

    Opening a level clears those below it; a level that was never opened above
    an open one has the value 0, as has one cleared.
    """
    attr = lambda name: F.element_at("attrs", name)
    is_div = (F.col("tag") == tag) & F.col("code").isin("openTag", "openAttrTag")
    rank = F.when(is_div, F.array_position(F.array(*[F.lit(x) for x in levels]), attr(kind_attr)))
    run = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    told = events.select(id_col, "pos", "code", "text", F.when(rank > 0, rank).alias("rank"), attr(value_attr).alias("value"))
    cols = []
    for k, level in enumerate(levels, 1):
        mark = F.when(F.col("rank") == k, F.struct(F.lit(True).alias("own"), F.col("value").alias("value"))).when(F.col("rank") < k, F.struct(F.lit(False).alias("own"), F.lit(None).cast("string").alias("value")))
        last = F.last(mark, ignorenulls=True).over(run)
        cols.append(F.when(last["own"], F.coalesce(last["value"], F.lit("0"))).otherwise("0").alias(level))
    return told.select("*", *cols).where("code = 'text'").drop("code", "rank", "value")
