"""Whole conversions: rows or XML to the tables of the annotated-text graph.

Both read segments (rows cut at heads, or the events of XML), count their words
and number slots, sections and elements by windows over the segments; only
sentences and phrases need one over the slots. A document is ordered as a whole;
no window spans documents.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.config import GENERIC, Profile, slot_forms
from quillspark.functions.refs import ordinal_label
from quillspark.operators import graph as G
from quillspark.operators import lexicon as X
from quillspark.operators import segments as S
from quillspark.operators import slots as O
from quillspark.operators import xml_events as E
from quillspark.operators.greek import Lexicons, resolve_words
from quillspark.session import checkpoint_dir
from quillspark.sources.files import list_files, read_delimited, read_xml_texts
from quillspark.sources.sinks import write_graph

_SO_FAR = (Window.unboundedPreceding, 0)
#: The document's column while a conversion runs, so that no column of the caller's can clash.
ID = "doc__"


@dataclass(frozen=True)
class Graph:
    """``slots`` (id, slot, pre, post, forms), ``units`` (id, node, otype, seq, value, from_slot, to_slot) and what is made of them."""

    id_col: str
    slots: DataFrame
    units: DataFrame
    profile: Profile
    levels: DataFrame
    metadata: DataFrame | None = None

    @property
    def nodes(self) -> DataFrame:
        return self.units.select(self.id_col, "node", "otype")

    @property
    def features(self) -> DataFrame:
        return self.units.select(self.id_col, "node", F.col("otype").alias("feature"), F.col("value").alias("feature_value"))

    @property
    def ranges(self) -> DataFrame:
        return G.containment(self.units, self.id_col)

    @property
    def feature_meta(self) -> DataFrame:
        """(id, feature, key, value): descriptions, value types and, where there is a lemma, its coverage."""
        i = self.id_col
        typed = self.units.groupBy(i, F.col("otype").alias("feature")).agg(G.value_type("value").alias("value"))
        typed = typed.select(i, "feature", F.lit("valueType").alias("key"), F.when(F.col("feature") == "_book", "str").otherwise(F.col("value")).alias("value"))
        docs = self.levels.select(i)
        texts = [("pre", "punctuation before word"), ("post", "punctuation after word"), *((n, f.description) for n, f in self.profile.formats.items())]
        rows = [F.struct(F.lit(n).alias("feature"), F.lit(k).alias("key"), F.lit(v).alias("value")) for n, d in texts for k, v in (("valueType", "str"), ("description", d)) if v]
        marks = {"_sentence": self.profile.sentence_marks, "_phrase": self.profile.phrase_marks}
        rows += [F.struct(F.lit(n).alias("feature"), F.lit("description").alias("key"), F.lit(f"{n[1:]}s defined by the following delimiters: {' '.join(m)}").alias("value")) for n, m in marks.items()]
        labels = self.levels.select(i, F.posexplode("levels").alias("at", "feature")).select(i, "feature", F.lit("description").alias("key"), ordinal_label(F.col("at") + 1).alias("value"))
        title = self.units.where("otype = '_book'").select(i, F.lit("_book").alias("feature"), F.lit("description").alias("key"), "value")
        parts = [typed, docs.select(i, F.inline(F.array(*rows))), labels, title]
        if "lemma" in self.slots.columns:
            parts.append(X.coverage(self.slots, [i], "lemma").select(i, F.lit("lemma").alias("feature"), F.lit("coverage_ratio").alias("key"), F.col("coverage").alias("value")))
        return functools.reduce(DataFrame.unionByName, parts)

    @property
    def otext(self) -> DataFrame:
        """(id, key, value): templates of the formats, section and structure types; of more than two sections the first two and the last."""
        n = F.size("levels")
        chosen = F.array_join(F.when(n > 2, F.concat(F.slice("levels", 1, 2), F.slice("levels", -1, 1))).otherwise(F.col("levels")), ",")
        whole = F.array_join(F.concat(F.array(F.lit("_book")), "levels", F.array(F.lit("_sentence"), F.lit("_phrase"))), ",")
        own = [(f.title, f.template.replace("{}", "{" + name + "}")) for name, f in self.profile.formats.items() if f.title]
        rows = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in own]
        rows += [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("sectionTypes", chosen), ("sectionFeatures", chosen), ("structureTypes", whole), ("structureFeatures", whole))]
        return self.levels.select(self.id_col, F.inline(F.array(*rows)))

    def write(self, folder: str, mode: str = "errorifexists") -> None:
        """All tables as Parquet. Nodes are kept in a checkpoint while they are written, as several tables are made of them."""
        checkpoint_dir(self.slots.sparkSession)
        kept = Graph(self.id_col, self.slots, self.units.checkpoint(), self.profile, self.levels, self.metadata)
        write_graph(kept.slots, kept.nodes, kept.features, kept.ranges, folder, mode)
        more = {"feature_meta": kept.feature_meta, "otext": kept.otext} | ({"documents_meta": self.metadata} if self.metadata is not None else {})
        for name, df in more.items():
            df.write.mode(mode).parquet(f"{folder}/{name}")


def _kept(segments: DataFrame) -> DataFrame:
    """Events or counted segments in a checkpoint: texts are cut once, while slots and every kind of node read them."""
    checkpoint_dir(segments.sparkSession)
    return segments.checkpoint()


def _slots(segments: DataFrame, profile: Profile, lemmata: DataFrame | None, lexicons: Lexicons | None) -> DataFrame:
    """Slots of counted segments, with ``sentence`` and ``phrase``.

    ``lexicons`` replace each word by what it stands for; forms from before
    replacements have it as it was.
    """
    flat = segments.where("n > 0").select(ID, "before", F.posexplode("words").alias("at", "w"))
    word, whole = F.col("w.word"), F.col("w.whole")
    pre, post = (F.btrim(f"w.{c}", F.lit("\n")).alias(c) for c in ("pre", "post"))
    if lexicons is not None:
        resolved = resolve_words(flat.select(word.alias("word")), "word", lexicons.elisions, lexicons.crases, lexicons.movable, lexicons.sacra, lexicons.require_mark)
        flat = flat.join(resolved.select(F.col("word").alias("known__"), F.array_join("parts", " ").alias("full__")), word == F.col("known__"), "left")
        word = F.coalesce("full__", word)
    slots = flat.select(ID, (F.col("before") + F.col("at") + 1).alias("slot"), pre, post, *slot_forms(profile, word, whole), word.alias("word__"))
    if lemmata is not None:
        known = slots.select(F.col("word__").alias("w"), F.lower("word__").alias("form"), (F.col("plain") if "plain" in slots.columns else F.lower("word__")).alias("plain_form")).distinct()
        told = X.lemma_of(known, "form", "plain_form", lemmata).select("w", "plain_form", "lemma")
        plain = F.col("plain") if "plain" in slots.columns else F.lower("word__")
        slots = slots.join(told, (F.col("word__") == F.col("w")) & (plain == F.col("plain_form")), "left").drop("w", "plain_form")
    return O.number_units(slots.drop("word__"), ID, profile.sentence_marks, profile.phrase_marks)


def _finish(id_col: str, segments: DataFrame, spans: list[DataFrame], levels: DataFrame, profile: Profile, titles: DataFrame | None, lemmata: DataFrame | None, metadata: DataFrame | None, lexicons: Lexicons | None) -> Graph:
    numbered = _slots(segments, profile, lemmata, lexicons)
    unit = lambda c: numbered.groupBy(ID, F.col(c).cast("long").alias("seq")).agg(F.min("slot").cast("long").alias("from_slot"), F.max("slot").cast("long").alias("to_slot")).select(ID, F.lit("_" + c).alias("otype"), "seq", F.col("seq").cast("string").alias("value"), "from_slot", "to_slot")
    total = segments.where("n > 0").groupBy(ID).agg(F.sum("n").cast("long").alias("to_slot"))
    if titles is not None:
        total = total.join(titles.groupBy(F.col(id_col).alias(ID)).agg(F.max("title").alias("title")), ID, "left")
    title = F.coalesce("title", F.lit("no title found in metadata")) if titles is not None else F.lit("no title found in metadata")
    book = total.select(ID, F.lit("_book").alias("otype"), F.lit(1).cast("long").alias("seq"), title.alias("value"), F.lit(1).cast("long").alias("from_slot"), "to_slot")
    columns = [ID, "otype", "seq", "value", "from_slot", "to_slot"]
    units = functools.reduce(DataFrame.unionByName, [d.select(*columns) for d in (book, unit("sentence"), unit("phrase"), *spans)])
    have = total.select(ID)
    return Graph(id_col, numbered.drop("sentence", "phrase").withColumnRenamed(ID, id_col), G.number_nodes(units, ID).withColumnRenamed(ID, id_col), profile, levels.join(have, ID, "left_semi").withColumnRenamed(ID, id_col), metadata)


def rows_to_graph(
    rows: DataFrame,
    id_col: str,
    order_col: str,
    levels: list[str],
    text_col: str,
    profile: Profile = GENERIC,
    ignore_empty: bool = True,
    titles: DataFrame | None = None,
    lemmata: DataFrame | None = None,
    metadata: DataFrame | None = None,
    lexicons: Lexicons | None = None,
) -> Graph:
    """Rows (id, order, levels…, text) → graph.

    A section node begins where its value or that of a level above differs from
    the slot before; rows that give no slot break nothing. A section's value is
    that of its rows. With the profile's ``bracket_heads`` text in braces becomes
    head nodes over the slots up to the next head. ``titles`` (id, title) name the
    books, ``lemmata`` (form, lemma array) give a lemma, ``metadata`` (id, key,
    value) is passed on, ``lexicons`` replace words slot by slot (what is to
    become two slots goes into the profile's contractions). A document without a slot is left out, or with
    ``ignore_empty=False`` has one empty slot, and 0 as value of its sections.
    """
    own = [f"level{k}__" for k in range(len(levels))]
    src = rows.select(F.col(id_col).alias(ID), F.col(order_col).alias("at__"), *[F.col(c).cast("string").alias(n) for c, n in zip(levels, own, strict=True)], F.col(text_col).cast("string").alias("text__"))
    order = ["at__", "seg"]
    carried = S.carry_words(src, ID, "at__", "text__").drop("text__")
    if profile.bracket_heads:
        cut = S.cut_heads(carried, ID, "at__", "body")
    else:
        cut = carried.select("*", F.lit(0).alias("seg"))
    counted = S.counted(cut, ID, order, "body", profile.contractions, profile.cased, profile.tokenizer)
    if not ignore_empty:
        counted = _with_empty(counted, order, own)
    counted = _kept(counted.select(ID, *order, *(["head", "head_no"] if profile.bracket_heads else []), *own, "words", "n", "before"))
    by_doc = Window.partitionBy(ID).orderBy(*order)
    full = counted.where("n > 0").select(ID, *order, "before", "n", *own)
    for k in range(len(own)):
        prefix = F.struct(*[F.col(c) for c in own[: k + 1]])
        full = full.withColumn(f"new{k}__", ((F.row_number().over(by_doc) == 1) | ~prefix.eqNullSafe(F.lag(prefix).over(by_doc))).cast("int"))
    full = full.select(ID, "before", "n", *own, *[F.sum(f"new{k}__").over(by_doc.rowsBetween(*_SO_FAR)).cast("long").alias(f"seq{k}__") for k in range(len(own))])
    spans = []
    if levels:
        kinds = [F.struct(F.lit(level).alias("otype"), F.col(f"seq{k}__").alias("seq"), F.coalesce(F.col(own[k]), F.lit("")).alias("value")) for k, level in enumerate(levels)]
        long = full.select(ID, "before", "n", F.inline(F.array(*kinds)))
        spans.append(long.groupBy(ID, "otype", "seq", "value").agg((F.min("before") + 1).cast("long").alias("from_slot"), F.max(F.col("before") + F.col("n")).cast("long").alias("to_slot")))
    if profile.bracket_heads:
        spans.append(_covering(counted.where("head IS NOT NULL"), counted, order, F.lit("head"), "head", F.col("head_no"), ""))
    names = rows.select(id_col).distinct().select(F.col(id_col).alias(ID), F.array(*[F.lit(x) for x in levels]).cast("array<string>").alias("levels"))
    return _finish(id_col, counted, spans, names, profile, titles, lemmata, metadata, lexicons)


def _with_empty(counted: DataFrame, order: list[str], levels: list[str]) -> DataFrame:
    """Documents without a slot get an empty one at their end; their sections have the value 0."""
    doc = Window.partitionBy(ID)
    none = F.sum("n").over(doc) == 0
    last = F.row_number().over(doc.orderBy(*[F.desc(c) for c in order])) == 1
    filler = F.array(F.struct(F.lit("").alias("pre"), F.lit("").alias("word"), F.lit("").alias("post"), F.lit("").alias("whole"), F.lit(0).alias("part")))
    told = counted.withColumn("fill__", none & last)
    for level in levels:
        told = told.withColumn(level, F.when(F.col("fill__"), "0").otherwise(F.col(level)))
    return told.withColumn("words", F.when(F.col("fill__"), filler).otherwise(F.col("words"))).withColumn("n", F.when(F.col("fill__"), 1).otherwise(F.col("n"))).drop("fill__")


def _covering(parts: DataFrame, counted: DataFrame, order: list[str], otype: Column, text_col: str, group: Column, glue: str) -> DataFrame:
    """Nodes of texts that are no slots: parts of one group joined, over the slots from there to the next one of its type; those without a slot are left out."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text_col).alias("t__")))), lambda x: x["t__"]), glue)
    told = parts.select(ID, *order, text_col, F.col("before").alias("before__"), otype.alias("otype"), group.alias("g__")).groupBy(ID, "otype", "g__").agg(joined.alias("value"), F.max("before__").alias("at"))
    total = counted.where("n > 0").groupBy(ID).agg(F.sum("n").alias("total__"))
    own = Window.partitionBy(ID, "otype").orderBy("at", "g__")
    told = told.join(total, ID).select("*", F.row_number().over(own).cast("long").alias("seq"), F.coalesce(F.lead("at").over(own), F.col("total__")).alias("until"))
    return told.where("until > at").select(ID, "otype", "seq", "value", (F.col("at") + 1).cast("long").alias("from_slot"), F.col("until").cast("long").alias("to_slot"))


def xml_to_graph(docs: DataFrame, id_col: str, xml_col: str, profile: Profile = GENERIC, ignore_empty: bool = True, titles: DataFrame | None = None, lemmata: DataFrame | None = None, sections: list[str] | None = None, roles: DataFrame | None = None, lexicons: Lexicons | None = None) -> Graph:
    """Documents (id, xml) → graph; those without a body are left out.

    Attributes tell which tags are sections and what names and numbers them (see
    ``attribute_roles``). A section's value is that of its tag; where a level
    stands above text or a lower level without having been opened, it has a node
    of value 0, or one less than the number that its level opens with next. A
    section without a word has an empty slot. Texts in non-text tags are values
    of nodes over the slots behind them. Other tags are nodes over the slots up
    to where they close, or, if they don't, up to the next one of their name; so
    are the attributes among ``feature_attributes``. A tag without attributes has
    its running number as value. Header fields become metadata.
    """
    events = E.xml_events(docs.select(F.col(id_col).alias(ID), F.col(xml_col).alias("xml__")), ID, "xml__", dict(profile.corrections) or None)
    meta = E.header_fields(events, ID, profile.header_blocks).select(ID, F.col("field").alias("key"), "value")
    if titles is None:
        titles = meta.where("key = 'title'").select(F.col(ID).alias(id_col), F.col("value").alias("title"))
    body = _kept(E.body_events(events, ID))
    if roles is None:
        roles = E.attribute_roles(body, ID, profile.section_tags, profile.section_keys, profile.ignored_attributes, profile.non_section_keys, profile.non_section_values)
    named = E.named_events(body, ID, roles, profile.ignored_attributes)
    names = E.section_names(named, ID) if sections is None else docs.select(F.col(id_col).alias(ID)).distinct().select(ID, F.array(*[F.lit(x) for x in sections]).cast("array<string>").alias("sections"))
    by_doc = Window.partitionBy(ID).orderBy("pos")
    opens, alone, closes = F.col("code").isin("openTag", "openAttrTag"), F.col("code").isin("openCloseTag", "closedAttrTag"), F.col("code") == "closeTag"
    level = F.array_position(F.coalesce("sections", F.array().cast("array<string>")), F.col("name"))
    named = named.join(names, ID, "left").withColumn("level", F.when((opens | alone) & (level > 0) & F.col("attrs").isNotNull(), level.cast("int")))
    # what closes what, and what a text stands in
    deep = E.with_depth(named, ID)
    element = Window.partitionBy(ID, "depth").orderBy("pos")
    is_plain = F.col("tag").isin(*profile.non_text_tags) if profile.non_text_tags else F.lit(False)
    deep = deep.withColumn("opener__", F.last(F.when(opens, F.struct("pos", "level")), ignorenulls=True).over(element.rowsBetween(Window.unboundedPreceding, -1)))
    deep = deep.withColumn("aside__", F.sum(F.when(opens & is_plain, 1).when(closes & is_plain, -1).otherwise(0)).over(by_doc.rowsBetween(*_SO_FAR)))
    deep = deep.withColumn("aside_tag__", F.last(F.when(opens & is_plain, F.col("tag")), ignorenulls=True).over(by_doc.rowsBetween(*_SO_FAR)))
    deep = deep.withColumn("closes__", F.when(closes, F.col("opener__.level")))
    is_text = F.col("code") == "text"
    carried = S.carry_words(deep, ID, "pos", "text", is_text & (F.col("aside__") <= 0))
    counted = S.counted(carried, ID, ["pos"], "body", profile.contractions, profile.cased, profile.tokenizer)
    # a section that ends, or is followed by one of its level or above, before any word
    edge = F.when(F.col("level").isNotNull() | F.col("closes__").isNotNull(), F.struct(F.col("level"), F.col("before").alias("at")))
    # the next one in order is the last one before in reverse order, which a window finds in one pass
    back = Window.partitionBy(ID).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(edge, ignorenulls=True).over(back)
    total = F.sum("n").over(Window.partitionBy(ID))
    empty = F.col("level").isNotNull() & (F.coalesce(following["at"], total) == F.col("before")) & ~F.coalesce(following["level"] > F.col("level"), F.lit(False))
    filler = F.array(F.struct(F.lit("").alias("pre"), F.lit("").alias("word"), F.lit("").alias("post"), F.lit("").alias("whole"), F.lit(0).alias("part")))
    counted = counted.withColumn("fill__", empty).withColumn("words", F.when(F.col("fill__"), filler).otherwise(F.col("words"))).withColumn("n", F.when(F.col("fill__"), 1).otherwise(F.col("n"))).drop("before")
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(ID)))
    if not ignore_empty:
        counted = _with_empty(counted, ["pos"], []).withColumn("total", F.greatest("total", F.lit(1)))
    counted = _kept(counted.select(ID, "pos", "code", "tag", "attrs", "text", "name", "value", "sections", "level", "depth", "closes__", "aside__", "aside_tag__", "words", "n", "before", "total"))
    spans = [_section_spans(counted), _element_spans(counted, profile)]
    if profile.non_text_tags:
        asides = counted.where((F.col("code") == "text") & (F.col("aside__") > 0))
        spans.append(_covering(asides, counted, ["pos"], F.col("aside_tag__"), "text", F.col("before"), " "))
    levels = docs.select(F.col(id_col).alias(ID)).distinct().join(names, ID, "left").select(ID, F.coalesce("sections", F.array().cast("array<string>")).alias("levels"))
    return _finish(id_col, counted, spans, levels, profile, titles, lemmata, meta.withColumnRenamed(ID, id_col), lexicons)


def _section_spans(counted: DataFrame) -> DataFrame:
    """Nodes of the section levels: one row for each event and level, and the last opening of the level, or of one above, before it."""
    edges = counted.where((F.size("sections") > 0) & ((F.col("n") > 0) | F.col("level").isNotNull() | F.col("closes__").isNotNull()))
    long = edges.select(ID, "pos", "n", "before", "level", "closes__", "value", F.posexplode("sections").alias("k", "otype")).withColumn("k", F.col("k") + 1)
    run = Window.partitionBy(ID, "k").orderBy("pos")
    own = F.col("level") == F.col("k")
    mark = F.when(own, F.struct(F.col("pos").alias("at"), F.col("value").alias("v"), F.lit(True).alias("open"))).when((F.col("level") < F.col("k")) | (F.col("closes__") <= F.col("k")), F.struct(F.col("pos").alias("at"), F.lit(None).cast("string").alias("v"), F.lit(False).alias("open")))
    state = F.last(mark, ignorenulls=True).over(run.rowsBetween(*_SO_FAR))
    # only the last node of value 0 before an opening is numbered by it
    sign = F.when(own, F.struct(F.col("value").alias("v"))).when(F.col("n") > 0, F.struct(F.lit(None).cast("string").alias("v")))
    later = F.last(sign, ignorenulls=True).over(Window.partitionBy(ID, "k").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1))["v"]
    told = long.select(ID, "otype", "n", "before", F.coalesce(state["at"], F.lit(-1)).alias("seq"), F.coalesce(state["open"], F.lit(False)).alias("open"), state["v"].alias("v"), later.alias("later")).where("n > 0")
    guessed = F.when(F.max("later").rlike(r"^[0-9]{1,18}\z"), (F.max("later").cast("long") - 1).cast("string")).otherwise("0")
    value = F.when(F.bool_and("open"), F.coalesce(F.max("v"), F.lit(""))).otherwise(guessed)
    told = told.groupBy(ID, "otype", "seq").agg(value.alias("value"), (F.min("before") + 1).cast("long").alias("from_slot"), F.max(F.col("before") + F.col("n")).cast("long").alias("to_slot"))
    return told.withColumn("seq", F.col("seq").cast("long"))


def _element_spans(counted: DataFrame, profile: Profile) -> DataFrame:
    """Nodes of tags that are neither sections nor aside, and of their feature attributes."""
    opens, alone = F.col("code").isin("openTag", "openAttrTag"), F.col("code").isin("openCloseTag", "closedAttrTag")
    back = Window.partitionBy(ID, "depth").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.when(F.col("code") == "closeTag", F.col("before")), ignorenulls=True).over(back)
    tagged = counted.withColumn("until__", F.when(opens, F.coalesce(after, F.col("total")))).where(opens | alone)
    tagged = tagged.withColumn("until__", F.when(alone, F.coalesce(F.lead("before").over(Window.partitionBy(ID, "name", alone).orderBy("pos")), F.col("total"))).otherwise(F.col("until__")))
    tagged = tagged.withColumn("number__", F.row_number().over(Window.partitionBy(ID, "tag", F.col("attrs").isNull()).orderBy("pos")))
    aside = F.col("tag").isin(*profile.non_text_tags) if profile.non_text_tags else F.lit(False)
    main = F.struct(F.col("name").alias("otype"), F.coalesce(F.when(F.col("attrs").isNotNull(), F.coalesce("value", F.lit(""))), F.col("number__").cast("string")).alias("value"), (F.col("level").isNull() & ~aside).alias("kept"))
    linked = [F.struct(F.lit(a).alias("otype"), F.element_at("attrs", a).alias("value"), F.element_at("attrs", a).isNotNull().alias("kept")) for a in profile.feature_attributes]
    told = tagged.select(ID, F.col("pos").cast("long").alias("seq"), "before", "until__", F.inline(F.array(main, *linked))).where("kept AND until__ > before")
    return told.select(ID, "otype", "seq", "value", (F.col("before") + 1).cast("long").alias("from_slot"), F.col("until__").cast("long").alias("to_slot"))


def convert_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool | list[str] = True, profile: Profile = GENERIC, ignore_empty: bool = True, lemmata: DataFrame | None = None, metadata: DataFrame | None = None) -> Graph:
    """Delimited files, one or a folder of them, each a document by its path; sections in all columns but the last, text in the last.

    ``metadata`` (file name, key, value) joins documents by their file's name;
    its ``title`` names the book.
    """
    df = read_delimited(spark, path, sep, header, with_source=True)
    *levels, text = [c for c in df.columns if c not in ("doc_id", "row_no")]
    own = None
    if metadata is not None:
        names = df.select("doc_id").distinct().withColumn("file", F.element_at(F.split("doc_id", "/"), -1))
        own = names.join(metadata.select("file", "key", "value"), "file").select("doc_id", "key", "value")
    titles = own.where("key = 'title'").select("doc_id", F.col("value").alias("title")) if own is not None else None
    return rows_to_graph(df, "doc_id", "row_no", levels, text, profile, ignore_empty, titles, lemmata, own)


def convert_xml(spark: SparkSession, path: str, profile: Profile = GENERIC, ignore_empty: bool = True, lemmata: DataFrame | None = None) -> Graph:
    """XML files, each a document by its path."""
    return xml_to_graph(read_xml_texts(spark, path).withColumnRenamed("path", "doc_id"), "doc_id", "xml", profile, ignore_empty, None, lemmata)


def convert(spark: SparkSession, folder: str, out: str, profile: Profile = GENERIC, name_part: str = "", mode: str = "ignore", **settings) -> dict[str, tuple[int, int]]:
    """Every file under a folder by its kind: delimited (csv, tsv) or XML; what another run has written stays. By kind, how many files were seen and how many gave a document."""
    seen = {r["extension"]: r["count"] for r in list_files(spark, folder, name_part).groupBy("extension").count().collect()}
    done = {}
    for extension in sorted({"csv", "tsv", "xml"} & set(seen)):
        path = f"{folder}/*{name_part}*.{extension}"
        graph = convert_xml(spark, path, profile) if extension == "xml" else convert_delimited(spark, path, profile=profile, **settings)
        graph.write(f"{out}/{extension}", mode)
        done[extension] = (seen[extension], spark.read.parquet(f"{out}/{extension}/slots").select("doc_id").distinct().count())
    return done
