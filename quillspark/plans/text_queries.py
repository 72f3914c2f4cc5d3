"""Queries of tokens, word forms, slots and lexicons, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.unicode import normalize
from quillspark.operators import greek as K
from quillspark.operators import lexicon as X
from quillspark.operators import slots as O
from quillspark.session import table

# Small lexicons of our own.
ELISIONS = [("l᾽", ["la", "le"]), ("d᾽", ["de"]), ("qu᾽", ["que"]), ("ἀλλ᾽", ["ἀλλά"]), ("δι᾽", ["διά"])]
CONTRACTIONS = [("du", "de le"), ("des", "de les"), ("au", "à le"), ("zum", "zu dem"), ("zur", "zu der"), ("im", "in dem"), ("del", "de el"), ("al", "a el")]
CRASES = [("κἀγώ", "καὶ ἐγώ"), ("κἀν", "καὶ ἐν"), ("τοὔνομα", "τὸ ὄνομα"), ("que", "quod est")]
ABBREVIATED = [("dms", "dominus"), ("ds", "deus"), ("sps", "spiritus"), ("θς", "θεος"), ("κς", "κυριος"), ("πνα", "πνευμα")]


def _lexicon(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _slots(spark: SparkSession, d: str) -> DataFrame:
    return O.explode_slots(table(spark, d, "documents"), "doc_id", "text")


def q_tokens(spark: SparkSession, d: str) -> DataFrame:
    return O.explode_tokens(table(spark, d, "documents"), "doc_id", "text")


def q_slots(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d)


def q_clean_words(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.explode(T.clean_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def q_plain_freq_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most frequent plain forms; a report of the top."""
    counts = _slots(spark, d).groupBy("plain").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "plain").limit(50)


def q_forms(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "wordforms")
    o = F.col("orig")
    return w.select("form_id", T.plain_low(o).alias("plain_low"), T.plain_caps(o).alias("plain_caps"), T.clean_plain(F.col("plain")).alias("clean_plain"), T.strip_all_letters(o).alias("letters"), T.is_ascii(o).alias("is_ascii"), T.one_apostrophe(o).alias("one_apostrophe"))


def q_alternatives(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "slots").select("lemma").where("lemma <> ''").distinct()
    return s.select("lemma", T.main_word(F.col("lemma")).alias("main_word"), T.plain_word(F.col("lemma")).alias("plain_word"))


def q_sides(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "slots").select(F.concat("pre", "orig", "post").alias("token")).distinct()
    left, right = T.split_left(F.col("token")), T.split_right(F.col("token"))
    return s.select("token", left["punc"].alias("left_punc"), left["word"].alias("left_word"), right["word"].alias("right_word"), right["punc"].alias("right_punc"))


def q_case_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    words = F.transform(T.tokens(F.col("text")), lambda t: F.trim(t))
    return docs.select("doc_id", F.md5(T.minuscule(words)).alias("minuscule"), F.length(T.majuscule(words)).alias("n_majuscule"))


def q_letters(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "wordforms")
    return w.select("form_id", T.greek_letters(F.col("plain")).alias("repaired"), T.to_latin(F.col("plain")).alias("latin"), T.to_greek(T.to_latin(F.col("plain"))).alias("greek"))


def q_units(spark: SparkSession, d: str) -> DataFrame:
    return O.number_units(_slots(spark, d), "doc_id").select("doc_id", "slot", "sentence", "phrase")


def q_sentence_len_stats(spark: SparkSession, d: str) -> DataFrame:
    lens = O.number_units(_slots(spark, d), "doc_id").groupBy("doc_id", "sentence").agg(F.count("*").alias("n"))
    by_lang = lens.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return by_lang.groupBy("lang").agg(F.count("*").alias("sentences"), F.round(F.avg("n"), 6).alias("avg_len"), F.max("n").alias("max_len"))


def q_render(spark: SparkSession, d: str) -> DataFrame:
    s = O.once(table(spark, d, "slots"), ["doc_id", "slot"], "loaded_at")
    return O.render(s, "doc_id", ["pre", "orig", "post"])


def q_once(spark: SparkSession, d: str) -> DataFrame:
    return O.once(table(spark, d, "slots"), ["doc_id", "slot"], "loaded_at").groupBy("source").agg(F.count("*").alias("slots"), F.count_distinct("doc_id").alias("docs"), F.count("lemma").alias("with_lemma"))


def q_before_replace(spark: SparkSession, d: str) -> DataFrame:
    words = O.explode_tokens(table(spark, d, "documents"), "doc_id", "text").where("word <> ''")
    return X.resolve_contraction(words, ["doc_id", "token_no"], "word", _lexicon(spark, CONTRACTIONS, "key string, value string"))


def q_elision(spark: SparkSession, d: str) -> DataFrame:
    marks = "[" + T.APOSTROPHES + T.APOSTROPHE + "]"
    words = _slots(spark, d).where(F.col("post").rlike("^" + marks)).select(F.lower("orig").alias("word")).distinct()
    return X.resolve_elision(words, "word", _lexicon(spark, ELISIONS, "key string, value array<string>")).select("word", F.array_join("full", ",").alias("full"))


def q_movable(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "slots").select("plain").where("plain <> ''").distinct()
    return X.with_movable(w, "plain", "ν").unionByName(X.with_movable(w, "plain", "s"))


def q_nomina(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "slots").select("plain").where("plain <> ''").distinct()
    return X.resolve_names(w, "plain", _lexicon(spark, ABBREVIATED, "key string, value string"))


def q_greek_words(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "slots").select("orig")
    movable = q_movable(spark, d).where(F.col("plain").endswith("ν")).select(F.col("plain").alias("form"))
    lex = lambda rows, value: _lexicon(spark, rows, f"key string, value {value}")
    out = K.resolve_words(words, "orig", lex(ELISIONS, "array<string>"), lex(CRASES, "string"), movable, lex(ABBREVIATED, "string"))
    return out.select("word", F.array_join("parts", " ").alias("parts"))


def q_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "wordforms")
    return w.select("form_id", normalize(normalize(F.col("orig"), "NFD"), "NFC").alias("composed"))


def q_lemma_cascade(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "wordforms").select("form_id", "lang", "orig", "plain", T.strip_all_letters(F.col("orig")).alias("norm"))
    return X.lemma_cascade(w, "lang", "orig", "plain", table(spark, d, "lemmata"), "norm").select("form_id", "lemma")


def q_lemma_coverage(spark: SparkSession, d: str) -> DataFrame:
    return X.coverage(O.once(table(spark, d, "slots"), ["doc_id", "slot"], "loaded_at"), ["doc_id"], "lemma")


def q_lexicon_build(spark: SparkSession, d: str) -> DataFrame:
    forms = table(spark, d, "wordforms").where("plain IS NOT NULL").select(F.col("orig").alias("form"), F.array("plain").alias("lemma"))
    return X.build_lexicon(table(spark, d, "lemmata"), "form", "lemma", forms).select("form", F.array_join("lemmata", ",").alias("lemmata"))


def q_lexicon_derived(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "lemmata").select("form", F.array_join(F.array_sort("lemma"), ",").alias("lemma")).distinct()
    derived = table(spark, d, "wordforms").where("plain <> ''").select(F.col("plain").alias("form"), F.concat(F.lit("*"), "plain").alias("lemma")).distinct()
    return X.only_absent(base, derived, "form")


def q_ascii_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(T.is_ascii(F.col("text"))).alias("ascii_docs"), F.count_if(T.ends_open(F.col("text"))).alias("open_docs"))


def q_joined_lines(spark: SparkSession, d: str) -> DataFrame:
    joined = T.join_lines(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(joined).alias("joined"), F.length(joined).alias("n"))


_L = r"\p{Lu}\p{Ll}\p{Lt}\p{M}"
_BARE = r"[^\p{Lu}\p{Ll}\p{Lt}]"


def sql_plain(c: str) -> str:
    return f"lower(regexp_replace(replace(strip_accents({c}), 'Σ', 'σ'), '{_BARE}', '', 'g'))"


# The token grammar by runs: letters with their marks, and the gaps between them. A gap without a separator that ends in - or < joins two runs; another is cut behind its last separator.
_Z, _C = r"\p{Z}", r"[\p{Lu}\p{Ll}\p{Lt}]"
_JOINS = f"NOT regexp_matches(run, '{_Z}') AND regexp_matches(run, '[-<]\\z')"
_BEHIND = f"regexp_extract(run, '(?s)^(.*{_Z})', 1)"


def sql_runs(letter: str, source: str = "documents", keys: str = "doc_id, lang", text: str = "text", names: str = "") -> str:
    """CTEs runs and words: each word with its number and its gaps, as ``before`` and ``after``; ``first`` and ``last`` gaps whole."""
    ids = keys.split(", ")[0]
    return (
        f"r0{names} AS (SELECT {keys}, regexp_extract_all({text}, '{letter}|{_not(letter)}+') AS l FROM {source}), "
        f"r1{names} AS (SELECT {keys}, len(l) AS n, unnest(l) AS run, unnest(range(1, len(l) + 1)) AS k FROM r0{names}), "
        f"r2{names} AS (SELECT *, regexp_matches(run, '^(?:{letter})') AS is_word, k > 1 AND k < n AND NOT ({_JOINS}) AS cuts FROM r1{names}), "
        f"r3{names} AS (SELECT *, 1 + coalesce(sum((cuts AND NOT is_word)::INT) OVER (PARTITION BY {ids} ORDER BY k), 0) AS no FROM r2{names}), "
        f"words{names} AS (SELECT {keys}, no, string_agg(run, '' ORDER BY k) FILTER (is_word) AS word, string_agg(run, '' ORDER BY k) FILTER (is_word OR (k > 1 AND k < n AND NOT cuts)) AS core, "
        f"coalesce(max(CASE WHEN NOT is_word AND k = 1 THEN run END), '') AS first, coalesce(max(CASE WHEN NOT is_word AND k = n AND k > 1 THEN run END), '') AS last, "
        f"coalesce(max(CASE WHEN NOT is_word AND cuts THEN substr(run, length({_BEHIND}) + 1) END), '') AS cut_pre, "
        f"coalesce(max(CASE WHEN NOT is_word AND cuts THEN CASE WHEN regexp_matches(run, '{_Z}') THEN {_BEHIND} ELSE run END END), '') AS cut_post, "
        f"coalesce(bool_and(regexp_matches(run, '{_Z}')) FILTER (NOT is_word AND cuts), true) AS parted FROM r3{names} GROUP BY {keys}, no), "
        f"cut{names} AS (SELECT {keys}, no, word, core, first, last, CASE WHEN parted THEN cut_pre ELSE '' END AS cut_pre, lead(cut_post, 1, '') OVER (PARTITION BY {ids} ORDER BY no) AS cut_post FROM words{names})"
    )


def _not(letter: str) -> str:
    return {f"[{_L}]+": f"[^{_L}]", f"{_C}[{_L}]*": f"[^{_C[1:]}"}[letter]


# Every token, also those without a letter: what stands before the first word is cut behind separators, what is behind the last one likewise.
_WORDS = "WITH " + sql_runs(f"[{_L}]+")
TOKENS = _WORDS + (
    f", lead AS (SELECT doc_id, lang, regexp_extract_all(first, '(?s).[^{_Z}]*{_Z}') AS l, first FROM cut WHERE no = 1), "
    f"parts AS (SELECT doc_id, lang, 0 AS g, unnest(l) AS pre, unnest(range(1, len(l) + 1)) AS nth, '' AS word, '' AS post, '' AS core FROM lead "
    f"UNION ALL SELECT doc_id, lang, 2, substr(first, length(array_to_string(l, '')) + 1), 0, '', '', '' FROM lead SEMI JOIN (SELECT doc_id FROM cut GROUP BY 1 HAVING count(word) = 0) USING (doc_id) WHERE length(array_to_string(l, '')) < length(first) "
    f"UNION ALL SELECT doc_id, lang, 1, CASE WHEN no = 1 THEN regexp_replace(first, '(?s)^(.[^{_Z}]*{_Z})+', '') ELSE cut_pre END, no, word, CASE WHEN last = '' THEN cut_post WHEN regexp_matches(last, '{_Z}') THEN regexp_extract(last, '(?s)^(.*{_Z})', 1) ELSE last END, core FROM cut WHERE word IS NOT NULL "
    f"UNION ALL SELECT doc_id, lang, 2, regexp_replace(last, '(?s)^.*{_Z}', ''), no, '', '', '' FROM cut WHERE regexp_matches(last, '(?s){_Z}[^{_Z}]+\\z')), "
    "tokens AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY g, nth) AS token_no, trim(pre, chr(10)) AS pre, word, trim(post, chr(10)) AS post FROM parts)"
)
SLOTS = "WITH " + sql_runs(f"{_C}[{_L}]*") + (
    f", s AS (SELECT doc_id, no AS slot, trim(CASE WHEN no = 1 THEN first ELSE cut_pre END, chr(10)) AS pre, word AS orig, trim(CASE WHEN last <> '' THEN last ELSE cut_post END, chr(10)) AS post, {sql_plain('word')} AS plain FROM cut WHERE word IS NOT NULL)"
)
UNITS = SLOTS + (
    ", u AS (SELECT *, 1 + coalesce(sum(CASE WHEN regexp_matches(post, '[.?!]') THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS sentence, "
    "1 + coalesce(sum(CASE WHEN regexp_matches(post, '[.?!,;:]') THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS phrase FROM s "
    "WINDOW w AS (PARTITION BY doc_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
)
ONCE = "WITH once AS (SELECT doc_id, slot, arg_max(source, loaded_at) AS source, arg_max(struct_pack(a := pre, b := orig, c := post, l := lemma), loaded_at) AS v FROM slots GROUP BY doc_id, slot)"
_ALT = "array_to_string(list_sort(list_distinct(list_transform(string_split({c}, ','), lambda x: {f}))), ',')"
_VALUES = lambda rows: ", ".join("(" + ", ".join("[" + ", ".join(f"'{y}'" for y in x) + "]" if isinstance(x, list) else f"'{x}'" for x in r) + ")" for r in rows)
_MARKS = "[" + (T.APOSTROPHES + T.APOSTROPHE).replace("'", "''") + "]"

_ELISION = f"lex(key, value) AS (VALUES {_VALUES(ELISIONS)}), el AS (SELECT key, true AS exact, list_sort(value) AS value FROM lex UNION ALL SELECT k || '᾽', false, list_sort(list_distinct(flatten(list(value)))) FROM (SELECT {sql_plain('key')} AS k, value FROM lex) GROUP BY k)"
_RANK = "CASE WHEN ends_with(key, '᾽') AND starts_with(key, '᾽') THEN 3 WHEN starts_with(key, '᾽') THEN 2 ELSE 0 END"
_GREEK = "regexp_replace(regexp_replace(translate(word, 'abgdezhqiklmncoprstufxywj', 'αβγδεζηθικλμνξοπρστυφχψως'), 'σ([^\\p{L}])', 'ς\\1', 'g'), 'σ\\z', 'ς')"

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

ORACLES = {
    "q_tokens": TOKENS + " SELECT doc_id, token_no, pre, word, post FROM tokens",
    "q_slots": SLOTS + " SELECT * FROM s",
    "q_clean_words": f"WITH b AS (SELECT unnest(regexp_split_to_array(text, '{_Z}')) AS block FROM documents), w AS (SELECT regexp_replace(block, '[^{_L}]', '', 'g') AS word FROM b) SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word",
    "q_plain_freq_topk": SLOTS + " SELECT plain, count(*) AS n FROM s GROUP BY plain ORDER BY n DESC, plain LIMIT 50",
    "q_forms": f"SELECT form_id, {sql_plain('orig')} AS plain_low, upper(replace({sql_plain('orig')}, 'ß', 'ss')) AS plain_caps, regexp_replace(plain, '[ινσς]', '', 'g') AS clean_plain, lower(regexp_replace(replace(strip_accents(orig), 'Σ', 'σ'), '[^\\p{{L}}]', '', 'g')) AS letters, regexp_full_match(orig, '[\\x00-\\x7F]*') AS is_ascii, translate(orig, '{T.APOSTROPHES.replace(chr(39), chr(39) * 2)}', '{T.APOSTROPHE * len(T.APOSTROPHES)}') AS one_apostrophe FROM wordforms",
    "q_alternatives": f"SELECT DISTINCT lemma, {_ALT.format(c='lower(lemma)', f='x')} AS main_word, {_ALT.format(c='lemma', f=sql_plain('x'))} AS plain_word FROM slots WHERE lemma <> ''",
    "q_sides": f"WITH k AS (SELECT DISTINCT pre || orig || post AS token FROM slots) SELECT token, regexp_extract(token, '^([^{_L}]*)', 1) AS left_punc, regexp_replace(token, '^[^{_L}]*', '') AS left_word, regexp_replace(token, '[^{_L}]*\\z', '') AS right_word, regexp_extract(token, '([^{_L}]*)\\z', 1) AS right_punc FROM k",
    "q_units": UNITS + " SELECT doc_id, slot, sentence, phrase FROM u",
    "q_sentence_len_stats": UNITS + ", n AS (SELECT doc_id, sentence, count(*) AS n FROM u GROUP BY 1, 2) SELECT lang, count(*) AS sentences, round(avg(n), 6) AS avg_len, max(n) AS max_len FROM n JOIN documents USING (doc_id) GROUP BY lang",
    "q_render": ONCE + " SELECT doc_id, string_agg(coalesce(v.a, '') || coalesce(v.b, '') || coalesce(v.c, ''), '' ORDER BY slot) AS text FROM once GROUP BY doc_id",
    "q_once": ONCE + " SELECT source, count(*) AS slots, count(DISTINCT doc_id) AS docs, count(v.l) AS with_lemma FROM once GROUP BY source",
    "q_before_replace": TOKENS + f", lex(key, value) AS (VALUES {_VALUES(CONTRACTIONS)}), j AS (SELECT doc_id, token_no, pre, word AS whole, post, coalesce(string_split(value, ' '), [word]) AS w FROM tokens LEFT JOIN lex ON lower(word) = key WHERE word <> ''), p AS (SELECT *, unnest(range(0, len(w))) AS part FROM j) SELECT doc_id, token_no, part, CASE WHEN part = 0 THEN pre ELSE '' END AS pre, w[part + 1] AS word, CASE WHEN part = len(w) - 1 THEN post ELSE ' ' END AS post, CASE WHEN part = 0 THEN whole ELSE '' END AS orig FROM p",
    "q_elision": SLOTS + f", w AS (SELECT DISTINCT lower(orig) AS word FROM s WHERE regexp_matches(post, '^{_MARKS}')), {_ELISION}, k AS (SELECT word, min(struct_pack(r := {_RANK}, e := NOT exact, v := value)) AS best FROM w JOIN el ON (exact AND key IN (word || '᾽', '᾽' || word, '᾽' || word || '᾽')) OR (NOT exact AND key IN ({sql_plain('word')} || '᾽', '᾽' || {sql_plain('word')}, '᾽' || {sql_plain('word')} || '᾽')) GROUP BY word) SELECT word, array_to_string(best.v, ',') AS full FROM w LEFT JOIN k USING (word)",
    "q_greek_words": f"WITH w0 AS (SELECT DISTINCT orig, lower(orig) AS word FROM slots WHERE orig IS NOT NULL), b AS (SELECT orig, translate(CASE WHEN regexp_full_match(word, '[\\x00-\\x7F]*') THEN {_GREEK} ELSE word END, '{T.APOSTROPHES.replace(chr(39), chr(39) * 2)}', '{T.APOSTROPHE * len(T.APOSTROPHES)}') AS word FROM w0), {_ELISION}, "
    f"k AS (SELECT word, min(struct_pack(r := {_RANK}, e := NOT exact, v := value)) AS best FROM (SELECT DISTINCT word, {sql_plain('word')} AS p FROM b) JOIN el ON (exact AND key IN (word || '᾽', '᾽' || word, '᾽' || word || '᾽')) OR (NOT exact AND key IN (p || '᾽', '᾽' || p, '᾽' || p || '᾽')) GROUP BY word), e AS (SELECT orig, coalesce(array_to_string(best.v, ','), word) AS word FROM b LEFT JOIN k USING (word)), "
    f"cr(key, value) AS (VALUES {_VALUES(CRASES)}), c AS (SELECT orig, string_split(coalesce(value, word), ' ') AS l FROM e LEFT JOIN cr ON word = key), p AS (SELECT orig, unnest(l) AS w, unnest(range(0, len(l))) AS part FROM c), q AS (SELECT *, {sql_plain('w')} AS plain FROM p), "
    f"pl AS (SELECT DISTINCT plain FROM slots WHERE plain <> ''), mv AS (SELECT plain FROM pl WHERE plain LIKE '%ν' AND left(plain, -1) IN (SELECT plain FROM pl)), m AS (SELECT orig, part, plain, replace(regexp_replace(replace(CASE WHEN plain IN (SELECT plain FROM mv) THEN left(w, -1) ELSE w END, 'ϲ', 'σ'), 'σ\\z', 'ς'), '¯', 'ν') AS w FROM q), sa(key, value) AS (VALUES {_VALUES(ABBREVIATED)}) "
    "SELECT orig AS word, string_agg(CASE WHEN plain IN ('ουχ', 'ουκ') THEN left(w, -1) WHEN plain = 'εξ' THEN left(w, -1) || 'κ' ELSE coalesce(value, w) END, ' ' ORDER BY part) AS parts FROM m LEFT JOIN sa ON w = key GROUP BY orig",
    "q_normal_forms": "SELECT form_id, nfc_normalize(orig) AS composed FROM wordforms",
    "q_case_lines": TOKENS + f", j AS (SELECT doc_id, string_agg(trim(pre || core || post, ' '), ' ' ORDER BY g, nth) AS t FROM parts GROUP BY 1), "
    f"b AS (SELECT doc_id, lower(regexp_replace(replace(array_to_string(list_transform(regexp_extract_all(t, '{_C}+|[^{_C[1:]}+'), lambda x: CASE WHEN regexp_matches(x, '^{_C}') THEN strip_accents(x) ELSE x END), ''), 'Σ', 'σ'), '\\p{{M}}', '', 'g')) AS m FROM j) "
    # letters that become several as capitals
    "SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN md5(coalesce(m, '')) END AS minuscule, CASE WHEN text IS NOT NULL THEN coalesce(length(m) + length(regexp_replace(m, '[^ßև\uFB00\uFB01\uFB02\uFB05\uFB06ŉ\uFB03\uFB04]', '', 'g')) + length(regexp_replace(m, '[^\uFB03\uFB04]', '', 'g')), 0) END AS n_majuscule FROM documents d LEFT JOIN b USING (doc_id)",
    "q_movable": "WITH w AS (SELECT DISTINCT plain FROM slots WHERE plain <> '') SELECT plain FROM w WHERE (plain LIKE '%ν' OR plain LIKE '%s') AND left(plain, -1) IN (SELECT plain FROM w)",
    "q_nomina": f"WITH lex(key, value) AS (VALUES {_VALUES(ABBREVIATED)}) SELECT DISTINCT plain, coalesce(value, plain) AS full FROM slots LEFT JOIN lex ON plain = key WHERE plain <> ''",
    "q_lemma_cascade": "WITH lex AS (SELECT lang, form, array_to_string(list_sort(list_distinct(flatten(list(lemma)))), ',') AS found FROM lemmata GROUP BY 1, 2) SELECT form_id, coalesce(a.found, c.found, b.found, '*' || plain) AS lemma FROM wordforms w LEFT JOIN lex a ON w.lang = a.lang AND lower(w.orig) = a.form LEFT JOIN lex b ON w.lang = b.lang AND w.plain = b.form LEFT JOIN lex c ON w.lang = c.lang AND c.form = lower(regexp_replace(replace(strip_accents(w.orig), 'Σ', 'σ'), '[^\\p{L}]', '', 'g'))",
    "q_lemma_coverage": ONCE + " SELECT doc_id, count(*) FILTER (WHERE v.l NOT LIKE '*%') AS known, count(*) AS told, round(100.0::DOUBLE * count(*) FILTER (WHERE v.l NOT LIKE '*%') / count(*), 2)::VARCHAR || '%' AS coverage FROM once WHERE v.l <> '' GROUP BY doc_id",
    "q_lexicon_build": f"WITH l AS (SELECT form, lemma FROM lemmata UNION ALL SELECT orig, [plain] FROM wordforms WHERE plain IS NOT NULL), k AS (SELECT unnest(list_distinct([form, {sql_plain('form')}])) AS form, lemma FROM l), e AS (SELECT form, unnest(lemma) AS lemma FROM k WHERE form <> '') SELECT form, string_agg(DISTINCT lemma, ',' ORDER BY lemma) AS lemmata FROM e GROUP BY form",
    "q_lexicon_derived": "WITH base AS (SELECT DISTINCT form, array_to_string(list_sort(lemma), ',') AS lemma FROM lemmata) SELECT * FROM base UNION ALL SELECT DISTINCT plain, '*' || plain FROM wordforms WHERE plain <> '' AND plain NOT IN (SELECT form FROM base)",
    "q_ascii_texts": "SELECT lang, count(*) AS docs, count(*) FILTER (WHERE regexp_full_match(text, '[\\x00-\\x7F]*')) AS ascii_docs, count(*) FILTER (WHERE regexp_matches(text, '[-<]\\z')) AS open_docs FROM documents WHERE text IS NOT NULL GROUP BY lang",
    "q_joined_lines": "WITH j AS (SELECT doc_id, regexp_replace(regexp_replace(text, '-[ \\t]*\\r?\\n\\s*', '-', 'g'), '\\r?\\n', ' ', 'g') AS t FROM documents) SELECT doc_id, md5(t) AS joined, length(t) AS n FROM j",
    "q_letters": "WITH g AS (SELECT form_id, plain, regexp_replace(translate(lower(plain), 'ϲ', 'σ'), 'σ\\z', 'ς') AS r FROM wordforms), h AS (SELECT *, regexp_replace(r, '(\\x{304}|\\x{af})\\z', 'ν') AS q, translate(plain, 'αβγδεζηθικλμνξοπρσςτυφχψω', 'abgdezhqiklmncoprsstufxyw') AS latin FROM g) SELECT form_id, CASE WHEN q IN ('ουχ', 'ουκ') THEN 'ου' WHEN q = 'εξ' THEN 'εκ' ELSE q END AS repaired, latin, regexp_replace(regexp_replace(translate(lower(latin), 'abgdezhqiklmncoprstufxyw', 'αβγδεζηθικλμνξοπρστυφχψω'), 'σ([^\\p{L}])', 'ς\\1', 'g'), 'σ\\z', 'ς') AS greek FROM h",
}
