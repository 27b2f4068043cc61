"""Text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import paragraphs
from docloom.functions import text as T
from docloom.plans.derived import Patterns
from docloom.plans.registry import query
from docloom.session import table


@query("SELECT doc_id, md5(lower(translate(text, 'İI', 'iı'))) AS digest FROM documents")
def tr_lower_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turkish lower case of every text, as a digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.tr_lower(F.col("text"))).alias("digest"))


@query("""SELECT doc_id, md5(replace(replace(replace(translate(text, 'ĠġĢģ‟', 'İŞşş"'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(173), '')) AS digest FROM documents""")
def glyph_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired letters of every text, as a digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.repair_glyphs(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def nfc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form C of every text, as a digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normal_form(F.col("text"))).alias("digest"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, s[i] AS line, regexp_replace(s[i], '[0-9]+', '#', 'g') AS masked
FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM l)""")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every text in order, blank ones kept, and their digits masked."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("masked", T.mask_digits(F.col("line")))


_STRIPPED = "html"
for _pattern, _new in ((r"\r\n?", "chr(10)"), (r"(?i)<\s*br\b[^>]*>", "chr(10)"), (r"(?i)<\s*/\s*(p|div|tr|table|li)\s*>", "chr(10)"), ("<[^>]*>", "''"), ("<[^>]*>", "''"), ("<[^>]*>", "''")):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_pattern}', {_new}, 'g')"


@query(f"""WITH s AS (SELECT page_id, string_split({_STRIPPED}, chr(10)) AS x FROM pages),
t AS (SELECT page_id, [regexp_replace(v, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') for v in x] AS x FROM s)
SELECT page_id, array_to_string([v for v in x if v <> ''], chr(10)) AS text FROM t""")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages without tags, as trimmed lines."""
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query("""SELECT page_id, html AS decoded FROM pages""")
def entity_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages escaped and decoded again."""
    return table(spark, sf_dir, "pages").select("page_id", T.decode_entities(T.escape_html(F.col("html"))).alias("decoded"))


def _texts(spark: SparkSession, sf_dir: str, texts: Patterns, **places: Column) -> DataFrame:
    """(id, raw): a text for each part, filled with its numbers."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), texts.column(F.col("p_partkey"), **places).alias("raw"))


def _texts_sql(texts: Patterns, **places: str) -> str:
    return f"r AS (SELECT p_partkey AS id, {texts.sql('p_partkey', **places)} AS raw FROM part)"


_ENTITY_TEXTS = Patterns("a &lt;b&gt; &#{a};&#x4{b};&amp;lt;", "&#1285{a};&quot;&apos;&#{a};", "&nbsp;&#0;&#1114112;x{a}&gt", "&AMP; plain {b}", "", "&#x1F6{b}0;&amp;amp;#{a};")


@query(rf"""WITH {_texts_sql(_ENTITY_TEXTS, a="p_size + 40", b="p_size % 10")}, f AS (SELECT id, string_split_regex(raw, '{T.ENTITY}') AS gaps, regexp_extract_all(raw, '{T.ENTITY}', 1) AS refs FROM r),
c AS (SELECT id, gaps, [{{'n': lower(x), 'code': CASE WHEN lower(x[1:2]) = '#x' THEN TRY_CAST('0x' || x[3:] AS BIGINT) WHEN x[1] = '#' THEN TRY_CAST(x[2:] AS BIGINT) END}} for x in refs] AS refs FROM f)
SELECT id, gaps[1] || array_to_string([CASE refs[i].n WHEN 'amp' THEN '&' WHEN 'lt' THEN '<' WHEN 'gt' THEN '>' WHEN 'quot' THEN '"' WHEN 'apos' THEN chr(39) ELSE CASE WHEN refs[i].code BETWEEN 1 AND 1114111 THEN chr(CAST(refs[i].code AS INTEGER)) ELSE '' END END || gaps[i + 1] for i in range(1, len(refs) + 1)], '') AS decoded FROM c""")
def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to characters, decoded once."""
    rows = _texts(spark, sf_dir, _ENTITY_TEXTS, a=F.col("p_size") + 40, b=F.col("p_size") % 10)
    return rows.select("id", T.decode_entities(F.col("raw")).alias("decoded"))


_TR = "abcçdefgğhıijklmnoöprsştuüvyz"


_COUNTED = "SELECT o_orderkey AS id, CAST(1 + o_orderkey % 3999 AS INTEGER) AS n FROM orders"


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 3999).cast("int").alias("n"))


def _letters_sql(n: str, alphabet: str) -> str:
    return f"repeat(substring('{alphabet}', ({n} - 1) % 29 + 1, 1), least(10, ({n} - 1) // 29 + 1)::INTEGER)"


@query(f"WITH c AS ({_COUNTED}) SELECT id, n, {_letters_sql('n', _TR)} AS letters FROM c")
def letter_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as letters."""
    return _counted(spark, sf_dir).select("id", "n", T.letter_number(F.col("n")).alias("letters"))


_DIGITS = [("m", "", ""), ("c", "d", "m"), ("x", "l", "c"), ("i", "v", "x")]


def _roman_digit(digit: str, one: str, five: str, ten: str) -> str:
    forms = ["", one, one * 2, one * 3] + ([one + five, five, five + one, five + one * 2, five + one * 3, one + ten] if five else [])
    return f"CASE {digit} " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(forms)) + " END"


_ROMAN_SQL = " || ".join(_roman_digit(f"(n // {10 ** (3 - i)}) % 10", *d) for i, d in enumerate(_DIGITS))


@query(f"WITH c AS ({_COUNTED}) SELECT id, n, {_ROMAN_SQL} AS roman FROM c")
def roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as Roman numerals."""
    return _counted(spark, sf_dir).select("id", "n", T.roman_number(F.col("n")).alias("roman"))


_KINDS = Patterns("NUMBER_TYPE_NUMBER_DOT", "NUMBER_TYPE_CHAR_SMALL_PARANTHESE", "NUMBER_TYPE_CHAR_BIG_D_PARENTHESIS", "number_type_roman_small_tre", "NUMBER_TYPE_ROMAN_BIG_DOT", "CHAR_BIG_DOT", "CHAR_SMALL_TRE", "", "ODD")
_KIND = "(NUMBER|CHAR_SMALL|CHAR_BIG|ROMAN_SMALL|ROMAN_BIG)_(D_PARANTHESE|PARANTHESE|DOT|TRE)$"


def label_sql(n: str, kind: str) -> str:
    """A number in the style of a list; the column of numbers is named ``n``."""
    name = f"replace(upper({kind}), 'PARENTHESIS', 'PARANTHESE')"
    body = f"""CASE regexp_extract({name}, '{_KIND}', 1) WHEN 'CHAR_SMALL' THEN {_letters_sql(n, T.ALPHABET)} WHEN 'CHAR_BIG' THEN {_letters_sql(n, T.ALPHABET_UPPER)}
  WHEN 'ROMAN_SMALL' THEN {_ROMAN_SQL} WHEN 'ROMAN_BIG' THEN upper({_ROMAN_SQL}) ELSE CAST({n} AS VARCHAR) END"""
    ends = " ".join(f"WHEN '{e}' THEN '{x}' || {body} || '{y}'" for e, (x, y) in T.NUMBER_ENDS.items())
    return f"CASE regexp_extract({name}, '{_KIND}', 2) {ends} ELSE {body} || '.' END"


@query(f"WITH c AS ({_COUNTED}), k AS (SELECT *, {_KINDS.sql('id // 2')} AS kind FROM c) SELECT id, n, {label_sql('n', 'kind')} AS label FROM k")
def list_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the styles of lists."""
    kind = F.nullif(_KINDS.column(F.floor(F.col("id") / 2)), F.lit(""))
    return _counted(spark, sf_dir).select("id", "n", T.list_number(F.col("n"), kind).alias("label"))


_BULLET_NAMES = Patterns(*[f"BULLET_TYPE_{name}" for name in T.BULLETS], "other {a}", "bullet_type_arrow")


@query(f"""WITH {_texts_sql(_BULLET_NAMES, a="p_size")} SELECT id, CASE regexp_extract(upper(raw), 'BULLET_TYPE_([A-Z_0-9]+)$', 1) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.BULLETS.items())} ELSE '•' END AS sign FROM r""")
def bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signs of bullets."""
    return _texts(spark, sf_dir, _BULLET_NAMES, a=F.col("p_size")).select("id", T.bullet(F.col("raw")).alias("sign"))


@query("""WITH s AS (SELECT doc_id, n_chars * n_chars AS bytes FROM documents)
SELECT doc_id, bytes, translate(CASE WHEN bytes < 1024 THEN format('{:,}', bytes) || ' B'
  WHEN bytes < 1048576 THEN format('{:,}', CAST(round_even(bytes / 1024.0::DOUBLE, 0) AS BIGINT)) || ' KB'
  WHEN bytes < 1073741824 THEN format('{:,.2f}', bytes / 1048576.0::DOUBLE) || ' MB' ELSE format('{:,.2f}', bytes / 1073741824.0::DOUBLE) || ' GB' END, ',.', '.,') AS size FROM s""")
def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in words."""
    size = F.col("n_chars") * F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("bytes"), T.size_text(size).alias("size"))


@query("""WITH n AS (SELECT doc_id, CAST(doc_id * 7919 - 2147483648 AS BIGINT) AS colour FROM documents), u AS (SELECT *, (colour + 4294967296) % 4294967296 AS v FROM n)
SELECT doc_id, colour, CAST((v >> 16) & 255 AS INTEGER) AS r, CAST((v >> 8) & 255 AS INTEGER) AS g, CAST(v & 255 AS INTEGER) AS b, CAST((v >> 24) & 255 AS INTEGER) AS a FROM u""")
def argb_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed 32-bit colours taken apart."""
    colour = F.col("doc_id") * 7919 - 2147483648
    return table(spark, sf_dir, "documents").select("doc_id", colour.alias("colour"), T.rgba(colour).alias("c")).select("doc_id", "colour", "c.*")


_COLOUR_TEXTS = Patterns("#{a}", " #{b} ", "rgb({c}, {d},16)", "rgb(300,{c},2)", "red", " Green", "mauve{a}", "#12{a}", "rgb({c},1)")
_RGB = r"^rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)$"


@query(rf"""WITH {_texts_sql(_COLOUR_TEXTS, a="printf('%03X', p_partkey * 7 % 4096)", b="printf('%06x', p_partkey * 7919 % 16777216)", c="p_size * 6", d="p_partkey % 256")}, v AS (SELECT id, lower(trim(raw)) AS v FROM r)
SELECT id, CASE v {" ".join(f"WHEN '{k}' THEN '{c}'" for k, c in T.COLOUR_NAMES.items())} ELSE CASE WHEN regexp_full_match(v, '#[0-9a-f]{{6}}') THEN v WHEN regexp_full_match(v, '#[0-9a-f]{{3}}') THEN '#' || repeat(v[2], 2) || repeat(v[3], 2) || repeat(v[4], 2)
  WHEN regexp_matches(v, '{_RGB}') THEN '#' || {" || ".join(f"printf('%02x', least(255, CAST(regexp_extract(v, '{_RGB}', {i}) AS INTEGER)))" for i in (1, 2, 3))} END END AS colour FROM v""")
def css_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours as they are written in styles."""
    key = F.col("p_partkey")
    rows = _texts(spark, sf_dir, _COLOUR_TEXTS, a=F.lpad(F.hex(key * 7 % 4096), 3, "0"), b=F.lower(F.lpad(F.hex(key * 7919 % 16777216), 6, "0")), c=F.col("p_size") * 6, d=key % 256)
    return rows.select("id", T.css_colour(F.col("raw")).alias("colour"))


_MEASURE_TEXTS = Patterns("{a}mm", "{a}.5cm", "-{a}in", "{a}px", " {a} PT ", "{a}", "x{a}", "{a}.25", "{a}em")
_MEASURE = r"(?i)^\s*(-?\d+(?:\.\d+)?)\s*(mm|cm|in|px|pt)?\s*$"


@query(rf"""WITH {_texts_sql(_MEASURE_TEXTS, a="p_size")}
SELECT id, round(TRY_CAST(regexp_extract(raw, '{_MEASURE}', 1) AS DOUBLE) * CASE lower(regexp_extract(raw, '{_MEASURE}', 2)) {" ".join(f"WHEN '{u}' THEN {f!r}::DOUBLE" for u, f in T.UNITS.items())} ELSE 1 END, 3) AS pt FROM r""")
def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in points."""
    return _texts(spark, sf_dir, _MEASURE_TEXTS, a=F.col("p_size")).select("id", T.points(F.col("raw")).alias("pt"))


@query("""SELECT page_id, CASE WHEN length(e) > 0 THEN e END AS extension, coalesce(lower(regexp_extract(url, '^\\s*([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https', 'mailto'), false) AS allowed
FROM (SELECT page_id, url, lower(regexp_extract(regexp_extract(url, '([^/\\\\]*)$', 1), '\\.([!-\\-0-\\[\\]-~]{1,8})$', 1)) AS e FROM pages)""")
def extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File extensions of addresses, and whether they may be opened."""
    return table(spark, sf_dir, "pages").select("page_id", T.extension(F.col("url")).alias("extension"), T.external_address(F.col("url")).alias("allowed"))


@query("""WITH e AS (SELECT source, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'docx' WHEN doc_id % 7 = 1 AND source = 'src1' THEN 'exe' ELSE 'pdf' END AS ext FROM documents)
SELECT source, count(*) AS n, count(*) BETWEEN 2 AND 1000 AND bool_and(ext IN ('pdf', 'docx')) AS visible FROM e GROUP BY source""")
def visibility_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command is offered for 2 to 1000 items whose kinds are all known."""
    ext = F.when(F.col("doc_id") % 7 == 0, "docx").when((F.col("doc_id") % 7 == 1) & (F.col("source") == "src1"), "exe").otherwise("pdf")
    items = table(spark, sf_dir, "documents").select("source", ext.alias("ext"))
    return items.groupBy("source").agg(F.count("*").alias("n"), (F.count("*").between(2, 1000) & F.bool_and(F.col("ext").isin("pdf", "docx"))).alias("visible"))


@query(r"""SELECT doc_id, regexp_replace(trim(regexp_replace(source || ': <' || lang || '>..', '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '\.+$', '') AS name FROM documents""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names without forbidden characters."""
    raw = F.concat("source", F.lit(": <"), "lang", F.lit(">.."))
    return table(spark, sf_dir, "documents").select("doc_id", T.safe_name(raw).alias("name"))


_TOKEN_TEXTS = Patterns("0{a}.ıo.2o{b}", "l99{a}'lı", "2o9{b}/l23", "{a}li", "Oolong {a}", "{a}|-2", "", "o{a}-IIo", "il|/{b}.l", "O/O-{a}")


@query(rf"""WITH {_texts_sql(_TOKEN_TEXTS, a="p_size % 10", b="p_size")}, u AS (SELECT id, raw, generate_subscripts(string_split(raw, ''), 1) AS i, unnest(string_split(raw, '')) AS ch FROM r WHERE raw <> ''),
f AS (SELECT *, contains('oOılIi|', ch) AS odd FROM u), g AS (SELECT *, i - row_number() OVER (PARTITION BY id, odd ORDER BY i) AS run FROM f),
w AS (SELECT *, min(i) OVER (PARTITION BY id, odd, run) AS a, max(i) OVER (PARTITION BY id, odd, run) AS z FROM g),
x AS (SELECT id, raw, string_agg(CASE WHEN odd AND (a = 1 OR regexp_matches(raw[a - 1], '[0-9./-]')) AND regexp_matches(raw[z + 1], '[0-9./-]') THEN translate(ch, 'oOılIi|', '0011111') ELSE ch END, '' ORDER BY i) AS fixed FROM w GROUP BY id, raw)
SELECT r.id, CASE WHEN length(regexp_replace(r.raw, '[^0-9]', '', 'g')) >= 2 THEN fixed ELSE r.raw END AS fixed FROM r LEFT JOIN x USING (id)""")
def ocr_digit_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters read for digits."""
    return _texts(spark, sf_dir, _TOKEN_TEXTS, a=F.col("p_size") % 10, b=F.col("p_size")).select("id", T.fix_digits(F.col("raw")).alias("fixed"))


_PLAUSIBLE = T.PLAUSIBLE.replace("'", "''")
_ENDS = T.PLAUSIBLE_ENDS.replace("'", "''")


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+')) AS w FROM documents),
c AS (SELECT doc_id, regexp_replace(w, '{_ENDS}', '', 'g') AS c FROM w WHERE w <> '')
SELECT doc_id, count(*) AS total, count(*) FILTER (length(c) >= 2 AND regexp_matches(c, '{_PLAUSIBLE}')) AS good,
  2 * count(*) FILTER (length(c) >= 2 AND regexp_matches(c, '{_PLAUSIBLE}')) - count(*) AS net FROM c GROUP BY doc_id""")
def plausible_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plausible and all words of every text, and the net score of a reading."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[ \t\n\r\f\x0B]+")).alias("w")).where("w <> ''")
    good = F.count(F.when(T.plausible_word(F.col("w")), 1))
    return words.groupBy("doc_id").agg(F.count("*").alias("total"), good.alias("good"), (2 * good - F.count("*")).alias("net"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '([\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*)', 1)) AS INTEGER) AS words FROM documents""")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text (an approximation of word segmentation)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).alias("words"))


_PDF_TEXTS = Patterns("Not ({a})", "back\\slash {a}", "Çağ {a} ş", "", "{a}")


@query(rf"""WITH {_texts_sql(_PDF_TEXTS, a="p_size")}
SELECT id, CASE WHEN regexp_full_match(raw, '[ -~]*') THEN '(' || replace(replace(replace(raw, '\', '\\'), '(', '\('), ')', '\)') || ')' ELSE '<FEFF' || array_to_string([printf('%04X', unicode(x)) for x in string_split(raw, '')], '') || '>' END AS pdf FROM r""")
def pdf_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as strings of a document."""
    return _texts(spark, sf_dir, _PDF_TEXTS, a=F.col("p_size")).select("id", T.pdf_string(F.col("raw")).alias("pdf"))


_APPEARANCES = Patterns("/Helv {a} Tf 0 g", "1 0 0.{b} rg /F1 {a}.5 Tf", "0.{b} g /Cour 0 Tf", "q {a}", "/Ti 8 Tf .{b} 2 -1 rg", "/X Tf {a} g")
_NUMBER = r"(-?\d*\.?\d+)"
_RG = rf"{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s+rg"
_GRAY = rf"(?:^|\s){_NUMBER}\s+g(?:\s|$)"


def _two_sql(value: str) -> str:
    return f"printf('%02x', CAST(round_even(least(1.0, greatest(0.0, TRY_CAST({value} AS DOUBLE))) * 255, 0) AS INTEGER))"


@query(rf"""WITH {_texts_sql(_APPEARANCES, a="p_size", b="p_partkey % 100")}
SELECT id, nullif(regexp_extract(raw, '/([^\s/]+)\s+{_NUMBER}\s+Tf', 1), '') AS font, TRY_CAST(regexp_extract(raw, '/[^\s/]+\s+{_NUMBER}\s+Tf', 1) AS DOUBLE) AS size,
  CASE WHEN regexp_matches(raw, '{_RG}') THEN '#' || {" || ".join(_two_sql(f"regexp_extract(raw, '{_RG}', {i})") for i in (1, 2, 3))} WHEN regexp_matches(raw, '{_GRAY}') THEN '#' || repeat({_two_sql(f"regexp_extract(raw, '{_GRAY}', 1)")}, 3) END AS colour FROM r""")
def appearance_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font, size and colour of fields."""
    rows = _texts(spark, sf_dir, _APPEARANCES, a=F.col("p_size"), b=F.col("p_partkey") % 100)
    return rows.select("id", T.appearance(F.col("raw")).alias("a")).select("id", "a.*")


_STYLE_TEXTS = Patterns("color: red; font: a:{a}", "A:{a};a:{b}", "x{a}", "margin : {a}pt ;; b", "b:1; B : {b};c:{a}")


@query(rf"""WITH {_texts_sql(_STYLE_TEXTS, a="p_size", b="p_partkey % 9")}, d AS (SELECT id, unnest(string_split(raw, ';')) AS d, generate_subscripts(string_split(raw, ';'), 1) AS i FROM r),
p AS (SELECT id, i, lower(trim(split_part(d, ':', 1))) AS name, trim(substr(d, instr(d, ':') + 1)) AS value FROM d WHERE contains(d, ':'))
SELECT id, name, arg_max(value, i) AS value FROM p GROUP BY id, name""")
def css_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style attributes as name and value."""
    rows = _texts(spark, sf_dir, _STYLE_TEXTS, a=F.col("p_size"), b=F.col("p_partkey") % 9)
    return rows.select("id", F.explode(T.css_style(F.col("raw"))).alias("name", "value"))


_DESTINATIONS = Patterns("[{a} 0 R /XYZ {b} {b}.5 0]", "[{a} 0 R/FitH {b}]", " [{a} 0 R /Fit]", "name{a}", "[{a} 1 R /XYZ null -{b} .{b}]")
_TARGET = r"^\s*\[\s*(\d+)\s+\d+\s+R\s*/(\w+)\s*([^\]]*)\]"


@query(rf"""WITH {_texts_sql(_DESTINATIONS, a="p_size", b="p_partkey % 90 + 10")}, m AS (SELECT *, regexp_matches(raw, '{_TARGET}') AS m FROM r)
SELECT id, CASE WHEN m THEN CAST(regexp_extract(raw, '{_TARGET}', 1) AS INTEGER) END AS ref, CASE WHEN m THEN regexp_extract(raw, '{_TARGET}', 2) END AS kind,
  CASE WHEN m THEN array_to_string([CAST(TRY_CAST(x AS DOUBLE) AS VARCHAR) for x in regexp_extract_all(regexp_extract(raw, '{_TARGET}', 3), '(-?\d*\.?\d+|null)', 1) if x <> 'null'], ',') END AS params FROM m""")
def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit destinations of links."""
    d = _texts(spark, sf_dir, _DESTINATIONS, a=F.col("p_size"), b=F.col("p_partkey") % 90 + 10).select("id", T.destination(F.col("raw")).alias("d"))
    return d.select("id", "d.ref", "d.kind", F.array_join(F.transform("d.params", lambda x: x.cast("string")), ",").alias("params"))


_STOPS = Patterns("{a}:1:2,{b}.5:9,abc:1:1,0:1:1", "{a}", ",,{b}:4:5,5000:1:1,{a}:5:x", "", "-{a}:1,{b}:2:6,{b}:3:3")


@query(rf"""WITH {_texts_sql(_STOPS, a="p_size * 4", b="p_partkey % 300")}, x AS (SELECT id, unnest(string_split(raw, ',')) AS x FROM r), f AS (SELECT id, string_split(x, ':') AS f FROM x),
p AS (SELECT id, TRY_CAST(f[1] AS DOUBLE) AS position, TRY_CAST(f[2] AS INTEGER) AS a, TRY_CAST(f[3] AS INTEGER) AS l FROM f)
SELECT id, position, CASE WHEN a IN (0, 1, 2, 4, 5) THEN a ELSE 0 END AS alignment, CASE WHEN l BETWEEN 0 AND 5 THEN l ELSE 0 END AS leader FROM p WHERE position > 0 AND position <= 4000""")
def tab_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab stops of paragraphs."""
    return _texts(spark, sf_dir, _STOPS, a=F.col("p_size") * 4, b=F.col("p_partkey") % 300).select("id", F.inline(T.tab_stops(F.col("raw"))))


_SCRIPTS = Patterns("a({a}); // x\n/* y; */ b();c({b})", "if (xfa.host.version >= {a}) d();\n e({b}) ;", "", "/* {a}\n; */f()//g;\nh = {b}")


@query(rf"""WITH {_texts_sql(_SCRIPTS, a="p_size", b="p_partkey % 7")},
b AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(raw, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g'), '(?i)if\s*\(\s*xfa\.host\.version[^)]*\)', '', 'g') AS t FROM r),
l AS (SELECT id, trim(unnest(string_split_regex(t, '[;\n]'))) AS line FROM b) SELECT id, line FROM l WHERE line <> ''""")
def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of scripts."""
    return _texts(spark, sf_dir, _SCRIPTS, a=F.col("p_size"), b=F.col("p_partkey") % 7).select("id", F.explode(T.script_lines(F.col("raw"))).alias("line"))


_NUMBER_LINES = Patterns("Sayfa {a} / {b}", "- {a} -", " {a}", "{a} of {b}", "no number", "12345{a}", "p.{a}", "{a}/{b} Rapor")


@query(rf"""WITH {_texts_sql(_NUMBER_LINES, a="p_size", b="p_size + p_partkey % 9")}, t AS (SELECT id, trim(raw) AS t FROM r), m AS (SELECT *, regexp_matches(t, '{T.PAGE_NUMBER}') AS m FROM t)
SELECT id, CASE WHEN m THEN regexp_extract(t, '{T.PAGE_NUMBER}', 1) END AS before, CASE WHEN m THEN CAST(regexp_extract(t, '{T.PAGE_NUMBER}', 2) AS INTEGER) END AS number, CASE WHEN m THEN nullif(trim(regexp_extract(t, '{T.PAGE_NUMBER}', 3)), '') END AS separator,
  CASE WHEN m THEN TRY_CAST(regexp_extract(t, '{T.PAGE_NUMBER}', 4) AS INTEGER) END AS total, CASE WHEN m THEN regexp_extract(t, '{T.PAGE_NUMBER}', 5) END AS after FROM m""")
def page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are page numbers, taken apart."""
    rows = _texts(spark, sf_dir, _NUMBER_LINES, a=F.col("p_size"), b=F.col("p_size") + F.col("p_partkey") % 9)
    return rows.select("id", T.page_number_parts(F.col("raw")).alias("p")).select("id", "p.*")


_HEADS = paragraphs.HEADING
_SUFFIX = f"^[''’][{paragraphs.LOWER}]"
_SPACE = r"[\s\x0b\x85\p{Z}]+"
_SOFT = "regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), chr(173) || '[ \\t]*\\n[ \\t]*(\\S)', '\\1', 'g')"
_REPAIRED = f"replace(replace(replace(translate({_SOFT}, 'ĠġĢģ‟', 'İŞşş\"'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(173), '')"
_PREPARED = f"translate(replace(regexp_replace({_REPAIRED}, '[\\x{{E000}}-\\x{{F8FF}}]', '', 'g'), chr(9), '    '), chr(160), ' ')"


@query(rf"""WITH p AS (SELECT doc_id, string_split({_PREPARED}, chr(10)) AS s FROM documents), u AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS raw FROM p),
l AS (SELECT doc_id, i, raw = '' AS nothing, regexp_matches(raw, '^ {{2,}}\S') AS inside, regexp_replace(regexp_replace(raw, ' {{2,}}', ' ', 'g'), '^{_SPACE}|{_SPACE}$', '', 'g') AS x FROM u),
w AS (SELECT *, coalesce(lead(x) OVER d, '') AS after, coalesce(lead(inside) OVER d, false) AS after_inside, greatest(1, max(length(x)) OVER (PARTITION BY doc_id)) AS most, sum(CASE WHEN nothing THEN 1 ELSE 0 END) OVER d AS blanks FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, length(x) < most * {paragraphs.SHORT} AS short, regexp_matches(x, '{paragraphs.SENTENCE_END.replace("'", "''")}') AS closed, regexp_matches(after, '^{_HEADS}') OR (length(regexp_extract(after, '^[{paragraphs.UPPER}]+')) >= 3
  AND NOT regexp_matches(substr(after, length(regexp_extract(after, '^[{paragraphs.UPPER}]+')) + 1), '{_SUFFIX}')) AS opens FROM w WHERE x <> ''),
e AS (SELECT *, after = '' OR after_inside OR (closed AND (short OR opens)) OR (NOT closed AND short AND regexp_matches(x, '^{_HEADS}') AND NOT regexp_matches(after, '^[{paragraphs.LOWER}]')) AS ends FROM f),
g AS (SELECT *, lag(i) OVER d = i - 1 AND NOT inside AND NOT lag(ends) OVER d AS goes_on, regexp_matches(lag(x) OVER d, '{paragraphs.CUT_WORD}') AND regexp_matches(x, '^[{paragraphs.LOWER}{paragraphs.HATS}]') AS cut, regexp_matches(lag(x) OVER d, '[0-9]-$') AND regexp_matches(x, '^[0-9]') AS number,
  blanks - lag(blanks) OVER d AS gap, lag(i) OVER d IS NULL AS first FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT *, coalesce(lead(goes_on) OVER d AND lead(cut) OVER d, false) AS shorten FROM g WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, string_agg(CASE WHEN first THEN '' WHEN goes_on THEN CASE WHEN cut OR number THEN '' ELSE ' ' END WHEN gap >= 2 THEN chr(10) || chr(10) ELSE chr(10) END || CASE WHEN shorten THEN regexp_replace(x, '-$', '') ELSE x END, '' ORDER BY i) AS t FROM h GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN regexp_replace(regexp_replace(coalesce(t, ''), ' {{2,}}', ' ', 'g'), ' ([,.;:!?])', '\1', 'g') END AS text FROM documents LEFT JOIN t USING (doc_id)""")
def clean_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean paragraphs of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", paragraphs.clean_paragraphs(F.col("text")).alias("text"))
