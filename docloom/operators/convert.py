"""File kinds by content, conversion plans, free names and archive guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order of targets, names of kinds, limits of archives, header sizes and brands of images.
TARGETS = ("pdf", "udf", "word", "tiff", "gorsel")
MOST_ENTRIES, MOST_BYTES, MOST_RATIO, LARGE_ENTRY = 10_000, 300 * 1024 * 1024, 200, 1024 * 1024
BMP_HEADERS = (12, 16, 40, 52, 56, 64, 108, 124)
AVIF_BRANDS = ("avif", "avis")
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1")


def _is(content: Column, at: int, magic: str) -> Column:
    """Whether bytes from ``at`` (from 0) are those of ``magic``, in hex."""
    return F.hex(F.substring(content, at + 1, len(magic) // 2)) == magic


def image_kind(content: Column) -> Column:
    """jpeg, png, gif, bmp, webp, avif or heif by the first bytes, or null."""
    little = lambda at: F.conv(F.concat(*[F.hex(F.substring(content, at + i, 1)) for i in (4, 3, 2, 1)]), 16, 10).cast("long")
    length = F.conv(F.hex(F.substring(content, 1, 4)), 16, 10).cast("long")
    end = F.greatest(F.lit(16), F.least(length, F.octet_length(content).cast("long")))
    rest = F.transform(F.sequence(F.lit(16), F.least(end - 4, F.lit(8188)), F.lit(4)), lambda i: F.hex(F.substring(content, i.cast("int") + 1, F.lit(4))))
    brands = F.concat(F.array(F.hex(F.substring(content, 9, 4))), F.when(end >= 20, rest).otherwise(F.array().cast("array<string>")))
    any_of = lambda names: F.arrays_overlap(brands, F.array(*[F.lit(n.encode().hex().upper()) for n in names]))
    boxed = _is(content, 4, b"ftyp".hex().upper()) & (F.octet_length(content) >= 16)
    return (
        F.when(_is(content, 0, "FFD8FF"), "jpeg")
        .when(_is(content, 0, "89504E470D0A1A0A"), "png")
        .when(F.hex(F.substring(content, 1, 6)).isin(b"GIF87a".hex().upper(), b"GIF89a".hex().upper()), "gif")
        .when(_is(content, 0, "424D") & (F.octet_length(content) >= 18) & little(14).isin(*BMP_HEADERS), "bmp")
        .when(_is(content, 0, b"RIFF".hex().upper()) & _is(content, 8, b"WEBP".hex().upper()), "webp")
        .when(boxed & any_of(AVIF_BRANDS), "avif")
        .when(boxed & any_of(HEIF_BRANDS), "heif")
    )


def _utf16(content: Column) -> Column:
    """The text of UTF-16 bytes with a mark; characters of two units and those cut off come out as signs of replacement, and nothing is an error."""
    units = F.regexp_extract_all(F.hex(content), F.lit("...."), F.lit(0))
    ordered = F.when(_is(content, 0, "FFFE"), F.transform(units, lambda u: F.concat(F.substring(u, 3, 2), F.substring(u, 1, 2)))).otherwise(units)
    whole = F.transform(ordered, lambda u: F.when(u.between("D800", "DFFF"), "FFFD").otherwise(u))
    return F.decode(F.unhex(F.array_join(F.slice(whole, F.lit(2), F.greatest(F.size(whole) - 1, F.lit(0))), "")), "UTF-16BE")


def file_kind(content: Column) -> Column:
    """Struct (kind, sub) of a file by its content, whatever its name. Archives come out as ``zip``, to be opened by ``zip_kind``."""
    head = F.substring(content, 1, 8192)
    image = image_kind(head)
    text = F.when(_is(head, 0, "EFBBBF"), F.make_valid_utf8(F.substring(head, 4, 8189).cast("string"))).when(_is(head, 0, "FFFE") | _is(head, 0, "FEFF"), _utf16(head)).otherwise(F.decode(head, "ISO-8859-1"))
    start = F.regexp_replace(text, r"^\s+", "")
    kind = lambda k, s: F.struct(F.lit(k).alias("kind"), (s if isinstance(s, Column) else F.lit(s).cast("string")).alias("sub"))
    pdf = F.contains(F.hex(F.substring(head, 1, 1024)), F.lit(b"%PDF-".hex().upper()))
    return (
        F.when(_is(head, 0, "49492A00") | _is(head, 0, "4D4D002A"), kind("tiff", "tiff"))
        .when(_is(head, 0, "49492B00") | _is(head, 0, "4D4D002B"), kind("tiff", "bigtiff"))
        .when(image.isNotNull(), kind("gorsel", image))
        .when(pdf, kind("pdf", None))
        .when(_is(head, 0, "504B0304") | _is(head, 0, "504B0506"), kind("bilinmeyen", "zip"))
        .when(_is(head, 0, "D0CF11E0A1B11AE1"), kind("bilinmeyen", "ole2"))
        .when(start.startswith("{\\rtf"), kind("word", "rtf"))
        .when(start.startswith("<") & F.contains(start, F.lit("<template")), kind("udf", "xml"))
        .otherwise(kind("bilinmeyen", None))
    )


def zip_kind(entries: DataFrame) -> DataFrame:
    """(path, kind, sub) of archives by their entries (path, name, head: the entry's first characters)."""
    has = lambda name: F.bool_or(F.col("name") == name)
    head = lambda name: F.max(F.when(F.col("name") == name, F.col("head")))
    facts = entries.groupBy("path").agg(head("mimetype").alias("mimetype"), has("word/document.xml").alias("word"), has("word/vbaProject.bin").alias("macro"), head("[Content_Types].xml").alias("types"), head("content.xml").alias("content"))
    odf = F.col("mimetype").startswith("application/vnd.oasis.opendocument.text")
    macro = F.when(F.contains("types", F.lit("macroEnabled")), True).when(F.contains("types", F.lit("document.main+xml")), False).otherwise(F.col("macro"))
    kind = lambda k, s: F.struct(F.lit(k).alias("kind"), F.lit(s).alias("sub"))
    found = F.when(odf, kind("word", "odt")).when(F.col("word") & macro, kind("word", "docm")).when(F.col("word"), kind("word", "docx")).when(F.contains("content", F.lit("<template")), kind("udf", "zip")).otherwise(kind("bilinmeyen", "zip"))
    return facts.select("path", found.alias("k")).select("path", "k.*")


def unsafe_archives(entries: DataFrame) -> DataFrame:
    """(path, reason): archives (path, size, compressed) that may not be opened: too_many, too_large or bomb."""
    bomb = (F.col("size") > LARGE_ENTRY) & (F.col("size") > MOST_RATIO * F.greatest("compressed", F.lit(1)))
    facts = entries.groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.bool_or(bomb).alias("bomb"))
    reason = F.when(F.col("n") > MOST_ENTRIES, "too_many").when(F.col("bomb"), "bomb").when(F.col("total") > MOST_BYTES, "too_large")
    return facts.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def plans(kinds: DataFrame, converters: DataFrame) -> DataFrame:
    """(src, dst, hops, ready, place): how each kind reaches each target, directly or through pdf; targets in their usual order.

    ``converters``: src, dst, ready. Known kinds that aren't pdf may take two steps to another target than pdf.
    """
    direct = converters.select("src", "dst", F.lit(1).alias("hops"), "ready")
    to_pdf = converters.where("dst = 'pdf'").select("src", F.col("ready").alias("ready_1"))
    onward = converters.where("src = 'pdf'").select("dst", F.col("ready").alias("ready_2"), F.lit("pdf").alias("via"))
    two = to_pdf.where("src NOT IN ('pdf', 'bilinmeyen')").withColumn("via", F.lit("pdf")).join(onward, "via")
    two = two.where("src <> dst").select("src", "dst", F.lit(2).alias("hops"), (F.col("ready_1") & F.col("ready_2")).alias("ready"))
    best = direct.unionByName(two).groupBy("src", "dst").agg(F.min(F.struct("hops", "ready")).alias("p"))
    place = F.array_position(F.array(*[F.lit(t) for t in TARGETS]), F.col("dst")).cast("int")
    return best.join(kinds.select(F.col("kind").alias("src")), "src").select("src", "dst", "p.hops", "p.ready", place.alias("place"))


def engine_order(engines: DataFrame, *ties: str) -> DataFrame:
    """``engines`` (kind, name, healthy, priority) with ``turn``: healthy ones first, then by priority; WPS doesn't read odt."""
    able = engines.where(~((F.col("kind") == "odt") & (F.col("name") == "wps")))
    return able.withColumn("turn", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("healthy"), "priority", *(ties or ("name",)))))


def free_names(wanted: DataFrame, taken: DataFrame, first: int = 2) -> DataFrame:
    """(folder, name, free): the name, or the name with the smallest free number from ``first``.

    The numbers that a name has, in order, count on from ``first`` without a gap as far as number less rank stays the same, so
    as many as do are taken, however many there are.
    """
    pattern = r"^(.*) \((0|[1-9]\d{0,17})\)$"
    numbered = taken.select("folder", F.regexp_extract("name", pattern, 1).alias("name"), F.regexp_extract("name", pattern, 2).try_cast("long").alias("k")).where(F.col("k") >= first).distinct()
    rank = F.row_number().over(Window.partitionBy("folder", "name").orderBy("k"))
    used = numbered.where(F.col("k") >= first).withColumn("gapless", F.col("k") - rank == first - 1).where("gapless").groupBy("folder", "name").agg(F.count("*").alias("used"))
    names = wanted.select("folder", "name").distinct()
    rows = names.join(taken.select("folder", "name").distinct().withColumn("there", F.lit(True)), ["folder", "name"], "left").join(used, ["folder", "name"], "left")
    number = (F.coalesce("used", F.lit(0)) + first).cast("string")
    return rows.select("folder", "name", F.when(F.col("there"), F.concat("name", F.lit(" ("), number, F.lit(")"))).otherwise(F.col("name")).alias("free"))


def next_names(base: Column, n: int) -> Column:
    """The names to try in turn: a number of one to three digits in brackets at the end counts on, any other name starts at 1."""
    number = F.regexp_extract(base, r" \((\d{1,3})\)$", 1).try_cast("int")
    root = F.when(number.isNotNull(), F.regexp_replace(base, r" \(\d{1,3}\)$", "")).otherwise(base)
    start = F.coalesce(number, F.lit(0)) + 1
    return F.transform(F.sequence(start, start + n - 1), lambda i: F.concat(root, F.lit(" ("), i.cast("string"), F.lit(")")))


def leftover_pages(files: DataFrame, written: DataFrame) -> DataFrame:
    """(base, k): numbered page files that follow on the ``n`` written ones, up to the first gap.

    ``files``: base, k (the page number in the name); ``written``: base, n.
    """
    later = files.join(written, "base").where((F.col("n") > 1) & (F.col("k") > F.col("n")))
    place = F.row_number().over(Window.partitionBy("base").orderBy("k"))
    return later.withColumn("place", place).where(F.col("k") == F.col("n") + F.col("place")).select("base", "k")


def warnings_summary(results: DataFrame) -> DataFrame:
    """(warning, n, name): each warning with the number of files, and the file's name if it is one."""
    rows = results.select("path", F.explode("warnings").alias("warning")).distinct()
    return rows.groupBy("warning").agg(F.count("*").alias("n"), F.when(F.count("*") == 1, F.first("path")).alias("name"))


def ole2_kind(content: Column) -> Column:
    """Struct (kind, sub) of an old office file by the names of its streams, wherever they stand; null if it has neither."""
    hexed = F.hex(content)
    has = lambda name: F.contains(hexed, F.lit(name.encode("utf-16-le").hex().upper()))
    kind = lambda s: F.struct(F.lit("word").alias("kind"), F.lit(s).alias("sub"))
    return F.when(has("WordDocument"), kind("doc")).when(has("EncryptedPackage"), kind("sifreli"))


# Fixed value: the identifier of a signed message's digest, as a record in hex.
MESSAGE_DIGEST = "06 09 2A 86 48 86 F7 0D 01 09 04"
DIGEST_BYTES = (20, 32, 48, 64)


def message_digests(signature: Column) -> Column:
    """The digests (hex) that a signature's nested records say the signed message has, of known lengths, in order.

    The identifier is followed by a set and that by a byte string, each with its length in one byte or, after 81 or 82, in one or two.
    A string that its bytes don't fill is none. Bytes are written as pairs with a blank behind them, so that none is read across two.
    """
    pairs = F.regexp_replace(F.hex(signature), "(..)", "$1 ")
    any_length = "(?:[0-7]. |81 .. |82 .. .. )"
    strings = "|".join(f"(?:81 |82 00 )?{n:02X} (?:.. ){{{n}}}" for n in DIGEST_BYTES)
    found = F.regexp_extract_all(pairs, F.lit(f"(?<= |^){MESSAGE_DIGEST} 31 {any_length}04 ({strings})"), F.lit(1))
    return F.transform(found, lambda d: F.regexp_replace(F.regexp_replace(d, "^(?:81 |82 00 )?.. ", ""), " ", ""))


def digest_state(content: Column, digests: Column) -> Column:
    """Struct (state, algorithm): ``consistent`` if some digest (hex) is that of the content, ``inconsistent`` if digests of known length are all others', else ``unknown``."""
    known = {40: ("SHA-1", F.sha1(content)), 64: ("SHA-256", F.sha2(content, 256)), 96: ("SHA-384", F.sha2(content, 384)), 128: ("SHA-512", F.sha2(content, 512))}

    def name(d: Column) -> Column:
        out = F.lit(None).cast("string")
        for length, (algorithm, _) in known.items():
            out = F.when(F.length(d) == length, algorithm).otherwise(out)
        return out

    right = F.filter(digests, lambda d: F.lower(d).isin(*[value for _, value in known.values()]))
    sized = F.filter(digests, lambda d: name(d).isNotNull())
    state = lambda s, d: F.struct(F.lit(s).alias("state"), d.alias("algorithm"))
    return F.when(F.size(right) > 0, state("consistent", name(F.get(right, F.lit(0))))).when(F.size(sized) > 0, state("inconsistent", name(F.get(sized, F.lit(0))))).otherwise(state("unknown", F.lit(None).cast("string")))


def _number(hexed: Column, at: Column, size: int) -> Column:
    """The unsigned number, lowest byte first, in ``size`` bytes from a place of a content written in hex; null beyond its end."""
    pairs = [F.substring(hexed, (2 * at + 2 * k + 1).cast("int"), F.lit(2)) for k in reversed(range(size))]
    return F.when(2 * at + 2 * size <= F.length(hexed), F.conv(F.concat(*pairs), 16, 10).try_cast("decimal(20,0)"))


def encrypted_doc(content: Column) -> Column:
    """Whether an old office file's main stream says that it is encrypted; false where its place can't be read.

    Fixed values: places and sizes of the compound file's fields, the mark and the flag of the stream's beginning.
    """
    hexed = F.hex(content)
    entry = F.instr(hexed, "WordDocument".encode("utf-16-le").hex().upper())
    at = F.floor((entry - 1) / 2)
    sector = F.pow(F.lit(2.0), F.least(_number(hexed, F.lit(30), 2), F.lit(16))).cast("long")
    first, size = _number(hexed, at + 116, 4), _number(hexed, at + 120, 8)
    fine = (entry > 0) & sector.between(512, 4096) & (size >= 4096) & (first < 0xFFFFFFFA)
    begin = ((first + 1) * sector).cast("long")
    marked = _number(hexed, begin, 2) == 0xA5EC
    flags = _number(hexed, begin + 10, 2).cast("int")
    return F.coalesce(fine & marked & (flags.bitwiseAND(0x0100) != 0), F.lit(False))
