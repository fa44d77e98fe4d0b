"""Which layout and encoding a file has: by its bytes, its header, its name, or as told.

All of it comes from Spark's text source, so every file system that Spark can list can be
read, and a path of an unknown scheme ends the job. One aggregate over the lines gives,
for each block of a file, the classes of bytes in it and the lines that may be a header;
few rows a file are left, which stay distributed.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.session import reliable_checkpoint
from tallybook.sources.profiles import FILENAME_HINTS, ProfileRegistry, SchemaProfile

SEPARATORS = [";", ",", "\t", "|"]
MIN_MATCHES = 2
UTF8, UTF16 = "utf-8", ("utf-16-le", "utf-16-be")
# Windows code page 1252 uses the bytes that Latin-1 leaves to control characters.
WINDOWS = "cp1252"


def list_files(spark: SparkSession, *paths: str, glob: str = "*.csv") -> DataFrame:
    """Files and their sizes; the content column is not selected, so nothing is read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(list(paths))
        .select("path", "length")
    )


def raw_lines(spark: SparkSession, paths: list[str], glob: str | None = None, encoding: str = UTF8) -> DataFrame:
    """Lines as bytes with their file, split and number, blank ones included."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    if encoding in UTF16:  # line ends are two bytes there
        reader = reader.option("encoding", encoding.replace("-le", "LE").replace("-be", "BE").upper()).option("lineSep", "\n")
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"),
        "value",
    )


def _other_signs(encoding: str) -> tuple[str, str]:
    """Latin-1 signs of the upper bytes, and what they are in another one-byte encoding."""
    pairs = [(chr(b), bytes([b]).decode(encoding, "ignore")) for b in range(0x80, 0x100)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def decoded(value: Column, encoding: str) -> Column:
    """Text of a line of bytes; never fails, and bytes that an encoding lacks stay visible."""
    if encoding in UTF16:
        text = F.decode(value.cast("binary"), encoding.upper().replace("-LE", "LE").replace("-BE", "BE"))
    elif encoding == UTF8:
        text = F.when(F.is_valid_utf8(value), value).otherwise(F.make_valid_utf8(value))
    else:
        text = F.decode(value.cast("binary"), "ISO-8859-1")
        if codecs.lookup(encoding).name != "iso8859-1":
            text = F.translate(text, *_other_signs(encoding))
    return F.replace(F.replace(text, F.lit("﻿"), F.lit("")), F.lit("\r"), F.lit(""))


def separator(line: Column, known: Iterable[str] = ()) -> Column:
    """The most frequent of the usual and the known separators; a comma where there is none."""
    counts = [
        F.struct(
            (F.length(line) - F.length(F.replace(line, F.lit(s), F.lit("")))).alias("n"),
            F.lit(-i).alias("order"),
            F.lit(s).alias("sep"),
        )
        for i, s in enumerate(dict.fromkeys([*SEPARATORS, *known]))
    ]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["sep"]).otherwise(F.lit(","))


def header_cells(line: Column, sep: Column) -> Column:
    """Lower-case names of a header line, without quotes and outer blanks."""
    quoted_sep = F.concat(F.lit("\\Q"), sep, F.lit("\\E"))
    cells = F.split(line, quoted_sep, -1)
    return F.transform(cells, lambda c: F.lower(F.trim(F.translate(c, '"﻿\r', ""))))


def _present(cells: Column, profile: SchemaProfile, name: str) -> Column:
    return F.arrays_overlap(cells, F.array(*map(F.lit, profile.columns.spellings(name))))


def has_required(cells: Column, profile: SchemaProfile) -> Column:
    date, description = (_present(cells, profile, n) for n in profile.columns.required)
    return date & description


def match_profile(
    cells: Column, profiles: Iterable[SchemaProfile], line_no: Column | None = None, named: Column | None = None
) -> Column:
    """Best layout for a header: struct of score, matches, place, order and profile.

    The score is the share of a layout's columns that are present (two at least).
    Ties go to more matches, then to a header on the line where the layout puts
    it, then to the earlier profile. NULL where nothing matches. ``named`` is the only
    layout that may match, if it is not null.
    """
    line_no = F.lit(0) if line_no is None else line_no
    options = []
    for order, profile in enumerate(profiles):
        signature = profile.columns.signature
        found = sum((F.when(_present(cells, profile, n), 1).otherwise(0) for n in signature), F.lit(0))
        fits = (found >= MIN_MATCHES) & has_required(cells, profile)
        options.append(F.when(
            fits if named is None else (named.isNull() | (named == profile.name)) & fits,
            F.struct(
                (found / len(signature)).alias("score"),
                found.alias("matches"),
                F.coalesce(line_no == profile.file.preamble, F.lit(False)).alias("in_place"),
                F.lit(-order).alias("order"),
                F.lit(profile.name).alias("profile"),
            ),
        ))
    return F.array_max(F.array(*options))


def profile_by_filename(name: Column, otherwise: Column | None = None) -> Column:
    """First name fragment that occurs in the lower-case file name."""
    lower = F.lower(name)
    chain = F
    for fragment, profile in FILENAME_HINTS:
        chain = chain.when(lower.contains(fragment), F.lit(profile))
    return chain.otherwise(F.lit(None).cast("string") if otherwise is None else otherwise)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def plain_path(uri: Column) -> Column:
    """File metadata gives URIs; undo their escapes."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _may_be_header(line: Column, profiles: Iterable[SchemaProfile]) -> Column:
    """Whether a line has the names that some layout requires: a substring test before the exact one."""
    pairs = {tuple(tuple(p.columns.spellings(n)) for n in p.columns.required) for p in profiles}
    lower = F.lower(line)

    def any_of(names: Iterable[str]) -> Column:
        out = F.lit(False)
        for name in names:
            out = out | F.contains(lower, F.lit(name))
        return out

    out = F.lit(False)
    for date, text in sorted(pairs):
        out = out | (any_of(date) & any_of(text))
    return out


def survey(raw: DataFrame, profiles: list[SchemaProfile], encoding: str | None = None) -> DataFrame:
    """(source_file, block_start, header, first, n, invalid, upper, wide): bytes and header lines of blocks.

    `header` is a line that may be one (null: all others), `first` the number of its first
    place, `wide` which of UTF16 the first 64 bytes there are (null: neither). Lines that repeat a header merge before the shuffle, so do all others.
    """
    value = F.col("value")
    text = decoded(value, encoding) if encoding else F.when(F.is_valid_utf8(value), decoded(value, UTF8)).otherwise(decoded(value, "latin-1"))
    # In UTF-8 the bytes 80 to 9F stand inside signs; only in other files do they tell code pages apart.
    invalid = ~F.is_valid_utf8(value)
    upper = invalid & F.regexp_like(F.decode(value.cast("binary"), "ISO-8859-1"), F.lit("[\\x80-\\x9f]"))
    # Kinds are told by a number, so that the aggregate hashes; text in it would sort all lines of a file.
    raw_bytes = value.cast("binary")
    marked = F.contains(value, F.lit("\x00")) | F.startswith(raw_bytes, F.lit(b"\xff\xfe")) | F.startswith(raw_bytes, F.lit(b"\xfe\xff"))
    kind = F.when(marked, _utf16(F.substr(raw_bytes, F.lit(1), F.lit(64))))
    number = F.when(kind == UTF16[0], 0).when(kind == UTF16[1], 1)
    lines = raw.select("source_file", "block_start", "line_no", invalid.alias("invalid"), upper.alias("upper"), text.alias("text"), number.alias("wide"))
    header = F.when(_may_be_header(F.col("text"), profiles), F.col("text"))
    return lines.groupBy("source_file", "block_start", header.alias("header")).agg(
        F.min("line_no").alias("first"), F.count("*").alias("n"), F.count_if("invalid").alias("invalid"),
        F.count_if("upper").alias("upper"), F.min_by("wide", "line_no").alias("wide"),
    )


def _utf16(start: Column) -> Column:
    """utf-16-le or utf-16-be by the first bytes of a file: a mark, or zeros at one parity only."""
    code = F.hex(start)
    pairs = F.regexp_extract_all(code, F.lit("...."), F.lit(0))
    low_zero = F.size(F.filter(pairs, lambda p: F.endswith(p, F.lit("00"))))
    high_zero = F.size(F.filter(pairs, lambda p: F.startswith(p, F.lit("00"))))
    mostly = F.size(pairs) / 2
    return (
        F.when(F.startswith(code, F.lit("FFFE")) | ((low_zero > mostly) & (high_zero == 0)), UTF16[0])
        .when(F.startswith(code, F.lit("FEFF")) | ((high_zero > mostly) & (low_zero == 0)), UTF16[1])
    )


def _block_place(spec: str) -> Column:
    return F.expr(f"named_struct('block_start', block_start, 'line_no', {spec})")


def file_encodings(blocks: DataFrame) -> DataFrame:
    """(source_file, utf16, utf8, upper): what the bytes of a whole file say."""
    first = F.min_by("wide", _block_place("first"))
    return blocks.groupBy("source_file").agg(
        F.when(first == 0, UTF16[0]).when(first == 1, UTF16[1]).alias("utf16"),
        (F.sum("invalid") == 0).alias("utf8"), (F.sum("upper") > 0).alias("upper"),
    )


def headers(
    blocks: DataFrame, profiles: list[SchemaProfile], named: str | None, use_filename: bool
) -> DataFrame:
    """Per file: profile, header line, its place, cells and separator, error."""
    names = F.lit(named).cast("string")
    if use_filename and not named:
        names = profile_by_filename(file_stem(plain_path(F.col("source_file"))))
    starts = blocks.where("block_start = 0").groupBy(F.col("source_file").alias("__file")).agg(F.min("first").alias("__zero"))
    lines = (
        blocks.where("header is not null").join(starts, F.col("source_file") == F.col("__file"), "left")
        .withColumn("at", F.when(F.col("block_start") == 0, F.col("first") - F.col("__zero")))
        .withColumn("named", names)
        .withColumn("sep", separator(F.col("header"), [p.file.separator for p in profiles]))
        .withColumn("cells", header_cells(F.col("header"), F.col("sep")))
    )
    # Exploded, so that the match is worked out once and lines without one are gone.
    best = F.explode(F.array_compact(F.array(match_profile(F.col("cells"), profiles, F.col("at"), F.col("named")))))
    rank = F.struct("best.score", "best.matches", "best.in_place", (-F.col("block_start")).alias("block"), (-F.col("first")).alias("line"))
    hits = lines.select("*", best.alias("best")).withColumn("rank", rank).groupBy("source_file").agg(
        F.max_by(F.struct("best.profile", "header", "cells", "sep", "block_start", "first"), "rank").alias("hit")
    )
    every = blocks.select("source_file").distinct().withColumn("named", names)
    missing = F.when(F.col("named").isNull(), F.lit("no known header")).otherwise(
        F.concat(F.lit("required columns not found for profile "), F.col("named"))
    )
    return every.join(hits, "source_file", "left").select(
        "source_file", F.coalesce("hit.profile", "named").alias("profile"), F.col("hit.header").alias("header"),
        F.col("hit.cells").alias("cells"), F.col("hit.sep").alias("sep"), F.col("hit.block_start").alias("header_block"),
        F.col("hit.first").alias("header_line"), F.when(F.col("hit").isNull(), missing).alias("error"),
    )


def positions(profiles: Iterable[SchemaProfile], roles: Iterable[str]) -> Column:
    """Where each role's cell is in a row of the file, from 1; null where the file lacks it."""

    def of(profile: SchemaProfile, role: str) -> Column:
        name = getattr(profile.columns, role)
        spots = [F.nullif(F.array_position("cells", s), F.lit(0)) for s in (profile.columns.spellings(name) if name else [])]
        return (F.coalesce(*spots) if spots else F.lit(None)).cast("int").alias(role)

    roles, out = list(roles), None
    for profile in profiles:
        found = F.struct(*[of(profile, role) for role in roles])
        here = F.col("profile") == profile.name
        out = F.when(here, found) if out is None else out.when(here, found)
    return out


def encoding_of(profiles: Iterable[SchemaProfile]) -> Column:
    """The encoding of a file: as its bytes say, else the layout's, else Latin-1 or Windows-1252."""
    known = F.lit(None).cast("string")
    for profile in profiles:
        if codecs.lookup(profile.file.encoding).name not in ("utf-8", "iso8859-1"):
            known = F.when(F.col("profile") == profile.name, profile.file.encoding).otherwise(known)
    other = F.coalesce(known, F.when(F.col("upper"), WINDOWS).otherwise("latin-1"))
    return F.coalesce("utf16", F.when(F.col("utf8"), UTF8).otherwise(other))


def detect(
    spark: SparkSession, paths: list[str], registry: ProfileRegistry, *,
    glob: str | None = None, profile: str | None = None, use_filename: bool = False, roles: Iterable[str] = (),
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Per file that has lines: profile, encoding, header and its place, column positions, error.

    Also the paths of UTF-16 files by kind, whose lines need a reader of their own; no other
    row reaches the driver. A named profile (or one that the file name implies) only looks for
    its own header; otherwise all of them compete.
    """
    profiles = [registry.get(profile)] if profile else list(registry)
    blocks = reliable_checkpoint(survey(raw_lines(spark, paths, glob), profiles))

    def found(blocks: DataFrame, encodings: DataFrame) -> DataFrame:
        files = headers(blocks, profiles, profile, use_filename).join(encodings, "source_file")
        files = files.withColumns({"encoding": encoding_of(profiles), "columns": positions(profiles, roles), "width": F.size("cells")})
        spread = blocks.select(F.col("source_file").alias("__file"), "block_start").distinct()
        return reliable_checkpoint(files.join(spread, F.col("source_file") == F.col("__file")).drop("__file", "cells"))

    encodings = file_encodings(blocks)
    files = found(blocks, encodings)
    odd = files.where("utf16 is not null").select("utf16", plain_path(F.col("source_file")).alias("path")).distinct()
    wide = {kind: [r.path for r in rows] for kind in UTF16 if (rows := odd.where(F.col("utf16") == kind).collect())} if not odd.isEmpty() else {}
    if wide:
        parts = [blocks.join(encodings.where("utf16 is null").select("source_file"), "source_file")]
        parts += [survey(raw_lines(spark, chosen, encoding=kind), profiles, kind) for kind, chosen in wide.items()]
        files = found(reliable_checkpoint(reduce(DataFrame.unionByName, parts)), reliable_checkpoint(encodings))
    return files, wide
