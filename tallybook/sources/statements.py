"""Reading statement files into canonical rows.

One plan serves all files, however many headers they have: each line meets the facts of
its file - encoding, separator, header's place, positions of its columns - and is cut into
an array of cells, from which these positions pick.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.identity import with_ids, without_ids
from tallybook.functions.text import account_label
from tallybook.operators.normalise import (
    ROLES,
    dedup_first,
    good_rows,
    ingest_metrics,
    normalise_cells,
    quarantine,
)
from tallybook.schema import CANONICAL, empty_canonical
from tallybook.session import reliable_checkpoint
from tallybook.sources.detect import (
    SEPARATORS,
    UTF8,
    UTF16,
    WINDOWS,
    decoded,
    detect,
    file_stem,
    list_files,
    plain_path,
    raw_lines,
)
from tallybook.sources.profiles import ProfileRegistry, SchemaProfile
from tallybook.sources.records import PLACE, assemble, for_separator, split_cells

ROW_ORDER = PLACE
#: Facts of a file that go to its lines, and their bytes a row at most for which they are broadcast.
FACTS = ["profile", "encoding", "sep", "header_block", "header_line", "width", "columns"]
FACT_BYTES, BROADCAST_BYTES = 400, 8 << 20


def _text_of(value: Column, profiles: list[SchemaProfile], kinds: list[str]) -> Column:
    """Text of a line by the encoding of its file; only encodings that can occur are in the plan."""
    known = dict.fromkeys([*kinds, *(p.file.encoding for p in profiles if UTF8 not in kinds or p.file.encoding != UTF8)])
    out = decoded(value, kinds[0])
    for encoding in list(known)[1:]:
        out = F.when(F.col("encoding") == encoding, decoded(value, encoding)).otherwise(out)
    return out


def _few(rows: int) -> bool:
    """Whether facts of so many splits are broadcast; lines then stay where they are read, in order."""
    return rows * FACT_BYTES <= BROADCAST_BYTES


@dataclass
class Ingested:
    """Result of an ingest: every table is lazy."""

    rows: DataFrame
    files: DataFrame

    @property
    def kept(self) -> DataFrame:
        """Rows without an error and their places, ids repeated as in the files."""
        return good_rows(self.rows, "block_start", "line_no")

    @property
    def good(self) -> DataFrame:
        """Canonical rows, the first of each id."""
        return dedup_first(self.kept, *ROW_ORDER, packed=True).select(*CANONICAL.names)

    def good_stored(self) -> DataFrame:
        """``good`` by way of a stored copy of ``kept``: when this returns, the files are not read again."""
        kept = with_ids(reliable_checkpoint(without_ids(self.kept)))
        return dedup_first(kept, *ROW_ORDER, packed=True).select(*CANONICAL.names)

    @property
    def quarantine(self) -> DataFrame:
        return quarantine(self.rows, "row_text")

    @property
    def metrics(self) -> DataFrame:
        return ingest_metrics(self.rows, "source_file", "profile")

    @property
    def failed_files(self) -> DataFrame:
        return self.files.filter("error is not null").select("path", "profile", "error")


class StatementReader:
    """Reads one file or very many of them, whatever their layouts."""

    def __init__(self, spark: SparkSession, registry: ProfileRegistry | None = None) -> None:
        self.spark = spark
        self.registry = registry or ProfileRegistry()

    def ingest(self, path: str, *, profile: str | None = None, account: str | None = None) -> Ingested:
        """One file. Unlike a folder, a file that cannot be read is an error."""
        result = self._ingest([path], None, profile=profile, account=account)
        problem = result.files.filter("error is not null").first()
        if problem is not None:
            raise ValueError(f"{problem.path}: {problem.error}")
        return result

    def ingest_directory(
        self,
        directory: str,
        *,
        profile: str | None = None,
        account: str | None = None,
        account_map: dict[str, str] | None = None,
        glob: str = "*.csv",
    ) -> Ingested:
        """All matching files; unreadable ones are listed in ``failed_files``."""
        if list_files(self.spark, directory, glob=glob).isEmpty():
            raise FileNotFoundError(f"{directory} holds no {glob} file")
        return self._ingest([directory], glob, profile=profile, account=account, account_map=account_map)

    def ingest_files(self, files: DataFrame, **options) -> Ingested:
        """The files of a table with a column ``path``. A reader has to be told their paths, so these are collected."""
        paths = [r.path for r in files.select("path").collect()]
        return self._ingest(paths, None, **options)

    def _ingest(
        self,
        paths: list[str],
        glob: str | None,
        *,
        profile: str | None = None,
        account: str | None = None,
        account_map: dict[str, str] | None = None,
        use_filename: bool = False,
        derive_account: bool = False,
    ) -> Ingested:
        if not paths:
            return self._nothing()
        if profile:
            self.registry.get(profile)
        found, wide = detect(
            self.spark, paths, self.registry, glob=glob, profile=profile, use_filename=use_filename, roles=ROLES
        )
        report = found.select(
            F.regexp_replace(plain_path(F.col("source_file")), "^file:/+", "file:/").alias("path"), "profile", "error"
        ).distinct()
        known = found.where("error is null")
        # As many names as layouts at most.
        facts = known.agg(F.collect_set("profile").alias("names"), F.count("*").alias("rows")).first()
        profiles = [p for p in self.registry if p.name in facts.names]
        if not profiles:
            return Ingested(self._nothing().rows, report)
        separators = list(dict.fromkeys([*SEPARATORS, *(p.file.separator for p in self.registry)]))
        lines = self._lines(known, facts.rows, paths, glob, wide, profiles)
        multi = [p.name for p in profiles if p.file.multiline]
        if multi:
            within = F.col("profile").isin(multi)
            whole = assemble(lines.where(within), separators, _few(facts.rows))
            lines = whole if len(multi) == len(profiles) else lines.where(~within).unionByName(whole)
        return Ingested(self._rows(lines, separators, profiles, account, account_map, derive_account), report)

    def _nothing(self) -> Ingested:
        empty = empty_canonical(self.spark).select(
            "*",
            F.array().cast("array<string>").alias("errors"),
            F.array().cast("array<string>").alias("warnings"),
            F.lit(0).cast("bigint").alias("block_start"),
            F.lit(0).cast("bigint").alias("line_no"),
            F.lit("").alias("row_text"),
            F.lit("").alias("profile"),
        )
        return Ingested(empty, self.spark.createDataFrame([], "path string, profile string, error string"))

    def _lines(
        self, known: DataFrame, rows: int, paths: list[str], glob: str | None, wide: dict[str, list[str]], profiles: list[SchemaProfile]
    ) -> DataFrame:
        """Lines below their file's header with its facts. A file meets its lines split by split, so none is one key."""
        facts = known.select(F.col("source_file").alias("__file"), F.col("block_start").alias("__block"), *FACTS)
        if _few(rows):
            facts = F.broadcast(facts)
        sources = [(raw_lines(self.spark, paths, glob), [UTF8, "latin-1", WINDOWS])]
        sources += [(raw_lines(self.spark, chosen, encoding=kind), [kind]) for kind, chosen in wide.items()]
        out = None
        for raw, kinds in sources:
            joined = raw.join(facts, (F.col("source_file") == F.col("__file")) & (F.col("block_start") == F.col("__block")))
            here = F.col("encoding").isin(kinds[0]) if kinds[0] in UTF16 else ~F.col("encoding").isin(*UTF16)
            below = (F.col("block_start") > F.col("header_block")) | (
                (F.col("block_start") == F.col("header_block")) & (F.col("line_no") > F.col("header_line"))
            )
            text = _text_of(F.col("value"), profiles, kinds)
            rest = [c for c in FACTS if c not in ("encoding", "header_block", "header_line")]
            part = joined.where(here & below).select(*PLACE, text.alias("text"), *rest)
            out = part if out is None else out.unionByName(part)
        return out

    def _rows(
        self, lines: DataFrame, separators: list[str], profiles: list[SchemaProfile],
        account: str | None, account_map: dict[str, str] | None, derive_account: bool,
    ) -> DataFrame:
        cells = for_separator(F.col("sep"), separators, lambda s: split_cells(F.col("text"), s))
        # Blank lines are no rows; a row that is not whole is never good, whatever its first cells say.
        rows = lines.where(F.trim("text") != "").withColumn("__split", cells)
        odd = F.when(F.contains(F.regexp_replace("text", '"[^"]*"', ""), F.lit('"')), F.lit("unbalanced quote"))
        rows = rows.withColumn("malformed", F.coalesce(odd, F.when(F.size("__split") < F.col("width"), F.lit("too few cells"))))
        rows = rows.withColumn("__stem", file_stem(plain_path(F.col("source_file"))))
        if account is not None:
            label = F.lit(account)
        elif derive_account:
            label = account_label(F.col("__stem"), F.col("profile"))
        elif account_map:
            labels = self.spark.createDataFrame(list(account_map.items()), "__stem string, __label string")
            rows = rows.join(labels, "__stem", "left")
            label = F.coalesce("__label", "__stem")
        else:
            label = F.col("__stem")
        picked = F.struct(*[F.get("__split", F.col(f"columns.{role}") - 1).alias(role) for role in ROLES])
        normal = normalise_cells(
            rows.withColumns({"__account": label, "row_text": F.col("text")}),
            profiles,
            picked,
            name=F.col("profile"),
            account=F.col("__account"),
            source_file=F.col("source_file"),
            keep=["block_start", "line_no", "row_text", "malformed", "profile"],
        )
        errors = F.array_compact(F.concat(F.array("malformed"), "errors"))
        return normal.withColumn("errors", errors).drop("malformed")
