"""Secrets in texts: strong patterns, and weak parts that only count together.

Strong parts are reported as they are: values assigned to a secret's name, access ids and
long hex runs. Weak parts are names of users or clients with a value, mixed strings of
letters and digits, and endpoints (urls, addresses); alone each is too common to report.
Parts have roles - identifier, secret, endpoint - and an interval that reaches `reach`
code points to both sides, within a scope (text between blank lines). An interval join
finds the roles near each weak part, and it is reported if its complement is there: a
secret for an identifier, an identifier for a secret, both for an endpoint. Weak parts
that overlap a strong one are left out.

The join is on (text, scope, bin of the position), with intervals put in every bin they
touch, so a text with many parts is not compared part by part. Only DataFrame functions
are used. Positions come from the lengths of the pieces between matches.

Cases: a null text is empty and has no spans; repeated rows keep their number, their spans
are found once; a null doc_id is kept; an empty table gives no rows; only id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import checkpointed, table, text_or_empty

#: Strong kinds and what a match must have; order and patterns are fixed by the result contract.
STRONG = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",  # the runs of [0-9a-f]+ that have 24 characters
}
WEAK = {
    "ident": r"""(?i:client_?id|account_?id|access_?key(?:_?id)?|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    "mixed": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}",
    "endpoint": r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{4,}|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.])""",
}
SCOPE = r"\n[\x20\t\r]*\n"
KINDS = [*STRONG, *WEAK]
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "mixed": "secret", "endpoint": "endpoint"}


def _pieces(text: Column, kind: str, pattern: str) -> Column:
    """The kind with its matches and the lengths of the text before each; null without a match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.length) if kind == "assign" else F.transform(found, F.length)
    whole = F.struct(
        F.lit(kind).alias("kind"), between.alias("before"), F.transform(found, F.length).alias("length"), value.alias("value")
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), whole)


def _scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, row, kinds): one entry in kinds for each kind that the text has. Holds no text."""
    text = text_or_empty()
    patterns = {**STRONG, **WEAK, "scope": SCOPE}
    row = F.xxhash64(F.struct(F.col("doc_id").isNull(), F.col("doc_id")), text)
    kinds = F.array_compact(F.array(*[_pieces(text, kind, pattern) for kind, pattern in patterns.items()]))
    return docs.select("doc_id", row.alias("row"), kinds.alias("kinds"))


def _spans(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end) of all matches that are long enough, scope borders included."""
    each = scanned.select("row", F.explode("kinds").alias("k")).groupBy("row", "k.kind").agg(F.first("k").alias("k"))
    matches = each.select("row", "kind", F.posexplode(F.arrays_zip("k.before", "k.length", "k.value")).alias("at", "m"))
    earlier = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    steps = matches.select("row", "kind", "at", F.inline(F.array("m"))).withColumn(
        "gone", F.coalesce(F.sum(F.col("before") + F.col("length")).over(earlier), F.lit(0))
    )
    start = F.col("gone") + F.col("before")
    least = F.when(F.col("kind") == "assign", 6).when(F.col("kind") == "access", 20).otherwise(0)
    return steps.where(F.col("value") >= least).select(
        "row", "kind", start.cast("long").alias("start"), (start + F.col("length")).cast("long").alias("end")
    )


def _bins(first: Column, last: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.greatest(first, F.lit(0)) / width), F.floor(last / width)))


def linked_spans(spans: DataFrame, reach: int = 200) -> DataFrame:
    """The weak spans (row, kind, start, end) whose complementary parts are within reach."""
    border = F.when(F.col("kind") == "scope", 1).otherwise(0)
    by_start = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    parts = spans.withColumn("scope", F.coalesce(F.sum(border).over(by_start), F.lit(0))).where("kind != 'scope'")
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("kind")]
    parts = parts.withColumns({"role": role, "weak": F.col("kind").isin(*WEAK)})

    strong = parts.where("not weak").select("row", F.col("start").alias("s"), F.col("end").alias("e"), _bins(F.col("start"), F.col("end"), reach).alias("bin"))
    weak = parts.where("weak")
    touched = weak.withColumn("bin", _bins(F.col("start"), F.col("end"), reach)).join(
        strong, ["row", "bin"]
    ).where("start < e and s < end").select("row", "kind", "start").distinct()
    weak = weak.join(touched, ["row", "kind", "start"], "left_anti")

    usable = weak.unionByName(parts.where("not weak"))
    near = usable.select(
        "row", "scope", F.col("role").alias("other"), F.col("start").alias("s"), F.col("end").alias("e"),
        _bins(F.col("start"), F.col("end"), reach).alias("bin"),
    )
    wide = weak.withColumn("bin", _bins(F.col("start") - reach, F.col("end") + reach, reach))
    met = wide.join(near, ["row", "scope", "bin"]).where(
        (F.col("s") <= F.col("end") + reach) & (F.col("e") >= F.col("start") - reach) & (F.col("other") != F.col("role"))
    )
    roles = met.groupBy("row", "kind", "start", "end", "role").agg(F.collect_set("other").alias("others"))
    has = lambda name: F.array_contains("others", name)
    complete = (
        F.when(F.col("role") == "identifier", has("secret"))
        .when(F.col("role") == "secret", has("identifier"))
        .otherwise(has("identifier") & has("secret"))
    )
    return roles.where(complete).select("row", "kind", "start", "end")


def find_credentials(docs: DataFrame, reach: int = 200) -> DataFrame:
    """Each row's doc_id and spans: array of (start, rank, kind, end), by start, then kind as listed."""
    scanned = checkpointed(_scanned(docs))
    spans = checkpointed(_spans(scanned.where(F.size("kinds") > 0)))
    found = spans.where(F.col("kind").isin(*STRONG)).unionByName(linked_spans(spans, reach))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    listed = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,end:bigint>>")
    return scanned.select("doc_id", "row").join(listed, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_credentials(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    found = find_credentials(table(spark, sf_dir, "documents").select("doc_id", "text"))
    strong = F.filter("spans", lambda s: s["kind"].isin(*STRONG))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, STRONG),
        F.sha2(_written(strong), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
    )
