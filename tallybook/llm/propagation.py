"""Shards by balanced label propagation: linked documents move together, sizes stay even.

Documents of one text are a unit, and all that propagation needs of a unit is how many of
its rows each shard holds (a cell). Units are linked by the lines that they share. Such a
link is not a pair: a line is a hub, a round adds up the cells of its units by shard, and
one row of these sums goes back to each of them. A hub's vote is divided by its number of
units, so a line of a third of all documents says next to nothing, and is neither dropped
nor paired. Explicit links between documents may be given as well.

A round counts votes per unit and shard - own rows, hubs and links - and sends the unit's
other rows to its best shard that has room. Quotas decide how many rows each shard may
take; the largest units go first, a row prefix of the last one fits. In every other round
units go to their best shard of all, full or not, as many rows from one shard to another as
come back. Rounds end when two in turn have neither gathered units nor lowered the weight
of cut links, given ones and those by lines, by GAIN of what was reached before.
Then rows of no unit fill the shards up, which makes the law exact: `rows` - the row
counts of any two shards differ by one at most.

A unit above a shard's quota is given whole shards before the first round. Cells of a unit number
n_shards at most, so a group of any size is a few rows during the rounds, and its rows are
dealt out at the end by a running number in buckets (`running_total`).

Cases: null texts are the empty text; a null doc_id is a row like any other; repeated rows
each get a place; an empty table gives no rows; lines of fewer than LINE_WORDS words link
nothing; links that name unknown ids or the same unit twice play no part; columns to carry
along are named by the caller, result names (shard, slot, size, text_crc32) replace columns
of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import HOT_SHARE, bucket_of, buckets_for, checkpointed, join_facts, place, running_total, table, text_or_empty
from tallybook.llm.line_frequency import line_hashes

LAW = "rows"
#: Words of a line from which it links the documents that hold it.
LINE_WORDS = 5
#: Votes of a row for the shard it is in, and of a shared line in all, by its units.
OWN, SHARED = 1000, 8000
#: What a round has to gain, as a share, to count as one that helped.
GAIN = 0.05


def _choice(values: dict[int, int], key: Column) -> Column:
    """The value of a small driver-side mapping (one entry per shard, or pair of them) at a key column.

    An array, as the optimiser makes a map of literals a CASE that works the key out for each branch.
    """
    known = [F.lit(values.get(i)).cast("long") for i in range(max(values) + 1)]
    return F.get(F.array(*known), key.cast("int"))


def shared_lines(docs: DataFrame) -> DataFrame:
    """(unit, hub, units): the lines that a unit shares with others, and how many units hold each."""
    text = text_or_empty()
    long = F.filter(line_hashes(text), lambda x: x["words"] >= LINE_WORDS)
    each = docs.select(F.md5(text.cast("binary")).alias("unit"), F.explode(F.array_distinct(F.transform(long, lambda x: x["h"]))).alias("hub"))
    each = checkpointed(each.distinct())
    sizes = each.groupBy("hub").agg(F.count("*").alias("units"), F.count("*").alias("rows")).where("units > 1")
    found = join_facts(each, sizes, ["hub"], "rows", each.count())
    return checkpointed(found.where("units is not null"))


def _hub_sums(cells: DataFrame, members: DataFrame) -> DataFrame:
    """(hub, units, held): rows of the hub's units in each shard that has any.

    Sums are made by hub and shard, so only shards that hold something cost a row.
    """
    sums = members.join(cells.select("unit", "shard", "n"), "unit").groupBy("hub", "units", "shard").agg(F.sum("n").alias("n"))
    return sums.groupBy("hub", "units").agg(F.collect_list(F.struct("shard", "n")).alias("held"))


def _weight() -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(SHARED) / F.col("units"))).cast("long")


def cut_weight(sums: DataFrame) -> int:
    """The weight of cut links: rows of each hub outside its largest shard."""
    rows = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return sums.agg(F.sum(_weight() * (rows - F.array_max("held.n")))).first()[0] or 0


def cut_links(cells: DataFrame, links: DataFrame) -> int:
    """The weight of given links whose units have their largest cells in different shards, each way once."""
    at = cells.groupBy("unit").agg(F.max_by("shard", F.struct("n", "shard")).alias("shard"))
    ends = links.join(at, "unit").join(at.select(F.col("unit").alias("other"), F.col("shard").alias("there")), "other")
    return ends.where("shard != there").agg(F.sum((F.col("weight") * OWN).cast("long"))).first()[0] or 0


def _votes(
    cells: DataFrame, links: DataFrame | None, members: DataFrame | None = None, sums: DataFrame | None = None, memberships: int = 0
) -> DataFrame:
    """(unit, shard, n, votes): own rows, what linked units hold there, and what shared lines do.

    Sums of hubs with more than 1/HOT_SHARE of the memberships - fewer than HOT_SHARE hubs -
    are broadcast, so no task gets a hot hub and their memberships stay where they are.
    """
    votes = cells.select("unit", "shard", "n", (F.col("n") * OWN).alias("votes"))
    none = F.lit(0).cast("long").alias("n")
    if links is not None:
        theirs = links.join(cells.withColumnRenamed("unit", "other"), "other")
        votes = votes.union(theirs.select("unit", "shard", none, (F.col("weight") * F.col("n") * OWN).cast("long").alias("votes")))
    if members is not None:
        hot = F.col("units") * HOT_SHARE > memberships
        facts = sums.withColumn("held", F.transform("held", lambda x: F.struct(x["shard"].alias("shard"), (x["n"] * _weight()).alias("votes"))))
        asked = [
            members.where(hot).select("unit", "hub").join(F.broadcast(facts.where(hot)), "hub"),
            members.where(~hot).select("unit", "hub").join(facts.where(~hot), "hub"),
        ]
        for met in asked:
            votes = votes.union(met.select("unit", F.inline("held")).select("unit", "shard", none, "votes"))
    return votes.groupBy("unit", "shard").agg(F.sum("n").alias("n"), F.sum("votes").alias("votes"))


def _wishes(votes: DataFrame, room: dict[int, int]) -> DataFrame:
    """(unit, shard, to, n, total): rows that a unit wants to move to its best open shard.

    Ties go by a hash, which differs by unit. Rows stay in a full shard with more votes
    than the best open one, unless the unit is in several shards and fits there as a whole.
    """
    tie = F.xxhash64("unit", "shard")
    per_unit = votes.groupBy("unit").agg(
        F.collect_list(F.struct("votes", tie.alias("tie"), "shard", "n")).alias("cells"), F.sum("n").alias("total")
    )
    opened = F.filter("cells", lambda c: _choice(room, c["shard"]) > 0)
    best = per_unit.withColumn("best", F.array_max(opened)).where(F.col("best").isNotNull())
    parts = F.size(F.filter("cells", lambda c: c["n"] > 0))
    each = best.select("unit", "total", "best", parts.alias("parts"), F.inline("cells"))
    fits = (F.col("parts") > 1) & (F.col("total") <= _choice(room, F.col("best.shard")))
    moving = (F.col("n") > 0) & (F.col("shard") != F.col("best.shard")) & (
        (F.struct("votes", "tie", "shard", "n") < F.col("best")) | fits
    )
    return each.where(moving).select("unit", "shard", F.col("best.shard").alias("to"), "n", "total")


def _seated(cells: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """Cells in which units that fill a shard or more hold whole shards; other units start in the rest.

    There are no more such units than shards, so the driver may deal them out.
    """
    cells = cells.select("unit", "shard", "n")
    large = cells.groupBy("unit").agg(F.sum("n").alias("total")).where(F.col("total") >= max(1, *quotas.values())).select("unit")
    held: dict = {}
    for r in cells.join(F.broadcast(large), "unit").collect():
        held.setdefault(r["unit"], {})[r["shard"]] = r["n"]
    if not held:
        return cells
    room, seats = dict(quotas), []
    for unit, at in sorted(held.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        left = sum(at.values())
        for shard in sorted(room, key=lambda s: (-room[s], -at.get(s, 0), s)):
            taken = min(left, room[shard])
            if taken:
                seats.append((unit, shard, taken))
                room[shard], left = room[shard] - taken, left - taken
    dealt = cells.sparkSession.createDataFrame(seats, cells.schema)
    opened = [s for s in sorted(room) if room[s]]
    if not opened:  # no row is left
        return dealt
    elsewhere = F.get(F.array(*map(F.lit, opened)), F.pmod(F.xxhash64("unit", "shard"), F.lit(len(opened))).cast("int"))
    rest = cells.join(F.broadcast(large), "unit", "left_anti").withColumn(
        "shard", F.when(F.col("shard").isin(opened), F.col("shard")).otherwise(elsewhere)
    )
    return dealt.union(rest.groupBy("unit", "shard").agg(F.sum("n").alias("n")))


def propagate(
    cells: DataFrame, quotas: dict[int, int], links: DataFrame | None, rows_per_bucket: int, members: DataFrame | None = None
) -> DataFrame:
    """Cells (unit, shard, n) after the moves. The driver sees a few numbers per shard and round."""
    cells = checkpointed(_seated(checkpointed(cells), quotas))
    n_cells = cells.count()
    spread = buckets_for(n_cells, rows_per_bucket)
    memberships = members.count() if members is not None else 0
    # A round stores few rows: as many partitions as they fill, since each costs files in every shuffle after it.
    parts = buckets_for(n_cells + memberships, rows_per_bucket)
    stored = lambda df: checkpointed(df.coalesce(parts))
    cells = cells.coalesce(parts)
    members = members.coalesce(parts) if memberships else None
    n_shards = len(quotas)
    best_cut, best_gathered, idle, turn = None, -1, 0, 0
    while True:
        figures = cells.groupBy("shard").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("decimal(38,0)") * F.col("n")).alias("squares")).collect()
        held = {r["shard"]: r["n"] for r in figures}
        sums = stored(_hub_sums(cells, members)) if members is not None else None
        cut = (cut_weight(sums) if sums is not None else 0) + (cut_links(cells, links) if links is not None else 0)
        gathered = sum(int(r["squares"]) for r in figures)
        helped = best_cut is None or cut < best_cut * (1 - GAIN) or gathered > best_gathered * (1 + GAIN)
        idle = 0 if helped else idle + 1
        if idle == 2:  # neither kind of turn has helped
            return cells
        best_cut, best_gathered = cut if best_cut is None else min(cut, best_cut), max(gathered, best_gathered)
        room = {s: quota - held.get(s, 0) for s, quota in quotas.items()}
        votes = _votes(cells, links, members, sums, memberships)
        if turn % 2 == 0:  # into shards with room
            wishes, keys, limit = stored(_wishes(votes, room)), ["to"], _choice(room, F.col("to"))
        else:  # by exchange: as many rows from a to b as from b to a; a half of the units, so that linked ones do not swap places
            wishes = _wishes(votes, dict.fromkeys(quotas, 1))
            wishes = stored(wishes.where(F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(2)) == 0))
            flows = {(r["shard"], r["to"]): r["n"] for r in wishes.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
            even = {a * n_shards + b: min(n, flows.get((b, a), 0)) for (a, b), n in flows.items()}
            keys, limit = ["shard", "to"], _choice(even or {0: 0}, F.col("shard") * n_shards + F.col("to"))
        turn += 1
        wishes = wishes.withColumn("_at", place(F.col("unit"), F.lit(3)))
        size = F.floor(F.log2(F.col("total").cast("double"))).cast("long")
        # Larger units first, in classes of powers of two; within a class by hash.
        wishes = wishes.withColumn("_bucket", (F.lit(63) - size) * spread + bucket_of(F.col("_at"), spread))
        queued = running_total(wishes, keys, "_bucket", ["_at", "unit", "shard"], F.col("n"), "_before")
        taken = F.greatest(F.lit(0), F.least(F.col("n"), limit - F.col("_before")))
        moves = stored(queued.withColumn("n", taken).where("n > 0").select("unit", "shard", "to", "n"))
        out = moves.select("unit", "shard", (-F.col("n")).alias("n"))
        into = moves.select("unit", F.col("to").alias("shard"), "n")
        cells = stored(
            cells.union(out).union(into).groupBy("unit", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        )


def shards(
    docs: DataFrame, n_shards: int = 24, links: DataFrame | None = None, carry: Sequence[str] = (),
    order: Sequence[str] = (), by_lines: bool = True, rows_per_bucket: int = 20_000,
) -> DataFrame:
    """Every row of docs as doc_id, size, text_crc32, unit, shard, slot and the carried columns.

    links: optional (doc_id, linked_id, weight) between documents of different texts; weight is
    that of a row of the linked unit against one of the own. by_lines: documents of different
    texts are linked by the lines they share.
    order: columns of `carry` by which slots count up within a shard; a hash by default. Its
    first is a whole number that puts the rows into ranges, each small enough for a task.
    """
    text = text_or_empty()
    extra = [c for c in carry if c not in ("doc_id", "size", "text_crc32", "unit", "shard", "slot")]
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("unit"), F.xxhash64("doc_id").alias("_id"), *extra,
    )
    rows = checkpointed(rows.withColumn("_at", place(F.col("_id"), F.col("unit"))))
    total = rows.count()
    spread = buckets_for(total, rows_per_bucket)
    quotas = {s: total // n_shards + (s < total % n_shards) for s in range(n_shards)}

    # Rows start where a hash of their id puts them, so groups of copies start out apart.
    start = rows.groupBy("unit", F.pmod("_id", F.lit(n_shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    sizes = start.groupBy("unit").agg(F.sum("n").alias("total"), F.count("*").alias("parts"))
    grouped = sizes.where("total > 1").select("unit")
    if links is not None:
        links, grouped = _unit_links(rows, links, grouped)
    members = shared_lines(docs) if by_lines else None
    if members is not None:
        grouped = grouped.union(members.select("unit")).distinct()
    # In the rounds a unit is its number: short keys, and one number for one text.
    spots = grouped.withColumn("_at", place(F.col("unit"))).withColumn("_bucket", bucket_of(F.col("_at"), spread))
    numbered = checkpointed(running_total(spots, [], "_bucket", ["_at", "unit"], F.lit(1), "no").select("unit", "no"))
    by_number = lambda df, name="unit": df.join(numbered.withColumnRenamed("unit", name), name).drop(name).withColumnRenamed("no", name)
    cells = by_number(start)
    if links is not None:
        links = checkpointed(by_number(by_number(links), "other"))
    if members is not None:
        members = checkpointed(by_number(members))
    cells = propagate(cells, quotas, links, rows_per_bucket, members)
    cells = cells.withColumnRenamed("unit", "no").join(numbered, "no").drop("no")

    # Rows of a unit are equal, so a running number deals them to its cells.
    ends = cells.withColumn("_end", F.sum("n").over(Window.partitionBy("unit").orderBy("shard")))
    ranges = ends.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("_end", "shard"))).alias("_ranges"))
    by_unit = rows.withColumn("_bucket", bucket_of(F.shiftrightunsigned(F.xxhash64("_id", F.lit(5)), 33), spread))
    linked = running_total(by_unit.join(grouped, "unit", "left_semi"), ["unit"], "_bucket", ["_at", "_id"], F.lit(1), "_rank")
    linked = linked.join(ranges, "unit").withColumn(
        "shard", F.filter("_ranges", lambda r: r["_end"] > F.col("_rank"))[0]["shard"]
    ).drop("_ranges", "_rank")
    single = by_unit.join(grouped, "unit", "left_anti").withColumn("shard", F.lit(None).cast("int"))

    # A shard above its quota gives the rest to the pool of rows without a unit.
    placed = linked.unionByName(single).withColumn("_bucket", bucket_of(F.col("_at"), spread))
    placed = checkpointed(running_total(placed, ["shard"], "_bucket", ["_at", "unit", "_id"], F.lit(1), "_rank"))
    stays = F.col("shard").isNotNull() & (F.col("_rank") < _choice(quotas, F.col("shard")))
    held = {r["shard"]: r["n"] for r in placed.where(stays).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    pool = running_total(placed.where(~F.coalesce(stays, F.lit(False))).drop("_rank"), [], "_bucket", ["_at", "unit", "_id"], F.lit(1), "_rank")
    shard, reach = F.lit(None).cast("int"), total - sum(held.values())
    for s in reversed(range(n_shards)):
        shard = F.when(F.col("_rank") < reach, F.lit(s)).otherwise(shard)
        reach -= quotas[s] - held.get(s, 0)
    pooled = pool.withColumn("shard", shard)
    done = placed.where(stays).unionByName(pooled).drop("_rank")
    ranges, *within = order or ["_bucket"]
    done = running_total(done, ["shard"], ranges, [*within, "_at", "unit", "_id"], F.lit(1), "slot")
    return done.select("doc_id", "size", "text_crc32", "unit", F.col("shard").cast("int"), F.col("slot").cast("long"), *extra)


def _unit_links(rows: DataFrame, links: DataFrame, grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between units, both ways, and all units that have copies or links."""
    units = rows.select("doc_id", "unit").where("doc_id is not null").distinct()
    a = units.select(F.col("doc_id").alias("doc_id"), F.col("unit"))
    b = units.select(F.col("doc_id").alias("linked_id"), F.col("unit").alias("other"))
    pairs = links.join(a, "doc_id").join(b, "linked_id").where("unit != other").select("unit", "other", "weight")
    both = pairs.union(pairs.select(F.col("other").alias("unit"), F.col("unit").alias("other"), "weight"))
    both = checkpointed(both.groupBy("unit", "other").agg(F.max("weight").alias("weight")))
    return both, grouped.union(both.select("unit")).distinct()


def op7_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law `rows`."""
    found = shards(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
