"""Conversations with missing, blank, repeated or cut turns, repaired at the least cost.

Rows of a conversation stand by turn, nulls first, ties by role and text. A row is blank (no
word), else a duplicate (role and text seen before), else truncated (its last character that
is not blank is none of `.!?`), else sound. Blank and duplicate rows must be deleted; of all
edits that give the role pattern `(s?(ua)+)?`, the cheapest are applied (see turn_grammar).

1. Rows without their texts get the turn at which their role and text first occur in the
   conversation: pre-aggregated, hot keys by broadcast. A range sort over (conversation,
   turn, role, text digest) then cuts a large conversation over many tasks, and each writes
   blocks of up to BLOCK symbols.
2. Re-Pair runs on the distinct blocks, weighed by how often they occur: a job a round
   counts neighbours, and only the PAIRS most frequent of these counts reach the driver.
   The grammar is at most RULES rules, so its broadcast is of fixed size. A sequence that
   the rules do not shorten further is multiplied as it is, so neither number changes a result.
3. Costs to go are handed through the blocks of a conversation from its end.
4. Texts meet their blocks in one shuffle by conversation and stream by in order. A digest
   of a whole conversation is made in order, so its texts pass through one task, row by
   row, but no task holds more than a block of symbols and one Arrow batch.

Cases: null role or text counts as one space; an empty role has no initial and is never kept as it is; a null conv_id is a conversation of its own;
a null turn comes first and does not count for gaps; rows that repeat turn, role and text
are duplicates of one another; a conversation without rows is absent from `repaired_turns`
and has zeros, an empty audit and the digest of nothing in `repair_report`; texts of any
length are hashed as they pass; an empty table gives no rows. Only conv_id, turn (an
integer), role and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm import turn_grammar as G
from tallybook.llm.common import checkpointed, join_facts, table
from tallybook.llm.sql_text import CRC_TABLE, crc32

#: Symbols of a block at most.
BLOCK = 2048
#: Size of the grammar, rounds of Re-Pair, and pairs that a round looks at.
RULES, ROUNDS, PAIRS = 256, 12, 64
#: Blocks whose matrices a task keeps.
MEMO = 5000
BLANKS = " \t\n\x0b\x0c\r"
ORDER = ["conv_id", "turn", "role", "digest"]


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the result contract, by CRC-32 of `conv_id:turn`."""

    def spaced(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.where("fault != 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"),
    )
    return rows.drop("copy")


def _ordered(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text")
    )
    return rows.withColumn("digest", F.unhex(F.md5("text")))


def _symbols(rows: DataFrame) -> DataFrame:
    """Rows without texts: order key, initial, fault, and whether an equal row is at an earlier turn."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = rows.select(
        *ORDER, F.substring("role", 1, 1).alias("initial"),
        F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "cut").otherwise("").alias("fault"),
    )
    keys = ["conv_id", "role", "digest"]
    facts = light.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("first_null"), F.min("turn").alias("first_turn")
    )
    marked = join_facts(light, facts.where("n > 1"), keys, "n", light.count())
    later = F.coalesce(F.when(F.col("first_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first_turn")), F.lit(False))
    return marked.select(*light.columns, later.alias("later"))


def _batches(rows: Iterator[dict], schema: pa.Schema, size: Callable[[dict], int] = lambda _: 0) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) >= 2000 or weight > 8 << 20:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _streamed(rows: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], schema: str, size=lambda _: 0) -> DataFrame:
    """mapInArrow over single rows, in and out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles = (row for batch in batches for at in range(0, batch.num_rows, 256) for row in batch.slice(at, 256).to_pylist())
        yield from _batches(work(singles), arrow, size)

    return rows.mapInArrow(run, schema)


BLOCK_FIELDS = (
    "no bigint, n int, turns string, blank int, duplicate int, truncated int, illegal int, "
    "head string, tail string, low bigint, high bigint, turn_count int"
)


def _blocks(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest of the first row, block) of each block."""
    rows = _symbols(_ordered(conversations)).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def cut(stream: Iterator[dict]) -> Iterator[dict]:
        block, symbols, last, no = None, [], None, 0
        for row in stream:
            key = tuple(row[c] for c in ORDER)
            fresh = last is None or last[0] != key[0]
            if block and (fresh or len(symbols) == BLOCK):
                yield block | {"block": block["block"] | {"n": len(symbols), "turns": "".join(symbols)}}
                block = None
            if block is None:
                counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turn_count"), 0)
                inner = {"no": no, "head": row["initial"], "tail": None, "low": None, "high": None} | counts
                block, symbols, no = {c: row[c] for c in ORDER} | {"block": inner}, [], no + 1
            inner = block["block"]
            fault = "duplicate" if row["fault"] != "blank" and (row["later"] or key == last) else row["fault"]
            if inner["tail"] is not None:
                inner["illegal"] += inner["tail"] + row["initial"] not in ("su", "ua", "au")
            inner["tail"] = row["initial"]
            if row["turn"] is not None and row["turn"] != inner["high"]:
                inner["low"] = row["turn"] if inner["low"] is None else inner["low"]
                inner["high"] = row["turn"]
                inner["turn_count"] += 1
            role = row["initial"] if row["initial"] in ("s", "u", "a") else "o"
            if fault in ("blank", "duplicate"):
                inner[fault] += 1
                symbols.append(G.GONE)
            elif fault == "cut":
                inner["truncated"] += 1
                symbols.append(G.SHORT[role])
            else:
                symbols.append(G.SOUND[role])
            last = key
        if block:
            yield block | {"block": block["block"] | {"n": len(symbols), "turns": "".join(symbols)}}

    inner = ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in BLOCK_FIELDS.split(", "))
    return _streamed(rows, cut, f"conv_id {kind}, turn bigint, role string, digest binary, block struct<{inner}>")


def _grammar(blocks: DataFrame) -> G.Grammar:
    """Re-Pair over the distinct blocks; a job a round, PAIRS rows of it to the driver."""
    kinds = checkpointed(blocks.where("block.n > 1").groupBy(F.col("block.turns").alias("turns")).agg(F.count("*").alias("n")))

    def count_pairs(rules: list[tuple[str, str]]) -> list[tuple[str, int]]:
        turns = F.col("turns")
        for symbol, pair in rules:
            turns = F.replace(turns, F.lit(pair), F.lit(symbol))
        at = F.sequence(F.lit(1), F.length("turns") - 1)
        unlike = F.filter(
            F.transform(at, lambda i: F.substr("turns", i, F.lit(2))), lambda p: F.left(p, F.lit(1)) != F.right(p, F.lit(1))
        )
        # Of equal neighbours each is counted in one pair only, as a rule would take them.
        alike = F.regexp_extract_all("turns", F.lit(r"((.)\2)"), F.lit(1))
        pairs = kinds.select(turns.alias("turns"), "n").where(F.length("turns") > 1)
        pairs = pairs.select(F.explode(F.concat(unlike, alike)).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
        return [(r.pair, r.n) for r in pairs.orderBy(F.desc("n"), "pair").limit(PAIRS).collect()]

    return G.re_pair(count_pairs, RULES, ROUNDS)


class _Memo:
    """Matrices of blocks in a task, shared by its conversations."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.grammar, self.known = G.Grammar(rules), {}

    def __call__(self, turns: str) -> G.Matrix:
        if turns not in self.known:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[turns] = self.grammar.matrix(turns)
        return self.known[turns]


def _with_costs(blocks: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ahead: the cost to go from each state after the block."""

    def back(stream: Iterator[dict]) -> Iterator[dict]:
        memo, conv, ahead = _Memo(rules), object(), []
        for row in stream:
            if row["conv_id"] != conv:
                conv, ahead = row["conv_id"], G.at_end()
            yield row | {"ahead": ahead}
            ahead = G.before(memo(row["block"]["turns"]), ahead)

    order = [F.col(c).desc() for c in [*ORDER, "block.no"]]
    rows = blocks.repartition("conv_id").sortWithinPartitions(*order)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)
    return _streamed(rows, back, f"{ddl}, ahead array<bigint>")


class _Walk:
    """One conversation passing by: headers of its blocks, then the rows of each."""

    def __init__(self, conv: object, memo: _Memo):
        self.conv, self.memo, self.headers = conv, memo, deque()
        self.state, self.letters, self.symbols, self.at, self.row = G.EMPTY, "", "", 0, 0
        self.audits: list[str] = []
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turn_count = 0
        self.tail = self.low = self.high = None

    def header(self, block: dict, ahead: list[int]) -> None:
        self.headers.append((block["turns"], ahead))
        for name in ("blank", "duplicate", "truncated", "illegal", "turn_count"):
            setattr(self, name, getattr(self, name) + block[name])
        if self.tail is not None:
            self.illegal += self.tail + block["head"] not in ("su", "ua", "au")
        self.tail = block["tail"]
        if block["low"] is not None:
            self.turn_count -= block["low"] == self.high
            self.low = block["low"] if self.low is None else self.low
            self.high = block["high"]

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            role = "assistant" if self.state == G.USER else "user"
            self.at, self.cost, self.state = self.at + 1, self.cost + G.INSERT, G.step(self.state, role[0])
            yield role, ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        if self.row == len(self.symbols):
            self.symbols, ahead = self.headers.popleft()
            self.letters, _ = G.chosen(self.memo(self.symbols), self.state, ahead)
            self.audits.append(self.letters)
            self.row = self.at = 0
        yield from self._inserted()
        letter, cut = self.letters[self.at], self.symbols[self.row].isupper()
        self.at, self.row = self.at + 1, self.row + 1
        if letter == "D":
            self.cost += G.DELETE
            return
        if letter == "R":
            role = "assistant" if self.state == G.USER else "user"
            self.cost += G.REROLE
        self.cost += cut * G.CUT
        self.state = G.step(self.state, role[:1])
        yield role, text

    def end(self) -> Iterator[tuple[str, str]]:
        self.letters, _ = G.closing(self.state)
        self.at = 0
        self.audits.append(self.letters)
        yield from self._inserted()

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turn_count


def _walked(conversations: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Texts and headers of blocks in one stream by conversation, and the grammar."""
    blocks = checkpointed(_blocks(conversations))
    rules = _grammar(blocks).rules
    headers = _with_costs(blocks, rules).select(*ORDER, F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), "block", "ahead")
    none = [F.lit(None).cast(headers.schema[c].dataType).alias(c) for c in ("block", "ahead")]
    rows = _ordered(conversations).select(*ORDER, F.lit(2).alias("kind"), "text", *none)
    both = headers.unionByName(rows)
    return both, rules


def _in_order(rows: DataFrame) -> DataFrame:
    stub = F.col("kind") == 0
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", (~stub), "turn", "role", "digest", "kind", "block.no")


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the turns that the cheapest edits leave, from position 0."""
    rows, rules = _walked(conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def walk(stream: Iterator[dict]) -> Iterator[dict]:
        memo, now, position = _Memo(rules), None, 0
        for row in stream:
            if now is None or now.conv != row["conv_id"]:
                for role, text in now.end() if now else ():
                    yield {"conv_id": now.conv, "position": position, "role": role, "text": text}
                    position += 1
                now, position = _Walk(row["conv_id"], memo), 0
            if row["kind"] == 1:
                now.header(row["block"], row["ahead"])
            else:
                for role, text in now.turn(row["role"], row["text"]):
                    yield {"conv_id": now.conv, "position": position, "role": role, "text": text}
                    position += 1
        for role, text in now.end() if now else ():
            yield {"conv_id": now.conv, "position": position, "role": role, "text": text}
            position += 1

    return _streamed(_in_order(rows), walk, f"conv_id {kind}, position bigint, role string, text string", lambda r: len(r["text"]))


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def repair_report(conversations: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """Faults, cost, audit and digest of the repaired turns, a row for each conversation.

    all_ids (conv_id) names conversations that are reported even where no row of theirs is left.
    """
    rows, rules = _walked(conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()
    ids = (conversations if all_ids is None else all_ids).select("conv_id").distinct()
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in ("conv_id", "kind")]
    rows = rows.unionByName(ids.select("conv_id", F.lit(0).alias("kind"), *none))

    def walk(stream: Iterator[dict]) -> Iterator[dict]:
        memo, now, hashed, first = _Memo(rules), None, None, True

        def add(turns: Iterator[tuple[str, str]]) -> None:
            nonlocal first
            for role, text in turns:
                hashed.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

        def report() -> dict:
            add(now.end())
            counts = {c: getattr(now, c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
            return counts | {"conv_id": now.conv, "gaps": now.gaps(), "audit": "".join(now.audits), "repaired_sha256": hashed.hexdigest()}

        for row in stream:
            if now is None or now.conv != row["conv_id"]:
                if now:
                    yield report()
                now, hashed, first = _Walk(row["conv_id"], memo), hashlib.sha256(), True
            if row["kind"] == 1:
                now.header(row["block"], row["ahead"])
            elif row["kind"] == 2:
                add(now.turn(row["role"], row["text"]))
        if now:
            yield report()

    return _streamed(_in_order(rows), walk, f"conv_id {kind}, {REPORT}", lambda r: len(r["audit"]))


def op12_turn_repair(spark, sf_dir: str) -> DataFrame:
    """Repair of all conversations after the damage of the result contract."""
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations)


def _oracle() -> str:
    """The same in DuckDB SQL: a fold over each conversation's turns, four states at a time, no grammar."""

    def plus(way: str, cost: str, letter: str, text: str = "''") -> str:
        return f"{{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 't': {way}.t || {text}}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def inserted(state: int, *roles: str) -> str:
        return plus(f"w[{state}]", str(2 * len(roles)), "I" * len(roles), "'" + "".join(f"\n{r}:" for r in roles) + "'")

    insert = ", ".join([
        "w[1]", "w[2]",
        least("w[3]", *(inserted(p, "user") for p in (1, 2, 4))),
        least("w[4]", inserted(3, "assistant"), *(inserted(p, "user", "assistant") for p in (1, 2))),
    ])

    def kept(state: int, initial: str) -> str:
        way = plus(f"w[{state}]", "x.cut", "K", "'\n' || x.role || ':' || x.text")
        return f"case when x.initial = '{initial}' and x.stays then {way} end"

    def rerole(state: int, role: str) -> str:
        way = plus(f"w[{state}]", "2 + x.cut", "R", f"'\n{role}:' || x.text")
        return f"case when x.stays then {way} end"

    edit = ", ".join([
        plus("w[1]", "3", "D"),
        least(plus("w[2]", "3", "D"), kept(1, "s")),
        least(plus("w[3]", "3", "D"), *(f(p, r) for p in (1, 2, 4) for f, r in ((kept, "u"), (rerole, "user")))),
        least(plus("w[4]", "3", "D"), kept(3, "a"), rerole(3, "assistant")),
    ])
    none = "{'c': cast(1000000000 as bigint), 'a': '', 't': ''}"
    key = "coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"
    return f"""
with {CRC_TABLE},
coded as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32(key)} % 20 as fault
  from conversations, crc_table),
damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when fault = 3 then [0, 1] else [0] end) as copy
  from coded where fault <> 0),
ordered as (
  select *, left(role, 1) as initial,
    row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as pos,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as ending
  from damaged),
judged as (
  select *, case when ending = '' then 'blank'
    when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
    when ending not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(initial) over (partition by conv_id order by pos) as former
  from ordered),
folded as (
  select conv_id,
    greatest(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (former is not null and former || initial not in ('su', 'ua', 'au')) as illegal,
    list_concat(flatten(list([
      {{'edit': false, 'role': '', 'initial': '', 'text': '', 'stays': false, 'cut': 0}},
      {{'edit': true, 'role': role, 'initial': initial, 'text': text, 'stays': fault in ('', 'truncated'),
        'cut': cast(fault = 'truncated' as integer)}}] order by pos)),
      [{{'edit': false, 'role': '', 'initial': '', 'text': '', 'stays': false, 'cut': 0}}]) as steps
  from judged group by conv_id),
ways as (
  select *, list_reduce(steps, lambda w, x: case when x.edit then [{edit}] else [{insert}] end,
    [{{'c': cast(0 as bigint), 'a': '', 't': ''}}, {none}, {none}, {none}]) as w
  from folded),
best as (select *, list_min([w[1], w[4]]) as b from ways)
select ids.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank,
  coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(coalesce(b.c, 0) as bigint) as cost, coalesce(b.a, '') as audit,
  sha256(substr(coalesce(b.t, ''), 2)) as repaired_sha256
from (select distinct conv_id from conversations) as ids left join best on ids.conv_id is not distinct from best.conv_id"""


ORACLE = _oracle()
